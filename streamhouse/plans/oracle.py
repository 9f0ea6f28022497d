"""The registered queries in ANSI SQL, for an independent check."""

from __future__ import annotations

DAY_MS = 86_400_000
GAP_MS = 1_800_000
PRODUCT_WINDOW_MS = 30 * DAY_MS
SECOND = "%Y-%m-%d %H:%M:%S"


def _text(ms: str) -> str:
    return f"strftime(make_timestamp(CAST(({ms}) * 1000 AS BIGINT)), '{SECOND}')"


def _window(ms: str, width: int) -> str:
    start = f"(({ms}) // {width}) * {width}"
    return f"{_text(start)} AS stt, {_text(f'{start} + {width}')} AS edt"


def _money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV = """ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'view' THEN 'good_detail' WHEN 'click' THEN 'good_list'
              ELSE event_type END AS page_id
  FROM events)"""

LOG = f"""log AS (
  SELECT CAST(user_id AS VARCHAR) AS mid, 'v' || (user_id % 3) AS vc, 'ch' || (user_id % 5) AS ch,
         CAST(user_id % 25 AS VARCHAR) AS ar, page_id, event_type, k, ts,
         strftime(make_timestamp(ts * 1000), '%Y%m%d') AS dt,
         (user_id + ts // 86400000) % 4 <> 0 AS told_new,
         CAST(floor(value * 1000) AS BIGINT) AS during_time,
         CASE WHEN ts - lag(ts) OVER w < {GAP_MS} THEN lag(page_id) OVER w END AS last_page_id,
         lead(ts) OVER w - ts AS next_gap
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

FIXED = """fixed AS (
  SELECT *, CASE WHEN told_new AND dt = min(CASE WHEN told_new THEN dt END) OVER (PARTITION BY mid)
                 THEN '1' ELSE '0' END AS is_new
  FROM log)"""

VISITS = """visits AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY mid, dt ORDER BY ts) AS rn
    FROM {log} WHERE coalesce(last_page_id, '') = '') q
  WHERE rn = 1)"""

BOUNCES = f"""bounced AS (
  SELECT * FROM {{log}}
  WHERE coalesce(last_page_id, '') = '' AND (next_gap IS NULL OR next_gap >= {GAP_MS}))"""

OINFO = f"""oinfo AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS order_status,
         {_money('o_totalprice')} AS total_amount, epoch_ms(o_orderdate) AS ms,
         strftime(o_orderdate, '{SECOND}') AS create_time, CAST(c_nationkey AS BIGINT) AS province_id
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

ODETAIL = f"""odetail AS (
  SELECT l_orderkey * 10 + l_linenumber AS detail_id, l_orderkey AS order_id,
         l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num,
         {_money('l_extendedprice')} AS price, epoch_ms(o_orderdate) AS ms,
         l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PAY = f"""pay AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, {_money('o_totalprice')} AS total_amount,
         o_orderpriority AS subject, CAST(1101 + o_orderkey % 3 AS VARCHAR) AS payment_type,
         epoch_ms(o_orderdate) + (o_orderkey % 3600) * 1000 AS ms
  FROM orders WHERE o_orderstatus = 'F')"""

PDIMS = """sku AS (
  SELECT p_partkey AS sku_id, p_name AS sku_name, CAST(p_retailprice AS DECIMAL(18,2)) AS sku_price,
         CAST(p_size AS BIGINT) AS spu_id,
         CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS tm_id,
         CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) AS category3_id, p_type
  FROM part),
spu AS (SELECT spu_id, min(sku_name) AS spu_name FROM sku GROUP BY spu_id),
tm AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS tm_id, min(p_brand) AS tm_name
       FROM part GROUP BY 1),
cat AS (SELECT category3_id, min(p_type) AS category3_name FROM sku GROUP BY category3_id),
pdim AS (
  SELECT sku_id, sku_name, sku_price, spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
  FROM sku LEFT JOIN spu USING (spu_id) LEFT JOIN tm USING (tm_id) LEFT JOIN cat USING (category3_id))"""

AGE = """CAST(trunc((epoch_ms(TIMESTAMP '2024-01-01 00:00:00')
  - epoch_ms(CAST(DATE '1960-01-01' + CAST(c_custkey * 37 % 14600 AS INTEGER) AS TIMESTAMP)))
  / 31536000000.0) AS INTEGER)"""

ORDER_WIDE = (
    _with(OINFO, ODETAIL, PDIMS)
    + f"""SELECT d.detail_id, o.id AS order_id, d.sku_id, CAST(d.price AS DOUBLE) AS order_price,
  d.sku_num, p.sku_name, o.province_id, o.order_status, o.user_id,
  CAST(o.total_amount AS DOUBLE) AS total_amount, CAST(d.price AS DOUBLE) AS split_total_amount,
  o.create_time, substr(o.create_time, 1, 10) AS create_date, substr(o.create_time, 12, 2) AS create_hour,
  n.n_name AS province_name, CAST(n.n_regionkey AS VARCHAR) AS province_area_code,
  'I' || n.n_nationkey AS province_iso_code, 'CN-' || n.n_nationkey AS province_3166_2_code,
  {AGE} AS user_age, CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS user_gender,
  p.spu_id, p.tm_id, p.category3_id, p.spu_name, p.tm_name, p.category3_name
FROM oinfo o JOIN odetail d ON o.id = d.order_id AND d.ms BETWEEN o.ms - 5 AND o.ms + 5
LEFT JOIN customer c ON c.c_custkey = o.user_id
LEFT JOIN nation n ON n.n_nationkey = o.province_id
LEFT JOIN pdim p ON p.sku_id = d.sku_id"""
)

PRODUCT_CTES = (
    EV,
    ODETAIL,
    PAY,
    PDIMS,
    f"""moved AS (SELECT *, ts - {9131 * DAY_MS} AS ms FROM ev)""",
    """rows_ AS (
  SELECT ms, k AS sku_id, 'click' AS kind, NULL AS order_id, 0 AS num, CAST(0 AS DECIMAL(18,2)) AS amount
  FROM moved WHERE event_type = 'view'
  UNION ALL SELECT ms, k, 'display', NULL, 0, 0 FROM moved WHERE event_type = 'view'
  UNION ALL SELECT ms, k, 'favor', NULL, 0, 0 FROM moved WHERE event_type = 'click'
  UNION ALL SELECT ms, k, 'cart', NULL, 0, 0 FROM moved WHERE event_type = 'purchase'
  UNION ALL SELECT ms, sku_id % 100, 'order', order_id, sku_num, price FROM odetail
  UNION ALL SELECT p.ms, sku_id % 100, 'payment', d.order_id, 0, price
    FROM odetail d JOIN pay p ON p.order_id = d.order_id AND d.ms BETWEEN p.ms - 1800000 AND p.ms
  UNION ALL SELECT ms, sku_id % 100, 'refund', order_id, 0, price FROM odetail WHERE l_returnflag = 'R'
  UNION ALL SELECT ms, sku_id % 100, CASE WHEN l_linestatus = 'O' THEN 'good' ELSE 'bad' END, NULL, 0, 0
    FROM odetail WHERE l_returnflag = 'A')""",
    f"""totals AS (
  SELECT ms // {PRODUCT_WINDOW_MS} AS slot, sku_id,
    count(*) FILTER (kind = 'display') AS display_ct, count(*) FILTER (kind = 'click') AS click_ct,
    count(*) FILTER (kind = 'favor') AS favor_ct, count(*) FILTER (kind = 'cart') AS cart_ct,
    CAST(sum(num) AS BIGINT) AS order_sku_num,
    CAST(coalesce(sum(amount) FILTER (kind = 'order'), 0) AS DOUBLE) AS order_amount,
    count(DISTINCT order_id) FILTER (kind = 'order') AS order_ct,
    CAST(coalesce(sum(amount) FILTER (kind = 'payment'), 0) AS DOUBLE) AS payment_amount,
    count(DISTINCT order_id) FILTER (kind = 'payment') AS paid_order_ct,
    count(DISTINCT order_id) FILTER (kind = 'refund') AS refund_order_ct,
    CAST(coalesce(sum(amount) FILTER (kind = 'refund'), 0) AS DOUBLE) AS refund_amount,
    count(*) FILTER (kind IN ('good', 'bad')) AS comment_ct,
    count(*) FILTER (kind = 'good') AS good_comment_ct
  FROM rows_ GROUP BY 1, 2)""",
    f"""pstats AS (
  SELECT {_window(f'slot * {PRODUCT_WINDOW_MS}', PRODUCT_WINDOW_MS)}, t.*, sku_name,
    CAST(sku_price AS DOUBLE) AS sku_price, spu_id, spu_name, tm_id, tm_name, category3_id, category3_name
  FROM totals t LEFT JOIN pdim USING (sku_id))""",
)

# Change records of the fixture: table, type, key, kept columns per route.
CHANGES = """changes AS (
  SELECT 'nation' AS tbl, 'insert' AS type, CAST(n_nationkey AS VARCHAR) AS pk, 3 AS fields FROM nation
  UNION ALL SELECT 'nation', 'update', CAST(n_nationkey AS VARCHAR), 3 FROM nation
  UNION ALL SELECT 'orders', CASE WHEN o_orderstatus = 'F' THEN 'bootstrap-insert' ELSE 'insert' END,
    CAST(o_orderkey AS VARCHAR), 6 FROM orders
  UNION ALL SELECT 'orders', 'delete', CAST(o_orderkey AS VARCHAR), 6 FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'customer', 'insert', CAST(c_custkey AS VARCHAR), 5 FROM customer
  UNION ALL SELECT 'part', 'insert', CAST(p_partkey AS VARCHAR), 6 FROM part
  UNION ALL SELECT 'supplier', 'insert', CAST(s_suppkey AS VARCHAR), 4 FROM supplier)"""

ROUTED = """routes AS (
  SELECT * FROM (VALUES
    ('nation', 'insert', 'hbase', 'DIM_BASE_PROVINCE', 'n_name,n_nationkey'),
    ('nation', 'update', 'hbase', 'DIM_BASE_PROVINCE', 'n_name,n_nationkey'),
    ('orders', 'insert', 'kafka', 'dwd_order_info', 'o_custkey,o_orderdate,o_orderkey,o_totalprice'),
    ('customer', 'insert', 'kafka', 'dwd_customer', 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey'))
  AS r(tbl, type, sink_type, sink_table, kept)),
typed AS (
  SELECT tbl, CASE type WHEN 'bootstrap-insert' THEN 'insert' ELSE type END AS type, pk FROM changes),
routed AS (SELECT * FROM typed JOIN routes USING (tbl, type))"""

SQL: dict[str, str] = {
    "json_parse": """SELECT event_id,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_bad
FROM events""",
    "cdc_clean": _with(CHANGES)
    + """SELECT tbl AS "table", type, count(*) AS records, CAST(sum(fields) AS BIGINT) AS fields
FROM changes GROUP BY 1, 2""",
    "cdc_route": _with(CHANGES, ROUTED)
    + """SELECT tbl AS "table", type, sink_type, sink_table, pk FROM routed""",
    "cdc_prune_columns": _with(CHANGES, ROUTED) + "SELECT sink_table, kept, pk FROM routed",
    "dim_upsert_latest": """WITH last AS (
  SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS total,
         bool_or(o_orderstatus = 'P') AS blanked
  FROM orders GROUP BY o_custkey)
SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS c_custkey, c_name,
  CAST(coalesce(total, c_acctbal) AS DOUBLE) AS c_acctbal,
  CASE WHEN coalesce(blanked, false) THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer FULL JOIN last ON c_custkey = o_custkey""",
    "dim_lookup_multi_key": """WITH first AS (
  SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_order,
         arg_min(o_totalprice, o_orderkey) AS first_total
  FROM orders GROUP BY 1, 2)
SELECT c_custkey, 'F' AS status, first_order, first_total
FROM customer LEFT JOIN first ON o_custkey = c_custkey AND o_orderstatus = 'F'""",
    "log_split_counts": """SELECT 'start' AS output, count(*) AS records FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'page', count(*) FROM events WHERE event_type <> 'signup'
UNION ALL SELECT 'display', 2 * count(*) FROM events WHERE event_type = 'view'""",
    "display_explode": _with(EV)
    + """SELECT 'sku_id' AS item_type, CAST(k AS VARCHAR) AS item, page_id, ts FROM ev WHERE event_type = 'view'
UNION ALL SELECT 'activity_id', CAST(k + 1 AS VARCHAR), page_id, ts FROM ev WHERE event_type = 'view'""",
    "new_visitor_repair": _with(EV, LOG, FIXED) + "SELECT mid, ts, is_new FROM fixed",
    "unique_visit": _with(EV, LOG, VISITS.format(log="log"))
    + "SELECT mid, dt, ts, page_id FROM visits",
    "bounce_detail": _with(EV, LOG, BOUNCES.format(log="log"))
    + "SELECT mid, ts, page_id FROM bounced",
    "order_detail_interval_join": f"""SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS detail_id,
  strftime(o_orderdate, '{SECOND}') AS create_time, strftime(l_shipdate, '{SECOND}') AS detail_create_time,
  CAST({_money('l_extendedprice')} AS DOUBLE) AS split_total_amount
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 5 DAY""",
    "user_age": f"""SELECT CAST(c_custkey AS VARCHAR) AS "ID",
  strftime(DATE '1960-01-01' + CAST(c_custkey * 37 % 14600 AS INTEGER), '%Y-%m-%d') AS "BIRTHDAY",
  {AGE} AS user_age
FROM customer""",
    "order_wide": ORDER_WIDE,
    "order_wide_json": ORDER_WIDE,
    "order_wide_coalesce": """WITH l AS (
  SELECT o_orderkey AS detail_id, o_custkey AS user_id, o_orderstatus AS order_status,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS total_amount,
    o_totalprice AS split_total_amount
  FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT o_orderkey AS detail_id, o_custkey AS user_id, 'X' AS order_status,
  CAST(0 AS DOUBLE) AS total_amount FROM orders WHERE o_orderstatus IN ('F', 'P'))
SELECT coalesce(l.detail_id, r.detail_id) AS detail_id, coalesce(l.user_id, r.user_id) AS user_id,
  coalesce(l.order_status, r.order_status) AS order_status,
  coalesce(l.total_amount, r.total_amount) AS total_amount, l.split_total_amount
FROM l FULL JOIN r ON l.detail_id = r.detail_id""",
    "payment_wide": _with(OINFO, ODETAIL, PAY)
    + f"""SELECT p.order_id AS payment_id, p.subject, p.payment_type, {_text('p.ms')} AS payment_create_time,
  {_text('p.ms')} AS callback_time, d.detail_id, p.order_id, d.sku_id, d.sku_num, o.order_status, p.user_id,
  CAST(p.total_amount AS DOUBLE) AS total_amount, CAST(d.price AS DOUBLE) AS split_total_amount,
  o.create_time AS order_create_time
FROM pay p JOIN oinfo o ON o.id = p.order_id AND o.ms BETWEEN p.ms - 1800000 AND p.ms
JOIN odetail d ON d.order_id = o.id""",
    "dim_left_outer_missing": """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS sku_name,
  p_retailprice AS sku_price
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_type = 'ECONOMY'""",
    "visitor_stats": _with(EV, LOG, FIXED, VISITS.format(log="fixed"), BOUNCES.format(log="fixed"))
    + f"""SELECT {_window('ts', 3_600_000)}, vc, ch, ar, is_new,
  CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct,
  CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum
FROM (
  SELECT ts, vc, ch, ar, is_new, 0 AS uv, 1 AS pv, 0 AS sv, 0 AS uj, during_time AS dur FROM fixed
  UNION ALL SELECT ts, vc, ch, ar, is_new, 1, 0, 0, 0, 0 FROM visits
  UNION ALL SELECT ts, vc, ch, ar, is_new, 0, 0, 1, 0, 0 FROM fixed WHERE coalesce(last_page_id, '') = ''
  UNION ALL SELECT ts, vc, ch, ar, is_new, 0, 0, 0, 1, 0 FROM bounced) u
GROUP BY 1, 2, 3, 4, 5, 6""",
    "product_stats": _with(*PRODUCT_CTES) + "SELECT * EXCLUDE (slot) FROM pstats",
    "province_stats": _with(OINFO, ODETAIL)
    + f"""SELECT {_window('o.ms', 10_000)}, province_id, n_name AS province_name,
  CAST(n_regionkey AS VARCHAR) AS area_code, 'I' || n_nationkey AS iso_code,
  'CN-' || n_nationkey AS iso_3166_2, CAST(sum(price) AS DOUBLE) AS order_amount,
  count(DISTINCT order_id) AS order_count
FROM oinfo o JOIN odetail d ON o.id = d.order_id
LEFT JOIN nation ON n_nationkey = province_id
GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "keyword_explode": """SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS keyword
FROM documents""",
    "keyword_search": _with(EV)
    + f"""SELECT {_window('ts', 3_600_000)}, keyword, count(*) AS ct, 'SEARCH' AS source
FROM (
  SELECT ts, unnest(regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+')) AS keyword
  FROM ev JOIN part ON p_partkey = k WHERE page_id = 'good_list') w
GROUP BY 1, 2, 3""",
    "measure_unpivot": """WITH m AS (
  SELECT user_id, count(*) FILTER (event_type = 'click') AS click_ct,
    count(*) FILTER (event_type = 'purchase') AS cart_ct,
    count(*) FILTER (event_type = 'signup') AS order_ct
  FROM events GROUP BY user_id)
SELECT user_id, click_ct AS ct, 'CLICK' AS source FROM m WHERE click_ct > 0
UNION ALL SELECT user_id, cart_ct, 'CART' FROM m WHERE cart_ct > 0
UNION ALL SELECT user_id, order_ct, 'ORDER' FROM m WHERE order_ct > 0""",
    "product_keywords": _with(*PRODUCT_CTES)
    + """SELECT keyword, ct, source, stt, edt FROM (
  SELECT unnest(regexp_extract_all(lower(spu_name), '[\\p{L}\\p{N}]+')) AS keyword,
         stt, edt, click_ct, cart_ct, order_ct FROM pstats) w,
  LATERAL (VALUES (click_ct, 'CLICK'), (cart_ct, 'CART'), (order_ct, 'ORDER')) AS m(ct, source)
WHERE ct > 0""",
    "scalar_time_functions": f"""SELECT event_id, strftime(ts, '{SECOND}') AS second_text,
  strftime(ts, '%Y-%m-%d') AS day_text, strftime(date_trunc('second', ts), '{SECOND}') AS from_epoch,
  strftime(ts, '{SECOND}') AS round_trip,
  epoch_ms(date_trunc('second', ts)) - 28800000 AS ms_plus8, strftime(ts, '%Y%m%d') AS day_key,
  epoch_ms(date_trunc('second', ts)) AS ms_session
FROM events""",
}
