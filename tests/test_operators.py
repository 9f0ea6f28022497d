"""Hand-made edge rows for the batch operators."""

from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamhouse import schemas as S
from streamhouse.functions import times
from streamhouse.functions.measures import unpivot_measures
from streamhouse.functions.texts import explode_keywords, is_blank, to_json_value
from streamhouse.operators import cdc, keyword, logs, product, province, visitor, visits, wide
from streamhouse.operators.joins import dim_join, interval_join, keyed_lookup
from streamhouse.operators.neighbours import with_neighbour

BASE = 1_700_000_000_000
DAY = 24 * 3600 * 1000


# -- logs -------------------------------------------------------------------------------


def test_parse_json_sends_bad_rows_aside(spark, rows):
    raw = spark.createDataFrame(
        [(1, '{"k": 1}'), (2, "{broken"), (3, None), (4, "{}")], "id int, value string"
    )
    good, bad = logs.parse_json(raw, S.layout(k=S.LONG), keep=("id",))
    assert rows(good) == [(1, 1), (4, None)]
    assert rows(bad, "id") == [(2,), (3,)]


def test_split_logs(log, logs_of, rows):
    df = logs_of(
        [
            log("absent", 1),
            log("empty", 2, start={}),
            log("filled", 3, start={"entry": "icon"}, displays=[{"item_type": "x", "item": "0"}]),
            log("none", 4, displays=[]),
            log("two", 5, page_id="p", displays=[{"item_type": "a", "item": "1"}, {"item_type": "b", "item": "2"}]),
        ]
    )
    start, page, display = logs.split_logs(df)
    assert rows(start, "common.mid") == [("filled",)]
    assert rows(page, "common.mid") == [("absent",), ("empty",), ("none",), ("two",)]
    assert rows(display) == [("a", "1", "p"), ("b", "2", "p")]
    assert start.count() + page.count() == df.count()


def test_new_visitor_repair(log, logs_of, rows):
    df = logs_of(
        [
            log("a", BASE), log("a", BASE + 1), log("a", BASE + DAY),
            log("a", BASE + DAY + 1, is_new="0"), log("b", BASE + DAY),
            log("c", BASE, is_new="0"), log("c", BASE + DAY), log(None, BASE), log(None, BASE + DAY),
        ]
    )
    fixed = logs.repair_new_visitors(df)
    assert rows(fixed, "common.mid", "ts", "common.is_new") == sorted(
        [
            ("a", BASE, "1"), ("a", BASE + 1, "1"), ("a", BASE + DAY, "0"),
            ("a", BASE + DAY + 1, "0"), ("b", BASE + DAY, "1"), ("c", BASE, "0"),
            ("c", BASE + DAY, "1"), (None, BASE, "1"), (None, BASE + DAY, "1"),
        ],
        key=repr,
    )


def third_hot(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )


@pytest.fixture
def no_size_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def final_plan(df):
    """The executed plan after adaptive re-planning."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    return query.executedPlan().toString().split("Initial Plan")[0]


SMALL_SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture
def small_skew(spark, no_size_broadcast):
    for k, v in SMALL_SKEW.items():
        spark.conf.set(k, v)
    yield
    for k in SMALL_SKEW:
        spark.conf.unset(k)


def test_keyed_lookup_splits_the_hot_key(spark, rows, small_skew):
    df = third_hot(spark, 90_000).repartition(8)
    out = keyed_lookup(df, "k", {"low": F.min("id"), "n": F.count("id")})
    assert "skew=true" in final_plan(out)
    assert out.where("k = 'hot'").select("low", "n").distinct().collect() == [(0, 30_000)]
    assert out.where("k <> 'hot' and (low <> id or n <> 1)").count() == 0 and out.count() == 90_000


def test_hot_order_is_split(spark, small_skew):
    """A third of all lines belong to one order: the join splits it, the counts stay exact."""
    sales = orders(spark, [(i, 5, i % 7, AT) for i in range(3_000)])
    ids = spark.range(60_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3_000).alias("order_id"),
        (F.col("id") % 50).alias("sku_id"),
        F.lit(0).alias("ms"),
    )
    amount = (F.rand(1) * 1_000).cast(S.MONEY)
    lines = details(spark, ids).withColumn("split_total_amount", amount)
    wide_rows = wide.order_wide(sales, lines.repartition(8), wide.Dims())
    stats = province.province_stats(wide_rows)
    assert "skew=true" in final_plan(stats)
    totals = stats.agg(F.sum("order_count"), F.sum("order_amount")).first()
    kept = lines.join(sales.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    assert tuple(totals) == (
        kept.select("order_id").distinct().count(),
        kept.agg(F.sum("split_total_amount")).first()[0],
    )


def test_interval_join_by_slots(spark, rows):
    """The same rows, ties and borders included, with one key that is hot on both sides; pairs grow with the rows."""
    chance = random.Random(6)
    at = lambda: chance.choice([None, *range(-3_000_000, 3_000_000, 500)])
    make = lambda n, name: spark.createDataFrame([(i, 0 if i % 2 else i % 5, at()) for i in range(n)], f"{name}_id long, {name}_key long, {name}_ms long").withColumn(f"{name}_at", F.timestamp_millis(f"{name}_ms"))
    left, right = make(600, "l"), make(700, "r")
    for low, high in ((-5_000, 5_000), (-900_000, 0), (1_000, 1_000), (0, 250_000)):
        joined = [interval_join(left, right, F.col("l_key") == F.col("r_key"), "l_at", "r_at", low, high, slots) for slots in (False, True)]
        assert joined[0].columns == joined[1].columns
        assert rows(joined[1], "l_id", "r_id") == rows(joined[0], "l_id", "r_id")
    n = 20_000
    hot = lambda name: spark.range(n).select(F.col("id").alias(f"{name}_id"), F.lit(1).alias(f"{name}_key"), F.timestamp_millis(F.col("id") * 1_000).alias(f"{name}_at"))
    met = interval_join(hot("l"), hot("r"), F.col("l_key") == F.col("r_key"), "l_at", "r_at", -5_000, 5_000, slots=True)
    assert met.count() == 11 * n - 30
    assert re.search(r"__slot", final_plan(met))


def test_hot_sku_lookup_is_split(spark, small_skew):
    lines = spark.range(6_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("sku_id"), "id"
    )
    dim = spark.range(6_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
    out = dim_join(lines.repartition(8), dim.repartition(8), {"sku_id": "k"}, {"sku_name": F.col("name")})
    assert "skew=true" in final_plan(out)
    assert out.where("sku_name is null").count() == 0
    assert out.count() == 6_000


def test_hot_device_is_spread_over_time(spark, no_size_broadcast):
    """No window group holds more than one slot of a device."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 1_000 + BASE).alias("ts"))
    out = with_neighbour(df, F.col("k"), F.col("ts"), 10_000, F.lit(True), "next")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    counts = out.groupBy(F.spark_partition_id()).agg(F.count("ts").alias("n"), F.count("next"))
    sizes = [r.n for r in counts.collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) == 4 and max(sizes) < 10_000
    assert out.where("next is null").count() == 1


def test_unique_visit(log, logs_of, rows):
    df = logs_of(
        [
            log("a", BASE, last=None), log("a", BASE + 1, last=""), log("a", BASE - 5, last="home"),
            log("a", BASE + DAY), log("a", BASE - 9), log("b", BASE + DAY), log("b", BASE),
        ]
    )
    assert rows(visits.unique_visits(df), "mid", "ts") == [
        ("a", BASE - 9), ("a", BASE + DAY), ("b", BASE), ("b", BASE + DAY),
    ]


def test_unique_visit_ignores_order_and_repeats(log, logs_of, rows):
    records = [log(m, BASE + i * 7_000_000) for i, m in enumerate("abcabcabca")]
    once = rows(visits.unique_visits(logs_of(records)), "mid", "dt", "ts")
    assert rows(visits.unique_visits(logs_of(records[::-1])), "mid", "dt", "ts") == once
    again = visits.unique_visits(logs_of(records)).drop("mid", "dt")
    assert rows(visits.unique_visits(again), "mid", "dt", "ts") == once


def test_bounce_edges(log, logs_of, rows):
    df = logs_of(
        [
            log("single", BASE),
            log("short", BASE), log("short", BASE + 9_999, last="home"),
            log("exact", BASE), log("exact", BASE + 10_000, last="home"),
            log("starts", BASE), log("starts", BASE + 5_000),
            log("nopage", BASE), log("nopage", BASE + 1_000, page_id=None, last="home"),
            log("same", BASE), log("same", BASE),
            log("inner", BASE, last="home"),
            log("tied", BASE), log("tied", BASE, last="home"),
        ]
    )
    assert rows(visits.bounces(df), "common.mid", "ts") == [
        ("exact", BASE), ("same", BASE), ("single", BASE), ("starts", BASE + 5_000),
    ]


def walk(records, within):
    """Bounces by following each device's rows in order."""
    found, waiting = [], {}
    for mid, ts, first in sorted(records):
        start = waiting.pop(mid, None)
        if start is not None and ts - start >= within:
            found.append((mid, start))
        if first:
            waiting[mid] = ts
    return sorted(found + [(m, t) for m, t in waiting.items()])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 120), st.booleans()), max_size=40,
             unique_by=lambda r: r[:2]),
    st.sampled_from([10, 25, 1000]),
)
def test_bounce_equals_a_walk(log, logs_of, rows, records, slot):
    if not records:
        return
    df = logs_of([log(m, BASE + t, last=None if f else "home") for m, t, f in records])
    got = rows(visits.bounces(df, within_ms=10, slot_ms=slot), "common.mid", "ts")
    assert got == [(m, BASE + t) for m, t in walk(records, 10)]


# -- change records ---------------------------------------------------------------------


def changes(spark, records):
    raw = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return logs.parse_json(raw, S.CDC).good


ROUTES = [
    ("t", "insert", "kafka", "dwd_t", "id,a", "id", None),
    ("all", "insert", "kafka", "dwd_all", "", "id", None),
    ("dim", "insert", "hbase", "dim_t", "id,a", None, None),
    ("ck", "insert", "clickhouse", "x", "id", "id", None),
]


def test_cdc_clean(spark, rows):
    df = changes(
        spark,
        [
            {"table": None, "type": "insert", "data": {"a": 1}},
            {"table": "no_data", "type": "insert"},
            {"table": "empty", "type": "insert", "data": {}},
            {"table": "good", "type": "insert", "data": {"a": 1}},
        ],
    )
    assert rows(cdc.clean(df), "table") == [("good",)]


def test_cdc_route(spark, rows):
    routes = cdc.load_routes(spark.createDataFrame(ROUTES, S.ROUTES))
    data = {"id": 1, "a": 2, "b": 3}
    df = changes(
        spark,
        [
            {"table": t, "type": k, "data": data}
            for t, k in (
                ("t", "bootstrap-insert"), ("t", "delete"), ("all", "insert"), ("dim", "insert"),
                ("ck", "insert"), ("unknown", "insert"),
            )
        ],
    )
    facts, dims = cdc.split_routed(cdc.route(df, routes))
    text = F.to_json("data").alias("data")
    assert rows(facts, "table", "type", "sink_table", text) == [
        ("all", "insert", "dwd_all", '{"id":"1","a":"2","b":"3"}'),
        ("t", "insert", "dwd_t", '{"id":"1","a":"2"}'),
    ]
    assert rows(dims, "sink_table", text) == [("dim_t", '{"id":"1","a":"2"}')]


def test_routes_must_not_be_empty(spark):
    with pytest.raises(ValueError):
        cdc.load_routes(spark.createDataFrame([], S.ROUTES))


def test_last_route_of_a_key_counts(spark):
    twice = [ROUTES[0], ("t", "insert", "kafka", "newer", "id", "id", None)]
    routes = cdc.load_routes(spark.createDataFrame(twice, S.ROUTES))
    assert [r.sink_table for r in routes.collect()] == ["newer"]


def test_routes_stay_known_after_they_leave_the_table(spark):
    known = cdc.load_routes(spark.createDataFrame(ROUTES[:2], S.ROUTES))
    newer = [("t", "insert", "kafka", "newer", "id", "id", None)]
    routes = cdc.load_routes(spark.createDataFrame(newer, S.ROUTES), known)
    assert sorted(r.sink_table for r in routes.collect()) == ["dwd_all", "newer"]
    assert cdc.load_routes(spark.createDataFrame(newer, S.ROUTES), routes) is routes


def test_many_routes(spark):
    n = 20_000
    config = spark.range(n).selectExpr(
        "cast(id as string) source_table", "'insert' operate_type", "'kafka' sink_type",
        "concat('dwd_', id) sink_table", "'id' sink_columns", "'id' sink_pk", "cast(null as string) sink_extend",
    )
    gone = spark.createDataFrame(ROUTES[:1], S.ROUTES)
    routes = cdc.load_routes(config, cdc.load_routes(gone))
    assert routes.count() == n + 1
    df = changes(spark, [{"table": "19999", "type": "insert", "data": {"id": 1}}, {"table": "t", "type": "insert", "data": {"id": 2}}])
    assert sorted(r.sink_table for r in cdc.route(df, routes).collect()) == sorted(["dwd_19999", ROUTES[0][3]])


def test_records_of_a_hot_table_are_not_gathered(spark, tmp_path):
    """Records stay where they are while routes are small, whatever size the planner takes the records for."""
    routes = cdc.load_routes(spark.createDataFrame(ROUTES, S.ROUTES))
    data = F.create_map(F.lit("id"), F.col("id").cast("string"))
    spark.range(20_000).select(F.lit("all").alias("table"), F.lit("insert").alias("type"), data.alias("data")).write.parquet(f"{tmp_path}/r")
    routed = cdc.route(spark.read.parquet(f"{tmp_path}/r"), routes)
    plan = final_plan(routed)
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert routed.count() == 20_000


def test_a_hot_table_is_split_where_routes_are_many(spark, small_skew, monkeypatch):
    monkeypatch.setattr(cdc, "SMALL_ROUTES", 0)
    routes = cdc.load_routes(spark.createDataFrame(ROUTES, S.ROUTES))
    data = F.create_map(F.lit("id"), F.col("id").cast("string"))
    table = F.when(F.col("id") % 10 == 0, "t").otherwise("all")
    records = spark.range(40_000, numPartitions=8).select(table.alias("table"), F.lit("insert").alias("type"), data.alias("data"))
    routed = cdc.route(records, routes)
    assert "skew=true" in final_plan(routed)
    assert {r["sink_table"]: r["count"] for r in routed.groupBy("sink_table").count().collect()} == {"dwd_t": 4_000, "dwd_all": 36_000}


def test_dim_schemas(spark):
    tables = cdc.dim_schemas(spark.createDataFrame(ROUTES, S.ROUTES))
    assert list(tables) == ["DIM_T"]
    schema, pk = tables["DIM_T"]
    assert pk == "id"
    assert [(f.name, f.dataType.simpleString()) for f in schema.fields] == [
        ("id", "string"), ("a", "string"),
    ]


def test_upsert(spark, rows):
    current = spark.createDataFrame([("1", "old", "keep"), ("2", "x", "y")], "id string, a string, b string")
    writes = spark.createDataFrame(
        [({"id": "1", "a": "newest"}, 5), ({"id": "1", "a": "new"}, 3), ({"id": "3", "b": "z"}, 1),
         ({"id": "2", "a": None}, 2), ({"a": "no key"}, 9)],
        "data map<string,string>, at int",
    )
    want = [("1", "newest", "keep"), ("2", None, "y"), ("3", None, "z")]
    once = cdc.upsert(current, writes, "id", ["id", "a", "b"], F.col("at"))
    assert rows(once) == want
    assert rows(cdc.upsert(once, writes, "id", ["id", "a", "b"], F.col("at"))) == want
    assert rows(cdc.upsert(None, writes, "id", ["id", "a"], F.col("at"))) == [
        ("1", "newest"), ("2", None), ("3", None),
    ]


def test_upsert_has_one_rule_for_repeated_and_null_keys(spark, rows):
    current = spark.createDataFrame([("1", "a"), ("1", "b"), (None, "n"), ("2", "c")], "id string, a string")
    writes = spark.createDataFrame([({"id": "3", "a": "z"}, 1)], "data map<string,string>, at int")
    out = cdc.upsert(current, writes, "id", ["id", "a"], F.col("at"))
    assert [r[0] for r in rows(out)] == ["1", "2", "3"]


def test_unreadable_values_give_nulls(spark, rows):
    user = spark.createDataFrame([("1", "soon", "F"), ("x", "1990-01-01", "M")], "ID string, BIRTHDAY string, GENDER string")
    df = spark.createDataFrame([(1,), (2,)], "user_id long")
    out = wide.with_user(df, user, F.lit("2024-01-01").cast("timestamp"))
    assert rows(out, "user_id", "user_age", "user_gender") == [(1, None, "F"), (2, None, None)]


# -- wide tables ------------------------------------------------------------------------


def orders(spark, data):
    df = spark.createDataFrame(data, "id long, user_id long, province_id long, create_time string")
    df = df.withColumn("event_time", F.to_timestamp("create_time"))
    return df.withColumns({"order_status": F.lit("1001"), "total_amount": F.lit(9).cast(S.MONEY)})


def details(spark, data):
    """Details at milliseconds after a fixed second."""
    schema = "id long, order_id long, sku_id long, ms long"
    df = spark.createDataFrame(data, schema) if isinstance(data, list) else data
    at = F.timestamp_millis(F.lit(BASE) + F.col("ms"))
    return df.withColumns(
        {
            "event_time": at,
            "create_time": F.date_format(at, times.SECOND_PATTERN),
            "sku_name": F.lit("own"),
            "sku_num": F.lit(1),
            "order_price": F.lit(4).cast(S.MONEY),
            "split_total_amount": F.lit(4).cast(S.MONEY),
        }
    )


AT = "2023-11-14 22:13:20"


def test_interval_ends_are_included(spark, rows):
    lines = details(spark, [(i, 1, 1, ms) for i, ms in enumerate((-6, -5, 0, 5, 6))])
    joined = wide.join_order_detail(orders(spark, [(1, 5, 1, AT)]), lines)
    assert rows(joined, "detail_id") == [(1,), (2,), (3,)]


def dims(spark):
    return wide.Dims(
        user=spark.createDataFrame([("5", "1990-01-01", "F")], "ID string, BIRTHDAY string, GENDER string"),
        province=spark.createDataFrame(
            [("1", "North", "11", "N", "CN-N")],
            "ID string, NAME string, AREA_CODE string, ISO_CODE string, ISO_3166_2 string",
        ),
        sku=spark.createDataFrame(
            [("7", "Ring", "9.5", "70", None, "4")],
            "ID string, SKU_NAME string, PRICE string, SPU_ID string, CATEGORY3_ID string, TM_ID string",
        ),
        spu=spark.createDataFrame([("70", "Rings")], "ID string, SPU_NAME string"),
        trademark=spark.createDataFrame([("5", "Other")], "ID string, TM_NAME string"),
        category3=spark.createDataFrame([("3", "Jewels")], "ID string, NAME string"),
    )


def test_order_wide_keeps_rows_without_dimensions(spark, rows):
    sales = orders(spark, [(1, 5, 1, AT), (2, 6, None, AT)])
    lines = details(spark, [(11, 1, 7, 0), (21, 2, 8, 0)])
    as_of = F.lit("2023-11-14").cast("timestamp")
    full = wide.order_wide(sales, lines, dims(spark), as_of)
    assert full.columns == [*S.ORDER_WIDE.fieldNames(), "event_time"]
    assert rows(
        full, "detail_id", "user_age", "user_gender", "province_name", "sku_name", "spu_name",
        "tm_id", "tm_name", "category3_id", "category3_name", "create_date", "create_hour",
    ) == [
        (11, 33, "F", "North", "Ring", "Rings", 4, None, None, None, "2023-11-14", "22"),
        (21, None, None, None, "own", None, None, None, None, None, "2023-11-14", "22"),
    ]
    bare = wide.order_wide(sales, lines, wide.Dims()).drop("event_time")
    after = wide.enrich_order_wide(bare, dims(spark), as_of)
    assert rows(after) == rows(full.drop("event_time"))


def test_user_age_steps_every_365_days(spark, rows):
    born = spark.createDataFrame([("2000-01-01",)], "b string")
    ages = [
        born.select(times.age_in_years(F.col("b"), F.lit(day).cast("timestamp"))).first()[0]
        for day in ("2000-12-30", "2000-12-31", "2001-01-01")
    ]
    assert ages == [0, 1, 1]


def test_payment_wins(spark, rows):
    sales = wide.order_wide(
        orders(spark, [(1, 5, 1, AT)]), details(spark, [(11, 1, 7, 0)]), wide.Dims()
    )
    pay = spark.createDataFrame(
        [(90, 1, 6, "s", "1101", 0), (91, 1, 6, "s", "1101", 1_800_000), (92, 1, 6, "s", "1101", 1_800_001),
         (93, 1, 6, "s", "1101", -1)],
        "id long, order_id long, user_id long, subject string, payment_type string, ms long",
    ).withColumns(
        {
            "event_time": F.timestamp_millis(F.lit(BASE) + F.col("ms")),
            "create_time": F.lit("p"),
            "callback_time": F.lit("c"),
            "total_amount": F.lit(31).cast(S.MONEY),
        }
    )
    out = wide.payment_wide(pay, sales)
    assert out.columns == [*S.PAYMENT_WIDE.fieldNames(), "event_time"]
    assert rows(
        out, "payment_id", "user_id", F.col("total_amount").cast("int"), "payment_create_time", "order_create_time"
    ) == [(90, 6, 31, "p", AT), (91, 6, 31, "p", AT)]


def test_coalesce_wide(spark, rows):
    schema = "detail_id long, order_status string, user_id long, split_total_amount double"
    left = spark.createDataFrame([(1, None, 5, None), (2, "a", None, 1.0)], schema)
    right = spark.createDataFrame([(1, "b", 6, 2.0), (3, "c", 7, 3.0)], schema)
    assert rows(wide.coalesce_wide(left, right)) == [
        (1, "b", 5, None), (2, "a", None, 1.0), (3, "c", 7, None),
    ]


def test_dim_join_keeps_names_apart(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id long, name string")
    dim = spark.createDataFrame([(1, "dim")], "id long, name string")
    out = dim_join(df, dim, {"id": "id"}, {"dim_name": F.col("name")})
    assert rows(out) == [(1, "x", "dim"), (2, "y", None), (None, "z", None)]


# -- statistics -------------------------------------------------------------------------


def test_visitor_stats(log, logs_of, rows):
    page = logs_of([log("a", BASE), log("a", BASE + 9_000, last="home"), log("a", BASE + 11_000, last="x")])
    out = visitor.visitor_stats(page, visits.unique_visits(page), visits.bounces(page))
    assert rows(out, "stt", "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum") == [
        ("2023-11-14 22:13:20", 1, 2, 1, 0, 200), ("2023-11-14 22:13:30", 0, 1, 0, 0, 100),
    ]


def sale(spark, data):
    return spark.createDataFrame(
        data, "sku_id long, order_id long, sku_num long, split_total_amount decimal(18,2), create_time string"
    )


def test_product_orders_are_counted_once(spark, rows):
    from decimal import Decimal as D

    df = sale(spark, [(1, 10, 2, D("1.50"), AT), (1, 10, 1, D("2.50"), AT), (1, 11, 1, D("1.00"), AT),
                      (2, 12, 5, D("3.00"), AT), (1, None, 7, D("1.00"), AT)])
    out = product.product_totals([product.order_measures(df)])
    assert rows(out, "sku_id", "order_ct", "order_sku_num", F.col("order_amount").cast("double"), "click_ct") == [
        (1, 2, 11, 6.0, 0), (2, 1, 5, 3.0, 0),
    ]


def test_province_stats(spark, rows):
    data = [(1, "North", 10, 1.5), (1, "North", 10, 1.5), (1, "North", 11, 1.0), (None, None, 12, 2.0)]
    df = spark.createDataFrame(data, "province_id long, province_name string, order_id long, a double").withColumns(
        {
            "split_total_amount": F.col("a").cast(S.MONEY),
            "create_time": F.lit(AT),
            "province_area_code": F.lit("11"),
            "province_iso_code": F.lit("N"),
            "province_3166_2_code": F.lit("CN-N"),
        }
    )
    out = province.province_stats(df)
    assert rows(out, "province_name", "order_count", F.col("order_amount").cast("double"), "edt", "iso_3166_2") == [
        ("North", 2, 4.0, "2023-11-14 22:13:30", "CN-N"), (None, 1, 2.0, "2023-11-14 22:13:30", "CN-N"),
    ]


def test_unpivot(spark, rows):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 3, 0), (3, 1, 0, 2)], "id int, click_ct long, cart_ct long, order_ct long")
    assert rows(unpivot_measures(df)) == [(2, 3, "CART"), (3, 1, "CLICK"), (3, 2, "ORDER")]


def test_keywords(spark, rows):
    df = spark.createDataFrame([(1, "Red RING, 红 戒指 2x"), (2, "--"), (3, None)], "id int, text string")
    assert rows(explode_keywords(df, "text"), "id", "keyword") == [
        (1, "2x"), (1, "red"), (1, "ring"), (1, "戒指"), (1, "红"),
    ]


def test_search_keywords(spark, rows):
    df = spark.createDataFrame(
        [({"page_id": "good_list", "item": "Red ring"}, BASE), ({"page_id": "good_list", "item": "ring"}, BASE + 9_999),
         ({"page_id": "good_list"}, BASE), ({"page_id": "home", "item": "ring"}, BASE)],
        "page map<string,string>, ts long",
    )
    assert rows(keyword.search_keywords(df), "keyword", "ct", "source", "stt") == [
        ("red", 1, "SEARCH", AT), ("ring", 2, "SEARCH", AT),
    ]


# -- functions --------------------------------------------------------------------------


def test_times(spark):
    row = spark.range(1).select(
        times.to_epoch_ms(F.lit("2023-11-15 06:13:20"), "+08:00").alias("plus8"),
        times.to_epoch_ms(F.lit(AT)).alias("utc"),
        times.day_of(F.lit(BASE)).alias("day"),
        times.from_epoch_seconds(F.lit(BASE // 1000)).alias("text"),
        is_blank(F.lit("")).alias("empty"),
        is_blank(F.lit(None).cast("string")).alias("null"),
        is_blank(F.lit("x")).alias("filled"),
    ).first()
    assert tuple(row) == (BASE, BASE, "20231114", AT, True, True, False)


def test_json_leaves_nulls_out(spark, rows):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert rows(to_json_value(df)) == [('{"a":1}',)]
