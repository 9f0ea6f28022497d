"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from streamhouse.functions import times
from streamhouse.functions.measures import unpivot_measures
from streamhouse.functions.texts import explode_keywords, to_json_value
from streamhouse.operators import cdc, keyword, logs, product, province, visitor, visits, wide
from streamhouse.operators.joins import dim_join, first_per_key
from streamhouse.plans.inputs import DAY_MS, SESSION_GAP_MS, Inputs
from streamhouse.schemas import CDC, ORDER_WIDE, layout
from streamhouse.session import tune

AS_OF = "2024-01-01 00:00:00"
PRODUCT_WIDTH = "30 days"
HOUR = "1 hour"
EVENT_PROPS = layout(k=IntegerType())

Query = Callable[[Inputs], DataFrame]


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def json_parse(t: Inputs) -> DataFrame:
    """Event properties, with a stray character on error events: parsed rows and unparsable rows."""
    raw = t.table("events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), "props"))
        .otherwise(F.col("props"))
        .alias("value"),
    )
    good, bad = logs.parse_json(raw, EVENT_PROPS, keep=("event_id",))
    return good.select(
        "event_id", F.col("k").cast("bigint").alias("k"), F.lit(0).alias("is_bad")
    ).unionByName(
        bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(1).alias("is_bad"))
    )


def _changes(t: Inputs) -> DataFrame:
    return cdc.clean(logs.parse_json(t.change_values(), CDC).good)


def _routed(t: Inputs) -> DataFrame:
    return cdc.route(_changes(t), cdc.load_routes(t.routes()))


def cdc_clean(t: Inputs) -> DataFrame:
    return _changes(t).groupBy("table", "type").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("data")).alias("fields")
    )


def cdc_route(t: Inputs) -> DataFrame:
    """Facts and dimensions in one pass, told apart by their sink type."""
    return _routed(t).select(
        "table", "type", "sink_type", "sink_table", F.col("data")[F.col("sink_pk")].alias("pk")
    )


def cdc_prune_columns(t: Inputs) -> DataFrame:
    return _routed(t).select(
        "sink_table",
        F.array_join(F.array_sort(F.map_keys("data")), ",").alias("kept"),
        F.col("data")[F.col("sink_pk")].alias("pk"),
    )


def dim_upsert_latest(t: Inputs) -> DataFrame:
    current = t.table("customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        "c_name",
        F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"),
        "c_mktsegment",
    )
    dim = cdc.upsert(
        current,
        t.customer_changes(),
        "c_custkey",
        current.columns,
        F.struct("o_orderdate", "o_orderkey"),
    )
    return _double(dim, "c_acctbal")


def dim_lookup_multi_key(t: Inputs) -> DataFrame:
    """First finished order of each customer, looked up by customer and status."""
    probe = t.table("customer").select("c_custkey", F.lit("F").alias("status"))
    first = first_per_key(
        t.table("orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"),
        ["o_custkey", "o_orderstatus"],
        [F.col("o_orderkey")],
    )
    return dim_join(
        probe,
        first,
        {"c_custkey": "o_custkey", "status": "o_orderstatus"},
        {"first_order": F.col("o_orderkey"), "first_total": F.col("o_totalprice")},
    )


def log_split_counts(t: Inputs) -> DataFrame:
    start, page, display = logs.split_logs(t.plain_log())
    counts = [
        df.select(F.lit(name).alias("output")).groupBy("output").agg(F.count(F.lit(1)).alias("records"))
        for name, df in (("start", start), ("page", page), ("display", display))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def display_explode(t: Inputs) -> DataFrame:
    return logs.explode_displays(t.plain_log(), keep=("ts",))


def new_visitor_repair(t: Inputs) -> DataFrame:
    fixed = logs.repair_new_visitors(t.plain_log())
    return fixed.select("common.mid", "ts", "common.is_new")


def unique_visit(t: Inputs) -> DataFrame:
    return visits.unique_visits(t.page_log()).select("mid", "dt", "ts", "page.page_id")


def bounce_detail(t: Inputs) -> DataFrame:
    return visits.bounces(t.page_log(), SESSION_GAP_MS).select("common.mid", "ts", "page.page_id")


def order_detail_interval_join(t: Inputs) -> DataFrame:
    joined = wide.join_order_detail(t.order_info(), t.shipped_detail(), (-5 * DAY_MS, 5 * DAY_MS))
    return joined.select(
        F.col("id").alias("order_id"),
        "detail_id",
        "create_time",
        "detail_create_time",
        F.col("split_total_amount").cast("double").alias("split_total_amount"),
    )


def user_age(t: Inputs) -> DataFrame:
    return t.dim_user().select(
        "ID", "BIRTHDAY", times.age_in_years(F.col("BIRTHDAY"), _as_of()).alias("user_age")
    )


_MONEY_COLUMNS = ("order_price", "total_amount", "split_total_amount")
_WIDE_COLUMNS = (
    "detail_id", "order_id", "sku_id", "order_price", "sku_num", "sku_name", "province_id",
    "order_status", "user_id", "total_amount", "split_total_amount", "create_time",
    "create_date", "create_hour", "province_name", "province_area_code", "province_iso_code",
    "province_3166_2_code", "user_age", "user_gender", "spu_id", "tm_id", "category3_id",
    "spu_name", "tm_name", "category3_name",
)


def _order_wide(t: Inputs) -> DataFrame:
    return wide.order_wide(t.order_info(province=True), t.order_detail(), t.dims(), _as_of())


def _bare_order_wide(t: Inputs) -> DataFrame:
    return wide.order_wide(t.order_info(), t.order_detail(), wide.Dims())


def order_wide(t: Inputs) -> DataFrame:
    return _double(_order_wide(t).select(*_WIDE_COLUMNS), *_MONEY_COLUMNS)


def order_wide_json(t: Inputs) -> DataFrame:
    """The wide rows as JSON text, read back."""
    values = to_json_value(_order_wide(t).drop("event_time"))
    good = logs.parse_json(values, ORDER_WIDE).good
    return _double(good.select(*_WIDE_COLUMNS), *_MONEY_COLUMNS)


def order_wide_coalesce(t: Inputs) -> DataFrame:
    """Finished and open orders merged with finished and pending ones that fill their gaps."""
    orders = t.table("orders").select(
        F.col("o_orderkey").alias("detail_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("total_amount"),
        F.col("o_totalprice").alias("split_total_amount"),
    )
    left = orders.where(F.col("order_status").isin("F", "O"))
    right = orders.where(F.col("order_status").isin("F", "P")).withColumns(
        {"total_amount": F.lit(0.0), "order_status": F.lit("X")}
    )
    return wide.coalesce_wide(left, right)


def payment_wide(t: Inputs) -> DataFrame:
    joined = wide.payment_wide(t.payment_info(), _bare_order_wide(t))
    columns = (
        "payment_id", "subject", "payment_type", "payment_create_time", "callback_time",
        "detail_id", "order_id", "sku_id", "sku_num", "order_status", "user_id", "total_amount",
        "split_total_amount", "order_create_time",
    )
    return _double(joined.select(*columns), "total_amount", "split_total_amount")


def dim_left_outer_missing(t: Inputs) -> DataFrame:
    """Order lines against a product table that lacks most products."""
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    economy = t.table("part").where(F.col("p_type") == "ECONOMY")
    return dim_join(
        lines,
        economy,
        {"l_partkey": "p_partkey"},
        {"sku_name": F.col("p_name"), "sku_price": F.col("p_retailprice")},
    )


def visitor_stats(t: Inputs) -> DataFrame:
    log = logs.repair_new_visitors(t.page_log())
    return visitor.visitor_stats(
        log, visits.unique_visits(log), visits.bounces(log, SESSION_GAP_MS), HOUR
    )


def _product_stats(t: Inputs) -> DataFrame:
    orders = _bare_order_wide(t)
    log = t.shifted_log()
    return product.product_stats(
        log,
        t.as_products(orders),
        t.as_products(wide.payment_wide(t.payment_info(), orders)),
        t.event_facts("click"),
        t.event_facts("purchase"),
        t.as_products(t.refunds()),
        t.as_products(t.comments()),
        t.dims("sku", "spu", "trademark", "category3"),
        PRODUCT_WIDTH,
    )


def product_stats(t: Inputs) -> DataFrame:
    return _double(_product_stats(t), "sku_price", *product.AMOUNTS)


def province_stats(t: Inputs) -> DataFrame:
    rows = wide.order_wide(t.order_info(province=True), t.order_detail(), t.dims("province"))
    return _double(province.province_stats(rows), "order_amount")


def keyword_explode(t: Inputs) -> DataFrame:
    words = explode_keywords(t.table("documents").select("doc_id", "text"), "text")
    return words.select("doc_id", "keyword")


def keyword_search(t: Inputs) -> DataFrame:
    return keyword.search_keywords(t.page_view(), HOUR)


def measure_unpivot(t: Inputs) -> DataFrame:
    def times_of(kind: str):
        return F.count_if(F.col("event_type") == kind)

    measures = t.table("events").groupBy("user_id").agg(
        times_of("click").alias("click_ct"),
        times_of("purchase").alias("cart_ct"),
        times_of("signup").alias("order_ct"),
    )
    return unpivot_measures(measures)


def product_keywords(t: Inputs) -> DataFrame:
    return keyword.product_keywords(_product_stats(t))


def scalar_time_functions(t: Inputs) -> DataFrame:
    events = t.table("events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    ms = F.unix_millis("at")
    text = times.to_second_text(F.col("at"))
    return events.select(
        "event_id",
        text.alias("second_text"),
        F.date_format(text, "yyyy-MM-dd").alias("day_text"),
        times.from_epoch_seconds(F.expr("unix_millis(at) div 1000")).alias("from_epoch"),
        times.to_second_text(F.to_timestamp(text)).alias("round_trip"),
        times.to_epoch_ms(text, "+08:00").alias("ms_plus8"),
        times.day_of(ms).alias("day_key"),
        times.to_epoch_ms(text).alias("ms_session"),
    )


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        json_parse,
        cdc_clean,
        cdc_route,
        cdc_prune_columns,
        dim_upsert_latest,
        dim_lookup_multi_key,
        log_split_counts,
        display_explode,
        new_visitor_repair,
        unique_visit,
        bounce_detail,
        order_detail_interval_join,
        user_age,
        order_wide,
        order_wide_json,
        order_wide_coalesce,
        payment_wide,
        dim_left_outer_missing,
        visitor_stats,
        product_stats,
        province_stats,
        keyword_explode,
        keyword_search,
        measure_unpivot,
        product_keywords,
        scalar_time_functions,
    )
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Query ``name`` over the tables in ``folder``."""
    tune(spark, folder)
    return QUERIES[name](Inputs(spark, folder))
