"""Product statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse import constants as C
from streamhouse.functions.times import created_at, event_time
from streamhouse.operators.joins import dim_join
from streamhouse.operators.wide import Dims, sku_snowflake
from streamhouse.operators.windows import WINDOW, carried, count_once, tumble, with_watermark

COUNTS = (
    "display_ct",
    "click_ct",
    "favor_ct",
    "cart_ct",
    "order_sku_num",
    "order_ct",
    "paid_order_ct",
    "refund_order_ct",
    "comment_ct",
    "good_comment_ct",
)
AMOUNTS = ("order_amount", "payment_amount", "refund_amount")
SUM_TYPE = "decimal(28,2)"


def _at(text: str) -> Column:
    return F.try_to_timestamp(F.col(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def _branch(df: DataFrame, **measures: Column) -> DataFrame:
    """Shape of the union: event time, SKU and all measures, zero where not given."""
    return df.select(
        "event_time",
        *carried(df),
        F.col("sku_id").try_cast("bigint").alias("sku_id"),
        *[measures.get(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        *[measures.get(c, F.lit(0)).cast(SUM_TYPE).alias(c) for c in AMOUNTS],
    )


def page_measures(page_log: DataFrame, delay: str = "0 seconds", beat: DataFrame | None = None) -> DataFrame:
    """A click per product page and a display per shown product, in one pass over the pages.

    On a stream every page moves the watermark on, not only those with products.
    """

    def hit(sku: Column, click: Column, display: Column) -> Column:
        return F.struct(
            sku.alias("sku_id"),
            F.coalesce(click, F.lit(False)).cast("int").alias("click"),
            F.coalesce(display, F.lit(False)).cast("int").alias("display"),
        )

    page = hit(F.col("page.item"), F.col("page.page_id") == C.PAGE_GOOD_DETAIL, F.lit(False))
    shown = F.transform(
        "displays", lambda d: hit(d["item"], F.lit(False), d["item_type"] == C.ITEM_TYPE_SKU)
    )
    hits = F.coalesce(F.concat(F.array(page), shown), F.array(page))
    stamped = page_log.withColumn("event_time", event_time(F.col("ts")))
    stamped = with_watermark(stamped, delay, beat=beat)
    counted = stamped.select(
        "event_time", F.inline(F.filter(hits, lambda h: h["click"] + h["display"] > 0))
    )
    return _branch(counted, click_ct=F.col("click"), display_ct=F.col("display"))


def favor_measures(favors: DataFrame) -> DataFrame:
    return _branch(favors.select(_at("create_time").alias("event_time"), "sku_id", *carried(favors)), favor_ct=F.lit(1))


def cart_measures(carts: DataFrame) -> DataFrame:
    return _branch(carts.select(_at("create_time").alias("event_time"), "sku_id", *carried(carts)), cart_ct=F.lit(1))


def comment_measures(comments: DataFrame) -> DataFrame:
    is_good = F.when(F.col("appraise") == C.APPRAISE["good"], 1).otherwise(0)
    rows = comments.select(
        _at("create_time").alias("event_time"), "sku_id", is_good.alias("good"), *carried(comments)
    )
    return _branch(rows, comment_ct=F.lit(1), good_comment_ct=F.col("good"))


def _order_rows(df: DataFrame, at: Column, delay: str, beat: DataFrame | None, **columns: Column) -> DataFrame:
    rows = df.select(
        at.alias("event_time"), "sku_id", "order_id",
        *[c.alias(name) for name, c in columns.items()],
        *carried(df),
    )
    return with_watermark(rows, delay, beat=beat)


def order_measures(
    orders: DataFrame, width: str = WINDOW, delay: str = "0 seconds", beat: DataFrame | None = None
) -> DataFrame:
    rows = _order_rows(
        orders, created_at(orders), delay, beat, num=F.col("sku_num"), amount=F.col("split_total_amount")
    )
    sums = {"num": "num", "amount": "amount"}
    once = count_once(rows, ["sku_id"], "order_id", "orders", sums, width)
    return _branch(
        once,
        order_ct=F.col("orders"),
        order_sku_num=F.col("num"),
        order_amount=F.col("amount"),
    )


def payment_measures(
    payments: DataFrame, width: str = WINDOW, delay: str = "0 seconds", beat: DataFrame | None = None
) -> DataFrame:
    rows = _order_rows(
        payments, _at("payment_create_time"), delay, beat, amount=F.col("split_total_amount")
    )
    once = count_once(rows, ["sku_id"], "order_id", "orders", {"amount": "amount"}, width)
    return _branch(once, paid_order_ct=F.col("orders"), payment_amount=F.col("amount"))


def refund_measures(
    refunds: DataFrame, width: str = WINDOW, delay: str = "0 seconds", beat: DataFrame | None = None
) -> DataFrame:
    rows = _order_rows(refunds, created_at(refunds), delay, beat, amount=F.col("refund_amount"))
    once = count_once(rows, ["sku_id"], "order_id", "orders", {"amount": "amount"}, width)
    return _branch(once, refund_order_ct=F.col("orders"), refund_amount=F.col("amount"))


def product_totals(
    branches: list[DataFrame], width: str = WINDOW, delay: str = "0 seconds", beat: DataFrame | None = None
) -> DataFrame:
    """Sums of all measure branches per window and SKU."""
    if any(b.isStreaming for b in branches):
        branches = [_marked(b, delay, beat) for b in branches]
    union = reduce(DataFrame.unionByName, branches)
    return tumble(union, ["sku_id"], [F.sum(c).alias(c) for c in (*COUNTS, *AMOUNTS)], width)


def _marked(branch: DataFrame, delay: str, beat: DataFrame | None) -> DataFrame:
    """The branch with a watermark, unless it already has one."""
    if branch.schema["event_time"].metadata:
        return branch
    return with_watermark(branch, delay, beat=beat)


def with_product_dims(totals: DataFrame, dims: Dims) -> DataFrame:
    """Look the SKU and its related names up once per window, after the aggregation."""
    columns = ("spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name")
    return dim_join(
        totals,
        sku_snowflake(dims),
        {"sku_id": "dim_sku_id"},
        {
            "sku_name": F.col("dim_sku_name"),
            "sku_price": F.col("dim_sku_price"),
            **{c: F.col(c) for c in columns},
        },
    )


def product_stats(
    page_log: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    favors: DataFrame,
    carts: DataFrame,
    refunds: DataFrame,
    comments: DataFrame,
    dims: Dims,
    width: str = WINDOW,
) -> DataFrame:
    """Displays, clicks, favours, carts, orders, payments, refunds and comments per SKU."""
    totals = product_totals(
        [
            page_measures(page_log),
            order_measures(orders, width),
            favor_measures(favors),
            cart_measures(carts),
            payment_measures(payments, width),
            refund_measures(refunds, width),
            comment_measures(comments),
        ],
        width,
    )
    return with_product_dims(totals, dims)
