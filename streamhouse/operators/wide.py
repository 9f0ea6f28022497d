"""Order and payment wide tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.times import age_in_years
from streamhouse.operators.joins import dim_join, interval_join
from streamhouse.schemas import ORDER_WIDE, PAYMENT_WIDE

ORDER_REACH_MS = (-5, 5)
PAYMENT_REACH_MS = (-1_800_000, 0)

USER_COLUMNS = ("user_age", "user_gender")
PROVINCE_COLUMNS = (
    "province_name",
    "province_area_code",
    "province_iso_code",
    "province_3166_2_code",
)
SKU_COLUMNS = ("spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name")

# Merged by first non-null; split amounts and every other column keep the left value.
MERGED_COLUMNS = (
    "order_status",
    "create_time",
    "create_date",
    "coupon_reduce_amount",
    "activity_reduce_amount",
    "original_total_amount",
    "feight_fee",
    "total_amount",
    "user_id",
    "sku_id",
    "sku_name",
    "order_price",
    "sku_num",
)


@dataclass(frozen=True)
class Dims:
    """Dimension tables, all string columns. A table left out leaves its columns null."""

    user: DataFrame | None = None
    province: DataFrame | None = None
    sku: DataFrame | None = None
    spu: DataFrame | None = None
    trademark: DataFrame | None = None
    category3: DataFrame | None = None


def sku_snowflake(dims: Dims) -> DataFrame:
    """SKU rows with their SPU, trademark and category names.

    The dimensions are joined with each other, so that a fact table is looked up, and if
    need be shuffled, once by SKU instead of four times.
    """
    sku = dims.sku.select(
        F.col("ID").try_cast("bigint").alias("dim_sku_id"),
        F.col("SKU_NAME").alias("dim_sku_name"),
        F.col("PRICE").try_cast("decimal(18,2)").alias("dim_sku_price"),
        F.col("SPU_ID").try_cast("bigint").alias("spu_id"),
        F.col("TM_ID").try_cast("bigint").alias("tm_id"),
        F.col("CATEGORY3_ID").try_cast("bigint").alias("category3_id"),
    )
    for table, key, column, name in (
        (dims.spu, "spu_id", "SPU_NAME", "spu_name"),
        (dims.trademark, "tm_id", "TM_NAME", "tm_name"),
        (dims.category3, "category3_id", "NAME", "category3_name"),
    ):
        if table is None:
            sku = sku.withColumn(name, F.lit(None).cast("string"))
            continue
        typed = table.select(F.col("ID").try_cast("bigint").alias("dim_id"), column)
        sku = dim_join(sku, typed, {key: "dim_id"}, {name: F.col(column)})
    return sku


def with_user(df: DataFrame, user: DataFrame, as_of: Column) -> DataFrame:
    typed = user.select(F.col("ID").try_cast("bigint").alias("dim_id"), "BIRTHDAY", "GENDER")
    return dim_join(
        df,
        typed,
        {"user_id": "dim_id"},
        {"user_age": age_in_years(F.col("BIRTHDAY"), as_of), "user_gender": F.col("GENDER")},
    )


def with_province(df: DataFrame, province: DataFrame) -> DataFrame:
    typed = province.withColumn("dim_id", F.col("ID").try_cast("bigint"))
    names = ("NAME", "AREA_CODE", "ISO_CODE", "ISO_3166_2")
    return dim_join(
        df,
        typed,
        {"province_id": "dim_id"},
        {out: F.col(c) for out, c in zip(PROVINCE_COLUMNS, names, strict=True)},
    )


def with_sku(df: DataFrame, dims: Dims) -> DataFrame:
    """SKU columns; the SKU's own name replaces the one on the row when the SKU is known."""
    columns = {c: F.col(c) for c in SKU_COLUMNS}
    joined = dim_join(
        df,
        sku_snowflake(dims),
        {"sku_id": "dim_sku_id"},
        {"__sku_name": F.col("dim_sku_name"), **columns},
    )
    name = F.coalesce("__sku_name", "sku_name")
    return joined.withColumn("sku_name", name).drop("__sku_name")


def join_order_detail(
    orders: DataFrame, details: DataFrame, reach_ms: tuple[int, int] = ORDER_REACH_MS, slots: bool = False
) -> DataFrame:
    """Orders with their details created within the reach.

    Both sides need an ``event_time`` timestamp; on streams it carries the watermark. Detail
    columns that collide get the prefix ``detail_``.
    """
    taken = set(orders.columns)
    renamed = {c: f"detail_{c}" for c in details.columns if c in taken}
    detail = details.withColumnsRenamed(renamed)
    return interval_join(
        orders,
        detail,
        F.col("id") == F.col("order_id"),
        "event_time",
        "detail_event_time",
        *reach_ms,
        slots,
    )


def order_wide(
    orders: DataFrame,
    details: DataFrame,
    dims: Dims,
    as_of: Column | None = None,
    reach_ms: tuple[int, int] = ORDER_REACH_MS,
) -> DataFrame:
    """Order details merged with their order and looked-up dimensions, plus ``event_time``.

    User and province hang off the order and the SKU off the detail, so each is looked up on
    its own side, before the join multiplies and widens the rows. ``as_of`` is the day that
    ages are taken at, by default now.
    """
    if dims.user is not None:
        orders = with_user(orders, dims.user, as_of if as_of is not None else F.now())
    if dims.province is not None:
        orders = with_province(orders, dims.province)
    if dims.sku is not None:
        details = with_sku(details, dims)
    # Per order, not per line.
    orders = orders.withColumns(
        {
            "create_date": F.date_format("event_time", "yyyy-MM-dd"),
            "create_hour": F.date_format("event_time", "HH"),
        }
    )
    joined = join_order_detail(orders, details, reach_ms)
    present = set(joined.columns)
    merged = {"order_id": F.col("id")}
    return joined.select(
        *[
            merged.get(f.name, F.col(f.name) if f.name in present else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in ORDER_WIDE.fields
        ],
        "event_time",
    )


def enrich_order_wide(rows: DataFrame, dims: Dims, as_of: Column) -> DataFrame:
    """Order-wide rows with all dimensions looked up after the join, as streams need it."""
    bare = rows.drop(*USER_COLUMNS, *PROVINCE_COLUMNS, *SKU_COLUMNS)
    known = with_sku(with_province(with_user(bare, dims.user, as_of), dims.province), dims)
    return known.select(*ORDER_WIDE.fieldNames())


def payment_wide(
    payments: DataFrame, orders: DataFrame, reach_ms: tuple[int, int] = PAYMENT_REACH_MS, slots: bool = False
) -> DataFrame:
    """Payments merged with the order-wide rows of the half hour before, plus ``event_time``.

    Columns of both sides take the payment's value.
    """
    names = payments.columns
    pay = payments.select(*[F.col(c).alias(f"pay_{c}") for c in names])
    joined = interval_join(
        pay,
        orders,
        F.col("pay_order_id") == F.col("order_id"),
        "pay_event_time",
        "event_time",
        *reach_ms,
        slots,
    )
    merged = {
        "payment_id": F.col("pay_id"),
        "payment_create_time": F.col("pay_create_time"),
        "order_create_time": F.col("create_time"),
        **{c: F.col(f"pay_{c}") for c in PAYMENT_WIDE.fieldNames() if c in names},
    }
    return joined.select(
        *[
            merged.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in PAYMENT_WIDE.fields
        ],
        F.col("pay_event_time").alias("event_time"),
    )


def coalesce_wide(left: DataFrame, right: DataFrame, key: str = "detail_id") -> DataFrame:
    """Full join of two wide tables, first non-null value per merged column. Batch only."""
    names, others = left.columns, right.columns
    renamed = {c: f"__right_{c}" for c in others}
    joined = left.join(
        right.withColumnsRenamed(renamed), F.col(key) == F.col(f"__right_{key}"), "full"
    )
    both = [c for c in names if c in others and c in (key, *MERGED_COLUMNS)]
    return joined.select(
        *[
            F.coalesce(c, f"__right_{c}").alias(c) if c in both else F.col(c)
            for c in names
        ]
    )
