"""Province statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.times import created_at
from streamhouse.operators.windows import WINDOW, carried, count_once, tumble, with_watermark

RENAMED = {
    "province_id": "province_id",
    "province_name": "province_name",
    "province_area_code": "area_code",
    "province_iso_code": "iso_code",
    "province_3166_2_code": "iso_3166_2",
}


def province_stats(
    order_wide: DataFrame, width: str = WINDOW, delay: str = "0 seconds"
) -> DataFrame:
    """Distinct orders and order amount per province and window of the order's creation."""
    rows = order_wide.select(
        created_at(order_wide).alias("event_time"),
        *[F.col(c).alias(out) for c, out in RENAMED.items()],
        "order_id",
        "split_total_amount",
        *carried(order_wide),
    )
    rows = with_watermark(rows, delay)
    keys = list(RENAMED.values())
    once = count_once(
        rows, keys, "order_id", "orders", {"amount": "split_total_amount"}, width
    )
    return tumble(
        once,
        keys,
        [F.sum("amount").alias("order_amount"), F.sum("orders").alias("order_count")],
        width,
    )
