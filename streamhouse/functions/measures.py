"""Row-shape helpers for measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamhouse import constants as C


def unpivot_measures(
    df: DataFrame, click: str = "click_ct", cart: str = "cart_ct", order: str = "order_ct"
) -> DataFrame:
    """One ``(ct, source)`` row per positive measure; the other columns are kept."""
    tagged = F.array(
        *[
            F.struct(F.col(name).cast("bigint").alias("ct"), F.lit(source).alias("source"))
            for name, source in (
                (click, C.KEYWORD_CLICK),
                (cart, C.KEYWORD_CART),
                (order, C.KEYWORD_ORDER),
            )
        ]
    )
    rest = [c for c in df.columns if c not in (click, cart, order)]
    return df.select(*rest, F.inline(F.filter(tagged, lambda m: m["ct"] > 0)))
