"""Next or previous row of a key within a bounded time reach, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_FACTOR = 24


def with_neighbour(
    df: DataFrame,
    key: Column,
    ts_ms: Column,
    reach_ms: int,
    value: Column,
    name: str,
    forward: bool = True,
    ties: tuple[Column, ...] = (),
    slot_ms: int | None = None,
) -> DataFrame:
    """Add ``name``: ``value`` of the adjacent row of the same key, null if none is in reach.

    A neighbour counts when its distance is strictly below ``reach_ms``.

    Time is cut into slots no shorter than the reach, and rows near a slot border are copied
    into the slot that may look at them. A key is therefore spread over all its slots, and no
    task holds the whole history of a busy key; the copies are dropped again at the end.
    """
    slot = slot_ms or reach_ms * SLOT_FACTOR
    if slot < reach_ms:
        raise ValueError("slot must not be shorter than the reach")

    into_slot = F.pmod(ts_ms, F.lit(slot))
    own = ts_ms - into_slot
    near_border = into_slot < reach_ms if forward else F.lit(slot) - into_slot <= reach_ms
    other = own - slot if forward else own + slot

    def place(start: Column, copy: bool) -> Column:
        return F.struct(start.alias("slot"), F.lit(copy).alias("copy"))

    placed = df.select(
        "*",
        key.alias("__key"),
        ts_ms.alias("__ts"),
        value.alias("__value"),
        F.explode(
            F.when(near_border, F.array(place(own, False), place(other, True))).otherwise(
                F.array(place(own, False))
            )
        ).alias("__place"),
    )
    order = Window.partitionBy("__key", "__place.slot").orderBy("__ts", *ties)
    shift = F.lead if forward else F.lag
    distance = shift("__ts").over(order) - F.col("__ts")
    adjacent = F.when(F.abs(distance) < reach_ms, shift("__value").over(order))
    return (
        placed.withColumn(name, adjacent)
        .where(~F.col("__place.copy"))
        .drop("__key", "__ts", "__value", "__place")
    )
