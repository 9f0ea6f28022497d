"""Interval joins, dimension lookups and a lookup that survives hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamhouse.functions.times import interval_ms


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Column,
    left_time: str,
    right_time: str,
    lower_ms: int,
    upper_ms: int,
    slots: bool = False,
) -> DataFrame:
    """Inner join on ``on`` where right time lies in [left + lower, left + upper].

    Both times are timestamps. On streams both inputs need a watermark on them. ``on`` holds
    an equality, so batch input runs as a shuffle join whose hot partitions AQE splits.

    AQE splits one side of a hot key, so each of its rows still meets all of the other. With ``slots`` (batch only) time is cut
    into slots as wide as the interval, which are part of the key; the right side has each row in two of them. Use it where a key is hot
    on both sides: then its rows meet those near them in time only. It costs a second copy of the right rows.
    """
    low = F.col(left_time) + interval_ms(lower_ms)
    high = F.col(left_time) + interval_ms(upper_ms)
    in_reach = (F.col(right_time) >= low) & (F.col(right_time) <= high)
    if not slots:
        return left.join(right, on & in_reach, "inner")
    width = max(upper_ms - lower_ms, 1)
    first = F.floor((F.unix_millis(left_time) + lower_ms) / width)
    own = F.floor(F.unix_millis(right_time) / width)
    near = left.withColumn("__slot", first)
    copies = right.withColumn("__right_slot", F.explode(F.array(own, own - 1)))
    met = near.join(copies, on & (F.col("__slot") == F.col("__right_slot")) & in_reach, "inner")
    return met.drop("__slot", "__right_slot")


def dim_join(
    df: DataFrame, dim: DataFrame, on: Mapping[str, str], columns: Mapping[str, Column]
) -> DataFrame:
    """Left lookup: add ``columns`` of the dimension row; a missing row leaves nulls.

    ``on`` maps input columns to dimension columns, unique together in ``dim``. There is no
    broadcast hint: the dimension is broadcast when its size, as planned or as measured at
    run time, is below the session's threshold, and shuffled otherwise.
    """
    keys = {f"__{i}": dim_key for i, dim_key in enumerate(on.values())}
    # One select: the added columns may carry the names of the keys.
    lookup = dim.select(
        *[F.col(c).alias(k) for k, c in keys.items()],
        *[c.alias(name) for name, c in columns.items()],
    )
    condition = [
        F.col(mine) == F.col(k) for mine, k in zip(on, keys, strict=True)
    ]
    return df.join(lookup, condition, "left").drop(*keys)


def first_per_key(dim: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key set. Batch only.

    The rank filter is applied in the map tasks already, so a busy key shuffles one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return dim.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def keyed_lookup(df: DataFrame, key: str, aggregate: Mapping[str, Column]) -> DataFrame:
    """Attach per-key aggregates to every row; null keys get nulls. Batch only.

    The aggregate is combined in the map tasks. The rows of a hot key meet one row of it in a
    shuffle join, whose hot partitions AQE splits. It can only split a join that has shuffles of
    its own on both sides, so the aggregate is shuffled again, by one more key that is always 0.
    """
    names = list(aggregate)
    totals = df.groupBy(F.col(key).alias("__key")).agg(*[c.alias(name) for name, c in aggregate.items()])
    zero = lambda c: F.pmod(F.xxhash64(c), F.lit(1))
    found = totals.withColumn("__zero", zero("__key"))
    on = (F.col(key) == F.col("__key")) & (zero(key) == F.col("__zero"))
    return df.join(found, on, "left").select(*df.columns, *names)
