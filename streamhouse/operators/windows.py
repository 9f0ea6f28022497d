"""Tumbling windows with text bounds, and exact distinct counts that scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.times import to_second_text

WINDOW = "10 seconds"
#: The id that a record of an exactly-once topic carries.
RECORD = "_record"


def carried(df: DataFrame) -> list[str]:
    """The id column, for selects between a source and its watermark."""
    return [RECORD] if RECORD in df.columns else []


def pulse(inputs: Sequence[tuple[DataFrame, Column]], idle: str) -> DataFrame:
    """Event times of some inputs, set back by ``idle``: they move the watermark of a branch that has no rows of its own.

    Time comes from the data and not from a clock, so a job that reads old records again closes the same windows.
    """
    times = [df.select((time - F.expr(f"INTERVAL {idle}")).alias("event_time")) for df, time in inputs]
    return reduce(DataFrame.unionByName, times)


def with_watermark(df: DataFrame, delay: str, column: str = "event_time", beat: DataFrame | None = None) -> DataFrame:
    """The stream with a watermark; records with an id are let through once. Batch input stays as it is.

    With ``beat`` (see ``pulse``) the branch is never further behind than its times: a branch that is silent for
    longer no longer holds windows open, and rows that it brings later are late.

    A repeat has the event time of its first try. Within the watermark it is dropped by its id, whose state goes once the
    watermark has passed the record; behind the watermark it is late.
    """
    if not df.isStreaming:
        return df.drop(RECORD)
    if beat is None:
        marked = df.withWatermark(column, delay)
    else:
        both = df.withColumn("__beat", F.lit(False)).unionByName(
            beat.select(F.col("event_time").alias(column), F.lit(True).alias("__beat")), allowMissingColumns=True
        )
        # The time is part of the condition, or else the filter would be moved below the watermark.
        own = ~F.col("__beat") | F.col(column).isNull()
        marked = both.withWatermark(column, delay).where(own).drop("__beat")
    return marked.dropDuplicatesWithinWatermark([RECORD]).drop(RECORD) if RECORD in df.columns else marked


def tumble(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], width: str) -> DataFrame:
    """Aggregate per epoch-aligned window of ``event_time`` and keys; bounds become text."""
    totals = df.groupBy(F.window("event_time", width), *keys).agg(*aggs)
    return totals.select(
        to_second_text(F.col("window.start")).alias("stt"),
        to_second_text(F.col("window.end")).alias("edt"),
        *[c for c in totals.columns if c != "window"],
    )


def count_once(
    df: DataFrame,
    keys: Sequence[str],
    distinct: str,
    count: str,
    sums: Mapping[str, str],
    width: str,
) -> DataFrame:
    """Rows whose plain sums per window and ``keys`` give sums and an exact distinct count.

    ``sums`` maps output to input columns; ``count`` is 1 once per distinct value, else 0.
    Null values are not counted. No set of values is ever held in one place:

    * A batch is grouped by window, keys and value. This spreads a busy key over its values,
      and keeps the partitioning of input that is already partitioned by the value.
    * A stream is deduplicated on window, keys and value. Each seen value is a state row of
      its own that goes when its window closes.
    """
    if not df.isStreaming:
        placed = df.select(
            F.window("event_time", width)["start"].alias("event_time"), *keys, distinct, *sums.values()
        )
        per_value = placed.groupBy("event_time", *keys, distinct).agg(
            *[F.sum(c).alias(out) for out, c in sums.items()]
        )
        return per_value.select(
            "event_time",
            *keys,
            F.when(F.col(distinct).isNotNull(), 1).otherwise(0).cast("bigint").alias(count),
            *sums,
        )
    zeros = {out: F.lit(0).cast(df.schema[c].dataType).alias(out) for out, c in sums.items()}
    every = df.select(
        "event_time",
        *keys,
        F.lit(0).cast("bigint").alias(count),
        *[F.col(c).alias(out) for out, c in sums.items()],
    )
    first = (
        df.where(F.col(distinct).isNotNull())
        .select(F.window("event_time", width).alias("window"), *keys, distinct)
        .dropDuplicates(["window", *keys, distinct])
        .select(
            F.window_time("window").alias("event_time"),
            *keys,
            F.lit(1).cast("bigint").alias(count),
            *zeros.values(),
        )
    )
    return every.unionByName(first)
