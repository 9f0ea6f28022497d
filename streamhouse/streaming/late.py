"""Rows that come too late for a window, as a side output of the query that drops them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT, IN = "out", "in"


def late_input(df: DataFrame, topic: str, time: Column, text: str) -> DataFrame:
    """What a late row of an input is told by: its topic, event time and text."""
    return df.select(F.struct(F.lit(topic).alias("source_topic"), time.alias("event_time"), F.col(text).alias("value")).alias(IN))


def with_inputs(out: DataFrame, inputs: Sequence[DataFrame]) -> DataFrame:
    """A query's output and the rows of its inputs, as rows of one stream, so that a micro-batch has both.

    The inputs pass by the state, and nothing of them is shuffled.
    """
    every = out.select(F.struct(*out.columns).alias(OUT))
    for df in inputs:
        every = every.unionByName(df, allowMissingColumns=True)
    return every


def watermark_before(spark: SparkSession, checkpoint: str, batch_id: int) -> int | None:
    """The watermark, in milliseconds, by which a micro-batch tells late rows: that of the batch before.

    It is in the checkpoint's log of batches, so a restarted query has it too.
    """
    if batch_id == 0:
        return None
    told = spark.read.text(f"{checkpoint}/offsets/{batch_id - 1}")
    return told.select(F.max(F.get_json_object("value", "$.batchWatermarkMs").cast("bigint"))).first()[0]


def is_late(watermark_ms: int | None, width: str) -> Column:
    """Whether an input row's window was closed when the row came. Rows without a time have no window."""
    if watermark_ms is None:
        return F.lit(False)
    size = F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    end = (F.floor(F.unix_millis(f"{IN}.event_time") / size) + 1) * size
    return F.coalesce(end <= watermark_ms, F.lit(False))


def told_late(batch: DataFrame, watermark_ms: int | None, width: str, topic: str) -> DataFrame:
    """``topic`` and ``value`` of the late rows: where they came from, their time, how late they are, and their text."""
    at = F.unix_millis(f"{IN}.event_time")
    late = batch.where(F.col(IN).isNotNull()).where(is_late(watermark_ms, width))
    by = F.lit(watermark_ms).cast("bigint") - at
    told = F.struct(f"{IN}.source_topic", at.alias("event_ms"), by.alias("late_ms"), f"{IN}.value")
    return late.select(F.lit(topic).alias("topic"), F.to_json(told).alias("value"))
