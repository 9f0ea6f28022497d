"""Daily unique visitors and bounced visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.texts import is_blank
from streamhouse.functions.times import day_of, event_time
from streamhouse.operators.joins import first_per_key
from streamhouse.operators.neighbours import with_neighbour

BOUNCE_MS = 10_000


def is_session_start() -> Column:
    return is_blank(F.col("page.last_page_id"))


def unique_visits(page_log: DataFrame) -> DataFrame:
    """First session start per device and day, all columns plus ``mid`` and ``dt``.

    Batch keeps the earliest row. A stream keeps the first that arrives and forgets a day
    once the watermark is one day past it.
    """
    starts = page_log.where(is_session_start()).select(
        "*", F.col("common.mid").alias("mid"), day_of(F.col("ts")).alias("dt")
    )
    if page_log.isStreaming:
        stamped = starts.withColumn("event_time", event_time(F.col("ts")))
        return (
            stamped.withWatermark("event_time", "1 day")
            .dropDuplicatesWithinWatermark(["mid", "dt"])
            .drop("event_time")
        )
    return first_per_key(starts, ["mid", "dt"], [F.col("ts"), F.col("page.page_id")])


def bounces(page_log: DataFrame, within_ms: int = BOUNCE_MS, slot_ms: int | None = None) -> DataFrame:
    """Session starts with no further row of the device in less than ``within_ms``.

    Batch form; ``streaming.jobs`` runs the same rule as a stateful operator. Whatever row
    comes next ends the wait: one with a page id continues the visit, and one without
    breaks it, so neither leaves a bounce.
    """
    device = page_log.withColumn("__mid", F.col("common.mid"))
    # Of rows at the same millisecond, session starts coming first, only the last can bounce.
    # The others are dropped in the map tasks, so that a slot of a device holds at most one
    # row per millisecond.
    last = first_per_key(
        device, ["__mid", "ts"], [is_session_start().asc(), F.desc("page.page_id")]
    )
    reached = with_neighbour(
        last,
        key=F.col("__mid"),
        ts_ms=F.col("ts"),
        reach_ms=within_ms,
        value=F.lit(True),
        name="__continued",
        slot_ms=slot_ms,
    )
    return reached.where(is_session_start() & F.col("__continued").isNull()).select(
        *page_log.columns
    )
