"""Stream forms of the stateful operators: streaming aggregates and joins, all in Spark's own state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.times import day_of, event_time
from streamhouse.operators.visits import BOUNCE_MS, is_session_start

#: Parts of the waiting time that are summed up before bounces are looked for.
BUCKETS = 10
ROW, FIRST_DAY = "row", "first_day"


def is_marked_new() -> Column:
    return F.coalesce((F.col("common.is_new") == "1") & F.col("common.mid").isNotNull(), F.lit(False))


def with_first_days(log: DataFrame) -> DataFrame:
    """Page logs, and the first day of each device that the micro-batch marks new, as rows of one stream.

    Run it in update mode and give each micro-batch to ``repaired``. A device has one small row of state, which is the
    earliest day on which it was marked new; rows are pre-aggregated before they reach it, so a hot device is a row per task.
    State is kept for good: its bound is the number of devices ever marked new.
    """
    marked = log.where(is_marked_new()).select(F.col("common.mid").alias("mid"), day_of(F.col("ts")).alias("day"))
    first = marked.groupBy("mid").agg(F.min("day").alias("day"))
    rows = log.select(F.lit(ROW).alias("kind"), F.struct(*log.columns).alias("row"))
    return rows.unionByName(
        first.select(F.lit(FIRST_DAY).alias("kind"), F.struct("mid", "day").alias("first")), allowMissingColumns=True
    )


def repaired(batch: DataFrame) -> DataFrame:
    """The page logs of a micro-batch of ``with_first_days``, not new on any day but the device's first.

    Both kinds of rows come from the batch, so it should be persisted. The join with the devices is left to AQE, which
    splits a hot one.
    """
    row = F.col("row")
    first = batch.where(F.col("kind") == FIRST_DAY).select(F.col("first.mid").alias("__mid"), F.col("first.day").alias("__first"))
    fields = [f.name for f in batch.schema["row"].dataType.fields]
    logs = batch.where(F.col("kind") == ROW).select(*[row[c].alias(c) for c in fields])
    known = logs.join(first, (F.col("common.mid") == F.col("__mid")) & is_marked_new(), "left")
    is_first = day_of(F.col("ts")).eqNullSafe(F.col("__first")) & F.col("__first").isNotNull()
    flag = F.when(is_marked_new(), F.when(is_first, "1").otherwise("0")).otherwise(F.col("common.is_new"))
    return known.withColumn("common", F.col("common").withField("is_new", flag)).select(*fields)


def bounces_stream(
    page_log: DataFrame, within_ms: int = BOUNCE_MS, delay: str = "1 millisecond"
) -> DataFrame:
    """JSON ``value`` of bounced session starts, once the watermark has passed their wait.

    A stream-stream left outer join of session starts with what the device did next. The later rows are summed up first:
    a device and a tenth of the wait has one row, with its earliest time and its last row in order. So a start meets at
    most twelve of them, however many rows its device has, and only starts carry their text. Both sides are keyed by
    device and slot of time, so that a hot device is dealt out where a micro-batch spans more than a wait. What no later
    row matches is emitted by the watermark.

    Of rows at the same millisecond session starts come first, then smaller page ids. Of starts that
    agree in device, time and page one is kept. Rows without a time are left out.
    """
    starts = is_session_start()
    device = [F.coalesce("common.mid", F.lit("")).alias("mid"), F.col("common.mid").isNull().alias("nameless")]
    flat = (
        page_log.where(F.col("ts").isNotNull())
        .select(
            *device,
            F.col("ts").alias("at"),
            F.struct(F.col("ts"), (~starts).alias("goes_on"), F.col("page.page_id").alias("page_id")).alias("place"),
            starts.alias("starts"),
            F.when(starts, F.to_json(F.struct(*page_log.columns))).alias("value"),
            event_time(F.col("ts")).alias("time"),
        )
        .withWatermark("time", delay)
    )
    bucket_ms = max(1, within_ms // BUCKETS)
    window = F.window("time", f"{bucket_ms} milliseconds").alias("bucket")
    later = (
        flat.groupBy("mid", "nameless", window)
        .agg(F.min("at").alias("earliest"), F.max("place").alias("last"))
        .select("mid", "nameless", "earliest", "last", F.window_time("bucket").alias("until"))
    )
    # A bucket can continue starts of its own slot and of the one before.
    slot = F.floor(F.col("earliest") / within_ms)
    seen = later.select("*", F.explode(F.array(slot, slot - 1)).alias("slot")).alias("seen")
    left = (
        flat.where("starts")
        .dropDuplicatesWithinWatermark(["mid", "nameless", "place"])
        .select("mid", "nameless", "at", "place", "value", "time", F.floor(F.col("at") / within_ms).alias("slot"))
        .alias("start")
    )
    wait = F.expr(f"INTERVAL {within_ms + bucket_ms} MILLISECONDS")
    goes_on = (
        (F.col("start.mid") == F.col("seen.mid"))
        & (F.col("start.nameless") == F.col("seen.nameless"))
        & (F.col("start.slot") == F.col("seen.slot"))
        & (F.col("seen.until") >= F.col("start.time"))
        & (F.col("seen.until") <= F.col("start.time") + wait)
        & (F.col("seen.last") > F.col("start.place"))
        & (F.col("seen.earliest") < F.col("start.at") + within_ms)
    )
    joined = left.join(seen, goes_on, "left_outer")
    return joined.where(F.col("seen.earliest").isNull()).select("start.value")
