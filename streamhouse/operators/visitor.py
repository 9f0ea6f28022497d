"""Visitor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.functions.times import event_time
from streamhouse.operators.visits import is_session_start
from streamhouse.operators.windows import WINDOW, carried, tumble, with_watermark

KEYS = ("vc", "ch", "ar", "is_new")
MEASURES = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")


def _branch(df: DataFrame, **measures: Column) -> DataFrame:
    return df.select(
        event_time(F.col("ts")).alias("event_time"),
        *[F.col(f"common.{k}").alias(k) for k in KEYS],
        *[
            measures.get(m, F.lit(0)).cast("bigint").alias(m)
            for m in MEASURES
        ],
        *carried(df),
    )


def page_measures(page_log: DataFrame) -> DataFrame:
    """Page views with their duration, and session starts: both come from the same rows."""
    return _branch(
        page_log,
        pv_ct=F.lit(1),
        sv_ct=F.when(is_session_start(), 1).otherwise(0),
        dur_sum=F.coalesce("page.during_time", F.lit(0)),
    )


def unique_visit_measures(visits: DataFrame) -> DataFrame:
    return _branch(visits, uv_ct=F.lit(1))


def bounce_measures(bounced: DataFrame) -> DataFrame:
    return _branch(bounced, uj_ct=F.lit(1))


def visitor_stats(
    page_log: DataFrame,
    visits: DataFrame,
    bounced: DataFrame,
    width: str = WINDOW,
    delay: str = "3 seconds",
    beat: DataFrame | None = None,
) -> DataFrame:
    """Visitors, page views, sessions, bounces and durations per version, channel, area, flag."""
    branches = [page_measures(page_log), unique_visit_measures(visits), bounce_measures(bounced)]
    # A bounce is known long after its page. With a watermark of its own, before the union, its
    # branch holds the windows open; the slowest branch counts.
    first, *others = [with_watermark(b, delay, beat=beat) for b in branches]
    for other in others:
        first = first.unionByName(other)
    return tumble(first, KEYS, [F.sum(m).alias(m) for m in MEASURES], width)
