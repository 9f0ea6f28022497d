"""Keyword statistics from searches and from product statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse import constants as C
from streamhouse.functions.measures import unpivot_measures
from streamhouse.functions.segments import explode_segments
from streamhouse.functions.texts import explode_keywords
from streamhouse.operators.windows import WINDOW, tumble, with_watermark


def is_search() -> Column:
    return (F.col("page")["page_id"] == C.PAGE_GOOD_LIST) & F.col("page")["item"].isNotNull()


def searched_at() -> Column:
    """Event time of a search, in whole seconds."""
    return F.timestamp_seconds(F.expr("ts div 1000"))


def search_keywords(
    page_view: DataFrame, width: str = WINDOW, delay: str = "2 seconds"
) -> DataFrame:
    """Searched words per window. ``page`` is a map, and event time has whole seconds."""
    words = explode_keywords(_searches(page_view, delay), "fullword")
    counted = tumble(words, ["keyword"], [F.count(F.lit(1)).alias("ct")], width)
    return counted.withColumn("source", F.lit(C.KEYWORD_SEARCH))


def _searches(page_view: DataFrame, delay: str) -> DataFrame:
    stamped = with_watermark(page_view.withColumn("event_time", searched_at()), delay)
    return stamped.where(is_search()).select("event_time", F.col("page")["item"].alias("fullword"))


def search_texts(page_view: DataFrame, width: str = WINDOW, delay: str = "2 seconds") -> DataFrame:
    """Searched texts per window, for a lexicon to cut: each different text once."""
    return tumble(_searches(page_view, delay), ["fullword"], [F.count(F.lit(1)).alias("times")], width)


def keywords_of_texts(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Searched words of closed windows, from their texts. Batch only; a micro-batch holds all texts of a window."""
    words = explode_segments(texts, "fullword", lexicon)
    counted = words.groupBy("stt", "edt", "keyword").agg(F.sum("times").alias("ct"))
    return counted.withColumn("source", F.lit(C.KEYWORD_SEARCH))


def product_keywords(product_stats: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Words of the SPU name with the clicks, cart additions and orders of the product.

    With a lexicon (batch only) it cuts names that are written without spaces.
    """
    rows = product_stats.select("spu_name", "click_ct", "cart_ct", "order_ct", "stt", "edt")
    measures = unpivot_measures(rows)
    words = explode_keywords(measures, "spu_name") if lexicon is None else explode_segments(measures, "spu_name", lexicon)
    return words.select("keyword", "ct", "source", "stt", "edt")
