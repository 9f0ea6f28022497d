"""Text helpers: blank test, keyword split, JSON encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def is_blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def keywords(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def explode_keywords(df: DataFrame, text: str, keyword: str = "keyword") -> DataFrame:
    """One row per word of ``text``; rows without a word vanish."""
    return df.select("*", F.explode(keywords(F.col(text))).alias(keyword))


def to_json_value(df: DataFrame) -> DataFrame:
    """Whole row as one JSON string column ``value``; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
