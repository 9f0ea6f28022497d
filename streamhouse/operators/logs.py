"""Page log layer: parsing, new-visitor repair, split into start, page and display logs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse.functions.times import event_time
from streamhouse.operators.joins import keyed_lookup


class Parsed(NamedTuple):
    good: DataFrame
    bad: DataFrame


class LogSplit(NamedTuple):
    start: DataFrame
    page: DataFrame
    display: DataFrame


def parse_json(
    df: DataFrame, schema: StructType, value: str = "value", keep: tuple[str, ...] = ()
) -> Parsed:
    """Typed rows of a JSON string column, and the raw rows that do not parse."""
    marked = StructType([*schema.fields]).add("__corrupt", "string")
    row = F.from_json(value, marked, {"columnNameOfCorruptRecord": "__corrupt"})
    # Inlining keeps the parser from running once per field that is read.
    parsed = df.select("*", F.inline(F.array(F.struct(row.alias("__row")))))
    is_bad = F.col("__row").isNull() | F.col("__row.__corrupt").isNotNull()
    fields = [F.col(f"__row.`{name}`") for name in schema.fieldNames()]
    return Parsed(
        parsed.where(~is_bad).select(*keep, *fields), parsed.where(is_bad).select(*df.columns)
    )


def _flip(log: DataFrame, is_old: Column) -> DataFrame:
    flag = F.when(is_old, F.lit("0")).otherwise(F.col("common.is_new"))
    return log.withColumn("common", F.col("common").withField("is_new", flag))


def repair_new_visitors(log: DataFrame) -> DataFrame:
    """Set ``is_new`` to 0 on rows marked new after the first day on which a device was new.

    Batch form; ``streaming.jobs`` keeps the first day as state instead.
    """
    is_new = F.col("common.is_new") == "1"
    day = F.to_date(event_time(F.col("ts")))
    marked = log.withColumns({"__mid": F.col("common.mid"), "__day": day})
    first_day = {"__first": F.min(F.when(is_new, F.col("__day")))}
    known = keyed_lookup(marked, "__mid", first_day)
    late = is_new & (F.col("__day") != F.col("__first"))
    return _flip(known, F.coalesce(late, F.lit(False))).drop("__mid", "__day", "__first")


def with_flag(raw: Column, is_new: Column) -> Column:
    """The JSON text of a log with the flag in its ``common`` object, all else as it is."""
    flag = r'("common"\s*:\s*\{[^{}]*?"is_new"\s*:\s*)"?1"?'
    return F.when(is_new == "0", F.regexp_replace(raw, flag, '$1"0"')).otherwise(raw)


def with_page(shown: Column, page_id: Column) -> Column:
    """The JSON text of a shown item with the page it was shown on, all else as it is."""
    added = F.substring(F.to_json(F.struct(page_id.alias("page_id"))), 2, 2_147_483_647)
    body = F.rtrim(F.regexp_replace(shown, r"\}\s*$", ""))
    comma = F.when(body.endswith("{") | (added == "}"), F.lit("")).otherwise(F.lit(","))
    return F.concat(body, comma, added)


def split_logs(log: DataFrame) -> LogSplit:
    """Start rows, page rows, and one display row per shown item of a page row.

    A row is a start row when its ``start`` object is present and not empty.
    """
    page = log.where(~is_start(log))
    return LogSplit(log.where(is_start(log)), page, explode_displays(page))


def is_start(log: DataFrame) -> Column:
    return F.coalesce(_is_filled(log, "start"), F.lit(False))


def _is_filled(log: DataFrame, column: str) -> Column:
    """Whether an object column, struct or map, has any value in it."""
    kind = log.schema[column].dataType
    if isinstance(kind, StructType):
        fields = [F.col(f"{column}.`{f.name}`").isNotNull() for f in kind.fields]
        any_set = fields[0]
        for f in fields[1:]:
            any_set = any_set | f
        return any_set
    return F.size(column) > 0


def explode_displays(page: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per shown item, with the page it was shown on."""
    items = page.select("page.page_id", *keep, F.explode("displays").alias("d"))
    return items.select("d.*", "page_id", *keep)
