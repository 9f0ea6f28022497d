"""Change records: cleaning, config-driven routing and pruning, dimension upserts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from streamhouse import constants as C
from streamhouse.schemas import ROUTES
from streamhouse.session import setting_bytes

#: Routes of up to this many bytes of text go to every task, if the session broadcasts as much.
SMALL_ROUTES = 8 << 20


class Routed(NamedTuple):
    facts: DataFrame
    dims: DataFrame


def clean(cdc: DataFrame) -> DataFrame:
    """Drop records without a table or with no data."""
    return cdc.where(F.col("table").isNotNull() & (F.size("data") > 0))


def normalise_type(kind: Column) -> Column:
    """A bootstrap insert counts as an insert."""
    return F.when(kind == "bootstrap-insert", F.lit("insert")).otherwise(kind)


def load_routes(config: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Routing table, one row per table and operation. An empty table is an error.

    ``known`` are the routes of the refresh before: newer rows overwrite those of the same key,
    and a route that left the table stays in use. Of rows with one key in the same refresh the
    largest counts, by all columns. The outcome is checkpointed where anything is new.
    """
    key = ["source_table", "operate_type"]
    rest = [c for c in ROUTES.fieldNames() if c not in key]
    config = config.select(*ROUTES.fieldNames())
    if known is not None and config.exceptAll(known).isEmpty():
        return known
    every = config.withColumn("__fresh", F.lit(1))
    if known is not None:
        every = every.unionByName(known.withColumn("__fresh", F.lit(0)))
    newest = every.groupBy(*key).agg(F.max(F.struct("__fresh", *rest)).alias("__route"))
    routes = newest.select(*key, *[F.col(f"__route.{c}") for c in rest])
    if known is not None:
        routes = routes.checkpoint()
    if routes.isEmpty():
        raise ValueError("the routing table is empty")
    return routes


def route(cdc: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach the route of each record and drop the ones that go nowhere.

    ``data`` keeps only the columns the route lists; an empty list keeps all. Batch only.

    Most records may belong to one table, so they are not shuffled by it: the routes are measured, and while they are
    small every task gets them. Beyond that both sides are shuffled, by one more key that is always 0 (see
    ``joins.keyed_lookup``), so that AQE can split a hot table. The records themselves are never broadcast.
    """
    typed = cdc.withColumn("type", normalise_type(F.col("type")))
    # The column list is split once per route, not once per record.
    keeps_all = F.coalesce("sink_columns", F.lit("")) == ""
    known = routes.where(F.col("sink_type").isin(C.SINK_DIM, C.SINK_FACT)).select(
        F.col("source_table").alias("table"),
        F.col("operate_type").alias("type"),
        "sink_type",
        "sink_table",
        "sink_pk",
        F.when(~keeps_all, F.split("sink_columns", ",")).alias("__listed"),
    )
    threshold = setting_bytes(cdc.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if _text_bytes(known) <= min(SMALL_ROUTES, threshold):
        routed = typed.join(F.broadcast(known), ["table", "type"])
    else:
        zero = F.pmod(F.xxhash64("table", "type"), F.lit(1))
        spread = known.withColumn("__zero", zero).hint("merge")
        routed = typed.withColumn("__zero", zero).join(spread, ["table", "type", "__zero"]).drop("__zero")
    return routed.withColumn("data", prune(F.col("data"), F.col("__listed"))).drop("__listed")


def _text_bytes(routes: DataFrame) -> int:
    """Bytes of the routes as text."""
    return routes.agg(F.sum(F.octet_length(F.to_json(F.struct(*routes.columns))))).first()[0] or 0


def prune(data: Column, listed: Column) -> Column:
    """Entries of ``data`` whose key is in ``listed``; all of them if ``listed`` is null."""
    kept = F.map_filter(data, lambda k, _: F.array_contains(listed, k))
    return F.when(listed.isNull(), data).otherwise(kept)


def split_routed(routed: DataFrame) -> Routed:
    return Routed(
        routed.where(F.col("sink_type") == C.SINK_FACT),
        routed.where(F.col("sink_type") == C.SINK_DIM),
    )


def dim_schemas(routes: DataFrame) -> dict[str, tuple[StructType, str]]:
    """Layout and primary key of every dimension table that the routes create.

    All columns are strings. The key defaults to ``id``. Of several insert routes to a table the
    first by source table counts.
    """
    inserts = routes.where(
        (F.col("sink_type") == C.SINK_DIM) & (F.col("operate_type") == "insert")
    ).select("source_table", "sink_table", "sink_columns", "sink_pk")
    first = inserts.groupBy(F.upper("sink_table").alias("t")).agg(
        F.min(F.struct("source_table", "sink_columns", "sink_pk")).alias("r"),
        F.max(F.when(F.coalesce("sink_columns", F.lit("")) == "", F.col("source_table"))).alias("bare"),
    )
    tables: dict[str, tuple[StructType, str]] = {}
    for t, r, bare in first.toLocalIterator():  # a row per table to create
        if bare is not None:
            raise ValueError(f"the route of {bare} lists no columns")
        fields = [StructField(c, StringType()) for c in r.sink_columns.split(",")]
        tables[t] = StructType(fields), r.sink_pk or "id"
    return tables


def dim_changes(dims: DataFrame, sink_table: str) -> DataFrame:
    """Records of one dimension table with data in them; table names ignore case."""
    return dims.where((F.upper("sink_table") == sink_table.upper()) & (F.size("data") > 0))


def _writes(changes: DataFrame, pk: str, columns: Sequence[str], order: Column) -> DataFrame:
    """Key, order and one nullable ``struct<v>`` per column; null where nothing is written."""
    written = [
        F.when(F.map_contains_key("data", F.lit(c)), F.struct(F.col("data")[c].alias("v"))).alias(c)
        for c in columns
        if c != pk
    ]
    at = F.struct(F.lit(1).alias("fresh"), order.alias("at")).alias("__at")
    return changes.select(F.col("data")[pk].alias(pk), at, *written).where(F.col(pk).isNotNull())


def _latest(writes: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    """Last write per key and column, combined in the map tasks."""
    return writes.groupBy(pk).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c)
            for c in columns
            if c != pk
        ]
    )


def _values(latest: DataFrame, pk: str, columns: Sequence[str]) -> DataFrame:
    return latest.select(*[F.col(c) if c == pk else F.col(f"{c}.v").alias(c) for c in columns])


def upsert(
    current: DataFrame | None,
    changes: DataFrame,
    pk: str,
    columns: Sequence[str],
    order: Column,
) -> DataFrame:
    """Dimension after the changes: per key and column, the last value written. Batch only.

    ``changes`` has a ``data`` map and is ordered by ``order``. A column absent from a record
    keeps its value, and one set to null becomes null. One aggregation, combined in the map
    tasks, so a key with many changes does not gather in one task.
    """
    writes = _writes(changes, pk, columns, order)
    if current is not None:
        at_type = writes.schema["__at"].dataType["at"].dataType
        at = F.struct(F.lit(0).alias("fresh"), F.lit(None).cast(at_type).alias("at"))
        stored = current.where(F.col(pk).isNotNull()).select(
            F.col(pk),
            at.alias("__at"),
            *[F.struct(F.col(c).alias("v")).alias(c) for c in columns if c != pk],
        )
        writes = stored.unionByName(writes)
    return _values(_latest(writes, pk, columns), pk, columns)
