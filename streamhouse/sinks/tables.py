"""Analytic-store and dimension-table sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse.functions.times import now_ms
from streamhouse.operators import cdc
from streamhouse.sources.tables import commit, latest_version, parts_of, read_dim, read_parts, write_buckets, write_version

BATCH_ROWS = 5_000
DIM_BUCKETS = 64


@dataclass(frozen=True)
class StatsSink:
    """Analytic store, over JDBC (``url``) or as parquet tables below ``folder``."""

    url: str | None = None
    folder: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    connections: int = 16
    ledger: str | None = None

    def append(
        self, df: DataFrame, table: str, columns: Sequence[str], writer: str, batch_id: int
    ) -> None:
        """Append the listed columns in their order; ``ts`` is the time of writing.

        A repeated micro-batch replaces its first try in a folder, and is appended again by
        JDBC.

        With a ``ledger`` table JDBC has each row once as well: rows go to ``staging(table)`` with writer, batch and the
        number of the attempt, then one ledger row (table, writer, batch, attempt) makes the attempt count. A batch that
        is in the ledger is not written again, and rows of an attempt that is not are never seen by readers of
        ``visible(table, columns)``.
        """
        rows = (df if "ts" in df.columns else df.withColumn("ts", now_ms())).select(*columns)
        if self.url and self.ledger:
            self._append_once(rows, table, writer, batch_id)
            return
        if self.url:
            options = {"batchsize": str(BATCH_ROWS), **self.properties}
            writer = rows.write.mode("append").option("numPartitions", str(self.connections))
            writer.jdbc(self.url, table, properties=options)
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/writer={writer}/batch={batch_id}")

    def _write(self, rows: DataFrame, table: str) -> None:
        options = {"batchsize": str(BATCH_ROWS), **self.properties}
        rows.write.mode("append").option("numPartitions", str(self.connections)).jdbc(self.url, table, properties=options)

    def _append_once(self, rows: DataFrame, table: str, writer: str, batch_id: int) -> None:
        spark = rows.sparkSession
        own = F.lit(table).alias("stats_table"), F.lit(writer).alias("writer"), F.lit(batch_id).cast("bigint").alias("batch")
        seen = spark.read.jdbc(self.url, done_query(self.ledger, table, writer, batch_id), properties=dict(self.properties))
        if not seen.isEmpty():
            return
        tried = spark.read.jdbc(self.url, attempts_query(table, writer, batch_id), properties=dict(self.properties))
        attempt = F.lit((tried.first()[0] or 0) + 1).alias("attempt")
        self._write(rows.select("*", *own[1:], attempt), staging(table))
        # One row over one connection: the database takes it or does not.
        self._write(spark.range(1).select(*own, attempt).coalesce(1), self.ledger)


def staging(table: str) -> str:
    """The table that takes the rows of all attempts."""
    return f"{table}_staging"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def done_query(ledger: str, table: str, writer: str, batch_id: int) -> str:
    """The ledger's row of a micro-batch, as a JDBC source."""
    return f"(SELECT attempt FROM {ledger} WHERE stats_table = {_text(table)} AND writer = {_text(writer)} AND batch = {batch_id}) done"


def attempts_query(table: str, writer: str, batch_id: int) -> str:
    """The last attempt at a micro-batch that left rows, as a JDBC source."""
    return f"(SELECT MAX(attempt) AS attempt FROM {staging(table)} WHERE writer = {_text(writer)} AND batch = {batch_id}) tried"


def visible(table: str, columns: Sequence[str], ledger: str) -> str:
    """The statement that defines ``table`` as a view of the rows whose attempt the ledger has."""
    own = ", ".join(f"s.{c}" for c in columns)
    return (
        f"CREATE VIEW {table} AS SELECT {own} FROM {staging(table)} s JOIN {ledger} l "
        f"ON l.stats_table = {_text(table)} AND l.writer = s.writer AND l.batch = s.batch AND l.attempt = s.attempt"
    )


def create_dims(spark: SparkSession, root: str, routes: DataFrame) -> dict[str, tuple[StructType, str]]:
    """Create the dimension tables of the routes that do not exist yet, as empty version 0."""
    tables = cdc.dim_schemas(routes)
    for table, (schema, _) in tables.items():
        if read_dim(spark, root, table) is None:
            write_version(spark.createDataFrame([], schema), f"{root}/{table}", 0)
    return tables


def upsert_dim(
    spark: SparkSession,
    root: str,
    table: str,
    schema: StructType,
    pk: str,
    changes: DataFrame,
    batch_id: int,
    buckets: int = DIM_BUCKETS,
) -> None:
    """Apply one micro-batch of changes and commit the outcome as a new version.

    The table is cut into ``buckets`` by a hash of its key. Only buckets that the changes touch are read, merged and
    written again; the new version shares the others' files with the versions before, so the bytes written follow the
    changes and not the table. A table that was written as a whole is cut at its first upsert, and cut anew if the number of
    buckets has changed.

    The version number follows from the batch, and only older versions are read, so a
    repeated batch gives the same table; until its one commit mark is there, readers see the version before.
    """
    version, folder = batch_id + 1, f"{root}/{table.upper()}"
    columns = schema.fieldNames()
    older = latest_version(spark, folder, before=version)
    parts = parts_of(spark, folder, older) if older is not None else []
    bucket = F.pmod(F.xxhash64(pk), F.lit(buckets)).cast("int")
    if all(n == buckets for _, n, _ in parts):
        keys = changes.select(F.col("data")[pk].alias(pk)).where(F.col(pk).isNotNull())
        touched = {r.b for r in keys.select(bucket.alias("b")).distinct().collect()}  # a row per bucket at most
    else:
        touched = {b for b, *_ in parts}
    merged, kept = ([p for p in parts if (p[0] in touched) == wanted] for wanted in (True, False))
    current = read_parts(spark, folder, merged, schema) if merged else None
    # Positions compare within one partition of a topic only, so the source's own order comes first.
    order = F.struct(*[c for c in ("at", "xid", "xoffset", "position") if c in changes.columns])
    outcome = cdc.upsert(current, changes, pk, columns, order)
    if touched:
        write_buckets(outcome.withColumn("bucket", bucket), folder, version, buckets, kept)
    else:
        commit(spark, folder, version, kept)
