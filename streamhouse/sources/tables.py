"""Table sources: routing configuration and dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse.operators.joins import first_per_key


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str]) -> DataFrame:
    """A table over JDBC, such as the routing table."""
    return spark.read.jdbc(url, table, properties=dict(properties))


#: What a commit mark lists: the folders that a version of a table consists of. Whole tables have no bucket.
MARK = "version bigint, bucket int, buckets int, folder string"


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    """Highest committed version of a table, below ``before`` if given."""
    try:
        done = spark.read.option("recursiveFileLookup", "true").schema("version bigint").parquet(f"{folder}/committed")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if before is not None:
        done = done.where(F.col("version") < before)
    return done.agg(F.max("version")).first()[0]


def commit(spark: SparkSession, folder: str, version: int, parts: Sequence[tuple[int | None, int | None, str]]) -> None:
    """Make a version of a table visible, by one small file: its parts are (bucket, buckets, folder)."""
    mark = spark.createDataFrame([(version, *part) for part in parts], MARK)
    mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/committed/{version}")


def parts_of(spark: SparkSession, folder: str, version: int) -> list[tuple[int | None, int | None, str]]:
    """What a committed version consists of: a row per bucket at most."""
    rows = spark.read.schema(MARK).parquet(f"{folder}/committed/{version}").collect()
    return [(r.bucket, r.buckets, r.folder or f"version={version}") for r in rows]


def write_version(df: DataFrame, folder: str, version: int) -> None:
    """Write a version of a table as a whole and, once it is there, mark it as committed."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    commit(df.sparkSession, folder, version, [(None, None, f"version={version}")])


def write_buckets(
    df: DataFrame, folder: str, version: int, buckets: int, kept: Sequence[tuple[int | None, int | None, str]]
) -> None:
    """Write the rows of some buckets, by their column ``bucket``, as part of a version and commit it with the ``kept`` others.

    All rows of a bucket come from one task, so each has one file.
    """
    where = f"buckets/version={version}"
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{where}")
    spark = df.sparkSession
    made = spark.read.parquet(f"{folder}/{where}").select("bucket").distinct().collect()
    commit(spark, folder, version, [*kept, *((r.bucket, buckets, f"{where}/bucket={r.bucket}") for r in made)])


def read_parts(spark: SparkSession, folder: str, parts: Sequence[tuple[int | None, int | None, str]], schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{folder}/{part}" for *_, part in parts])


def read_dim(
    spark: SparkSession,
    root: str,
    table: str,
    schema: StructType | None = None,
    before: int | None = None,
) -> DataFrame | None:
    """Newest version of a dimension table; empty, or None without a schema, if there is none."""
    folder = f"{root}/{table.upper()}"
    version = latest_version(spark, folder, before)
    if version is not None:
        return read_parts(spark, folder, parts_of(spark, folder, version))
    return None if schema is None else spark.createDataFrame([], schema)


def find_in_dim(dim: DataFrame, **equals: str) -> DataFrame:
    """First dimension row with the given column values, or no row."""
    for column, value in equals.items():
        dim = dim.where(F.col(column) == F.lit(value))
    order = [F.col(c) for c in dim.columns]
    return first_per_key(dim, list(equals), order)
