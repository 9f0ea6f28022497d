"""Session settings the operators rely on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TARGET_PARTITION_BYTES = 128 * 1024 * 1024
#: Bytes of rows, as they are sorted and hashed, for a byte of a columnar file.
ROWS_PER_FILE_BYTE = 16
#: Most bytes of files, and of merged shuffle partitions, for a task.
TASK_BYTES = 16 * 1024 * 1024
TASK_SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def tune(spark: SparkSession, *inputs: str) -> SparkSession:
    """Set zone and adaptive execution; size tasks and shuffles for the given input paths.

    A task's memory follows the rows that it sorts, hashes or writes to a shuffle, so what it reads is bounded.

    Skewed shuffle joins are split at run time. The split is forced, since a hot key costs
    more than the extra shuffle that the split may bring.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if inputs:
        size_tasks(spark)
        size_shuffles(spark, ROWS_PER_FILE_BYTE * sum(_input_bytes(path) for path in inputs))
    return spark


def size_tasks(spark: SparkSession) -> None:
    """Let no task read more than TASK_BYTES where its input can be cut. Sizes are only ever lowered."""
    for key in TASK_SIZES:
        if setting_bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))


def setting_bytes(text: str) -> int:
    """Bytes of a size as Spark's settings write it, such as 64MB."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Start shuffles with enough partitions for the input; AQE merges the surplus.

    The count is only ever raised above the cluster's own setting.
    """
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-input_bytes // TARGET_PARTITION_BYTES)
    spark.conf.set(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(floor, wanted))
    )


def _input_bytes(path: str) -> int:
    """Bytes below a path. Only file lengths are read, never contents."""
    files = (
        SparkSession.active()
        .read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.agg(F.sum("length")).first()[0] or 0


def durable_dir(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared checkpoint directory."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; pass a shared folder")
    return f"{base.rstrip('/')}/{name}"
