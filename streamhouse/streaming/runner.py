"""Starts streaming queries, each with its own checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from streamhouse.session import durable_dir, tune

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """Settings for streams; the number of state partitions is fixed by the first run."""
    tune(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return spark


def checkpoint_of(spark: SparkSession, name: str, checkpoints: str | None = None) -> str:
    """The checkpoint of a query: below ``checkpoints``, or else below the cluster's shared folder."""
    return f"{checkpoints or durable_dir(spark, 'streams')}/{name}"


def start(
    df: DataFrame,
    name: str,
    write: Callable[[DataFrame, int], None],
    checkpoints: str | None = None,
    available_now: bool = False,
    every: str = "5 seconds",
    mode: str = "append",
) -> StreamingQuery:
    """Run ``write`` on every micro-batch of ``df``.

    The checkpoint is ``checkpoints``/name, by default below the cluster's shared folder.
    """
    writer = (
        df.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint_of(df.sparkSession, name, checkpoints))
        .foreachBatch(write)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_console(
    df: DataFrame, name: str, checkpoints: str | None = None, available_now: bool = False
) -> StreamingQuery:
    """Print every row of a stream as JSON, for debugging; the driver holds a partition at a time."""

    def show(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toJSON().toLocalIterator():
            print(f"{name} {batch_id}: {row}", flush=True)

    return start(df, name, show, checkpoints, available_now)


def late_rows(query: StreamingQuery) -> int:
    """Rows the query's recent micro-batches dropped because they came after the watermark."""
    return sum(
        state.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for state in progress.stateOperators
    )
