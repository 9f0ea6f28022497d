"""Topic sinks with a fixed topic or one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamhouse.functions.texts import to_json_value
from streamhouse.operators.windows import RECORD
from streamhouse.sources.tables import latest_version, parts_of, read_parts, write_version
from streamhouse.sources.topics import Bus


def to_topic(df: DataFrame, topic: str) -> DataFrame:
    """Rows as JSON text for one topic."""
    return to_json_value(df).select(F.lit(topic).alias("topic"), "value")


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps as long as its checkpoint."""
    told = spark.read.text(f"{checkpoint}/metadata")
    return told.select(F.get_json_object("value", "$.id")).first()[0]


def spooled(rows: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """The rows of a micro-batch with an ``ordinal``, the same in every attempt.

    The first attempt writes them to a table whose version is the batch; a later one finds them there, so that it repeats
    exactly these rows with these ordinals, whatever it would compute. Only the newest version is ever read.
    """
    spark = rows.sparkSession
    if latest_version(spark, folder, before=batch_id + 1) != batch_id:
        numbered = rows.select("topic", "value", F.monotonically_increasing_id().alias("ordinal"))
        write_version(numbered, folder, batch_id)
    return read_parts(spark, folder, parts_of(spark, folder, batch_id))


def publish(
    rows: DataFrame, bus: Bus, writer: str, batch_id: int, checkpoint: str | None = None, output: str = "published"
) -> None:
    """Write ``topic`` and ``value`` rows of one micro-batch.

    In a folder a micro-batch has its own partition, so a repeated batch replaces its first
    try. Kafka delivers at least once.

    With ``bus.once`` a repeated batch appends its records again, with the ids that they had: writer, run of the
    ``checkpoint``, batch and ordinal. Readers drop what they have seen. ``output`` tells the outputs of one query apart.
    """
    if bus.once:
        if checkpoint is None:
            raise ValueError("records with ids need the query's checkpoint folder")
        own = f"{writer}/{run_id(rows.sparkSession, checkpoint)}/{batch_id}"
        told = spooled(rows, f"{checkpoint}/{output}", batch_id)
        record = F.concat_ws("/", F.lit(own), "ordinal")
        if bus.folder:
            told.select("topic", "value", record.alias("record")).write.mode("append").partitionBy("topic").parquet(bus.folder)
            return
        header = F.struct(F.lit(RECORD).alias("key"), record.cast("binary").alias("value"))
        rows = told.select("topic", "value", F.array(header).alias("headers"))
    if bus.servers:
        writer = rows.write.format("kafka").option("kafka.bootstrap.servers", bus.servers)
        (writer.option("includeHeaders", "true") if bus.once else writer).save()
        return
    placed = rows.select(
        "value", "topic", F.lit(writer).alias("writer"), F.lit(batch_id).alias("batch")
    )
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("topic", "writer", "batch")
        .text(bus.folder)
    )
