"""Topics of JSON text, on a Kafka cluster or in a shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse.operators.logs import Parsed, parse_json
from streamhouse.operators.windows import RECORD


TEXT = "_text"


@dataclass(frozen=True)
class Bus:
    """Where topics live: Kafka ``servers``, or a ``folder`` with one sub-folder per topic.

    With ``once`` each published record carries an id of its writer, micro-batch and ordinal: in Kafka as a header, in a
    folder as a column of parquet files, which are then appended to as Kafka's topics are. Readers hand the id on as RECORD,
    and the first operator with a watermark drops repeats (``operators.windows.with_watermark``).
    """

    servers: str | None = None
    folder: str | None = None
    per_trigger: int | None = None
    once: bool = False

    def __post_init__(self):
        if (self.servers is None) == (self.folder is None):
            raise ValueError("give either Kafka servers or a folder")


def kafka_options(bus: Bus, topic: str, group: str | None, starting: str) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": bus.servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if group:
        options["groupIdPrefix"] = group
    if bus.per_trigger:
        options["maxOffsetsPerTrigger"] = str(bus.per_trigger)
    if bus.once:
        options["includeHeaders"] = "true"
    return options


def record_id() -> Column:
    """The id of a Kafka record: its header, or its place if another producer wrote it."""
    own = F.filter("headers", lambda h: h["key"] == RECORD)[0]["value"].cast("string")
    return F.coalesce(own, F.concat_ws("/", F.lit("@"), "topic", "partition", "offset")).alias(RECORD)


def read_topic(
    spark: SparkSession,
    bus: Bus,
    topic: str,
    group: str | None = None,
    starting: str = "earliest",
) -> DataFrame:
    """Stream of ``value`` strings with their ``position``, which orders the records of a key.

    The position is the offset in Kafka and the file time in a folder. From a bus with ``once`` comes RECORD as well.
    """
    if bus.servers:
        records = spark.readStream.format("kafka").options(
            **kafka_options(bus, topic, group, starting)
        )
        return records.load().select(
            F.col("value").cast("string").alias("value"),
            F.col("offset").alias("position"),
            *([record_id()] if bus.once else []),
        )
    if bus.once:
        files = spark.readStream.schema("value string, record string").option("recursiveFileLookup", "true")
        if bus.per_trigger:
            files = files.option("maxFilesPerTrigger", str(bus.per_trigger))
        place = F.concat_ws("/", "_metadata.file_path", "_metadata.row_index")
        return files.parquet(f"{bus.folder}/topic={topic}").select(
            "value",
            F.unix_millis("_metadata.file_modification_time").alias("position"),
            F.coalesce("record", place).alias(RECORD),
        )
    files = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if bus.per_trigger:
        files = files.option("maxFilesPerTrigger", str(bus.per_trigger))
    return files.load(f"{bus.folder}/topic={topic}").select(
        "value", F.unix_millis("_metadata.file_modification_time").alias("position")
    )


def read_parsed(
    spark: SparkSession, bus: Bus, topic: str, schema: StructType, group: str | None = None
) -> Parsed:
    """Streams of typed records with their text as ``raw``, and of records that do not parse."""
    records = read_topic(spark, bus, topic, group)
    found = parse_json(records.drop(RECORD).withColumn("raw", F.col("value")), schema, keep=("raw",))
    return Parsed(found.good, found.bad.drop("raw"))


def read_records(
    spark: SparkSession,
    bus: Bus,
    topic: str,
    schema: StructType,
    group: str | None = None,
    starting: str = "earliest",
    text: bool = False,
) -> DataFrame:
    """Stream of typed records, with their text as TEXT where asked for; text that does not parse is left out."""
    keep = (*([RECORD] if bus.once else []), *([TEXT] if text else []))
    records = read_topic(spark, bus, topic, group, starting)
    return parse_json(records.withColumn(TEXT, F.col("value")) if text else records, schema, keep=keep).good


def create_topic_view(
    spark: SparkSession, bus: Bus, topic: str, schema: StructType, view: str, group: str, text: bool = False
) -> DataFrame:
    """Declare a topic as a SQL view that starts at the latest record."""
    records = read_records(spark, bus, topic, schema, group, "latest", text)
    records.createOrReplaceTempView(view)
    return records
