"""Documents to training tokens, stage by stage; each stage works on all that the stage before it kept.

Every stage but the last returns the columns of documents; a table in parquet between stages is all that they share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamhouse.llm import decontamination, pieces, secret_scan, simhash, weak_labels, words
from streamhouse.llm.queries import VOCABULARY, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    docs = docs.select(*COLUMNS)
    weights, _ = weak_labels.fit(docs, table(spark, sf_dir, "labels"))
    return weak_labels.score(docs, weights).filter("low_quality <= 0.5 and toxicity <= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, copied or paraphrased. Rows that share a leaking row's id go with it."""
    docs = docs.select(*COLUMNS)
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    size = F.when(F.col("n_secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", size).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, score, second_score, round_trip."""
    return pieces.encode(docs, pieces.load(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The other stages' are written to a new folder of this run below the checkpoint folder, and stay there for the returned rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{words.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
