"""Registered queries of the operators, over the whole of their tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamhouse.llm import chat, decontamination, divergence, hard_negatives, licenses, pages, periods, pieces, repeats, secret_scan, simhash, token_files, weak_labels, words

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation of control strings, formatted with the others.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(rows.unionByName(probe)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.load(vocabulary))
    return found.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "score", "second_score", "round_trip")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    folder = f"{words.checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer)
    return token_files.read_all(spark, folder, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.with_planted(table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_formatting, op2_license_scan, op3_secret_scan, op4_quality_classifier, op5_sentencepiece, op6_decontamination, op7_suffix_array_dedup, op8_html_extraction, op9_quality_rules, op10_simhash, op11_token_files, op12_periodic_runs, op13_hard_negatives)}
SQL: dict[str, str] = {}
