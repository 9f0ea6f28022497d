"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with references of its language by the
Jensen-Shannon distance (base 2, so 0 to 1). References are sums over all documents of the language that pass the base
rules. Texts below the minimum lengths are not judged by the distances, which are noise there.

Defined cases: null text is empty, null language is a language of its own, an empty text has zero counts and fails the
base rule of ten words; repeated rows and ids each get their own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: The method judges texts of so many words and characters at least.
JUDGED_WORDS, JUDGED_CHARS = 60, 200
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.2, 0.28
#: Frequent words of the languages.
COMMON = (
    "the of and to in is that for it was on are as with be by this from at or an not have"
    " der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es"
    " le la les et des en un une du que est pour qui dans par sur pas au plus avec"
    " el los las que y del se por con una su para al lo como más pero sus"
).split()
COMMON = list(dict.fromkeys(COMMON))
#: lower, upper, digit, white space, sentence marks, symbols, other ASCII, beyond ASCII
CHAR_CLASSES = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def char_classes() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 7
    kind[~words.SPACED] = 3
    kind[list(b".,;:'\"-()?")] = 4
    kind[list(b"#*$%&|<>!@^~=+\\/{}[]_`")] = 5
    return kind


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and histograms of each text."""
    c = words.chunk(texts, words.SPACED)
    n, hasher = len(texts), words.Hasher(c.data)
    own = np.arange(n, dtype=np.uint64) * np.uint64(words.BASE)  # keeps equal things of two texts apart
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True

    ends = np.flatnonzero(c.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    seen = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(c.mask, out=seen[1:])
    told = seen[ends] > seen[starts]
    starts, ends = starts[told], ends[told]
    of = np.searchsorted(c.offsets, starts, side="right") - 1
    _, first = np.unique(hasher.spans(starts, ends) + own[of], return_index=True)
    dup_lines = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)

    h = hasher.spans(c.starts, c.ends)
    m = max(len(h) - 4, 0)
    repeated = np.zeros(len(h), bool)
    if m:
        g = h[:m].copy()
        for k in range(1, 5):
            g = g * np.uint64(words.BASE) + h[k : m + k]
        g = words.mix(g) + own[c.doc[:m]]
        whole = np.flatnonzero(c.doc[:m] == c.doc[4:])
        order = np.argsort(g[whole])
        ordered = g[whole][order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(ordered), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = whole[order[twice]]
        for k in range(5):
            repeated[at + k] = True

    kinds = char_classes()[c.data]
    lower = words.Hasher(words.LOWER[c.data]).spans(c.starts, c.ends)
    known = words.chunk([w.encode() for w in COMMON], words.SPACED)
    known = words.Hasher(known.data).spans(known.starts, known.ends)
    by = np.argsort(known)
    at = np.minimum(np.searchsorted(known[by], lower), len(by) - 1)
    bin_ = np.where(known[by][at] == lower, by[at], len(COMMON))
    common = np.bincount(c.doc * (len(COMMON) + 1) + bin_, minlength=n * (len(COMMON) + 1)).reshape(n, -1)
    return {
        "n_words": c.counts(),
        "word_chars": c.per_doc(c.mask & ((c.data & 0xC0) != 0x80)),
        "n_symbols": c.per_doc(symbol[c.data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": c.counts(repeated),
        "chars": np.stack([c.per_doc(kinds == k) for k in range(CHAR_CLASSES)], axis=1),
        "common": common,
    }


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches):
        x = measure(texts)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[k].astype(np.int64).ravel()), x[k].shape[1]).cast(pa.list_(pa.int64())) for k in ("chars", "common")]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *(pa.array(x[k].astype(np.int64)) for k in COUNTS), *lists], ["doc_id", "lang", *COUNTS, "chars", "common"])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    p, q = total(counts), total(reference)
    terms = F.zip_with(counts, reference, lambda a, b: F.struct((a / p).alias("p"), (b / q).alias("q")))
    bits = F.aggregate(terms, F.lit(0.0), lambda s, x: s + half(x["p"], (x["p"] + x["q"]) / 2) + half(x["q"], (x["p"] + x["q"]) / 2))
    return F.when((p > 0) & (q > 0), F.sqrt(F.greatest(bits / 2, F.lit(0.0))))


def features(documents: DataFrame) -> DataFrame:
    words.ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(measured, f"doc_id {kind}, lang string, {', '.join(f'{k} bigint' for k in COUNTS)}, chars array<bigint>, common array<bigint>")


def references(counted: DataFrame) -> DataFrame:
    """Per language: sums of the histograms of all documents that pass the base rules."""
    good = counted.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    sizes = (("chars", CHAR_CLASSES), ("common", len(COMMON) + 1))
    sums = good.groupBy("lang").agg(*(F.sum(F.col(k)[i]).alias(f"{k}{i}") for k, n in sizes for i in range(n)))
    return sums.select("lang", *(F.array(*(f"{k}{i}" for i in range(n))).alias(f"of_{k}") for k, n in sizes))


def quality_rules(documents: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, char_distance, word_distance (null where not judged): a row per document."""
    counted = features(documents)
    joined = counted.join(references(counted), "lang", "left")
    judged = (F.col("n_words") >= JUDGED_WORDS) & (F.col("word_chars") >= JUDGED_CHARS)
    out = joined.select(
        "doc_id",
        *COUNTS,
        base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
        F.when(judged, distance(F.col("chars"), F.col("of_chars"))).alias("char_distance"),
        F.when(judged, distance(F.col("common"), F.col("of_common"))).alias("word_distance"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~(F.col("base_failed") | far))
