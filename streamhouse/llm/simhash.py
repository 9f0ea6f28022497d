"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is set where over half of the 3-word shingles' XXH64 hashes (seed 42) have it. Two fingerprints link at
RADIUS differing bits or fewer. Candidates: of four groups of bits at least one is equal in a linked pair, and of four
groups of the other bits again one, and so on; so pairs meet under keys of 28 fixed bits (two splits), or of more where a
key holds more than BUCKET fingerprints: such keys are split again. No key is capped, no pair within the radius is lost.
Rows of a key lie in blocks of 64, one word per bit position; distances of a whole block are counted at once by carry-save
counters, and a block is left as soon as all its counters have passed the radius.

Defined cases: null or blank text has fingerprint zero and links like any other; a null doc_id has a row and counts for a
component's id only if no other id is there; repeated rows and ids each keep their row; an empty table gives no rows;
other columns are ignored. Fingerprints of all documents stay distributed; every round of the component search is
checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 512
BATCH_ROWS = 16_384
SUMMED = 1 << 16
ALL = np.uint64(2**64 - 1)
SPLITS = RADIUS + 1


def fingerprint(text: bytes) -> int:
    w = text.lower().split()  # on bytes: A-Z only, and the ASCII white space
    if not w:
        return 0
    joined, n = b" ".join(w), max(len(w) - SHINGLE + 1, 1)
    ends = list(accumulate((len(x) + 1 for x in w), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends)]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, SUMMED):
        h = [digest(joined[s:e], SEED) for s, e in zip(starts[at : min(at + SUMMED, n)], ends[min(SHINGLE, len(w)) - 1 + at :], strict=False)]
        votes += np.unpackbits(np.array(h, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches):
        x = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(x)], ["doc_id", "text_hash", "fp"])


def masks(level: int) -> list[int]:
    """Sets of bits fixed after so many splits; the children of mask i are masks 4 * i to 4 * i + 3 of the next level."""
    found = [0]
    for _ in range(level):
        split = []
        for m in found:
            free = [b for b in range(64) if not m >> b & 1]
            split += [m | sum(1 << b for b in free[k::SPLITS]) for k in range(SPLITS)]
        found = split
    return found


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def close(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within the radius in the same group. fp: uint64; group: sorted numbers."""
    n = len(fp)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T.reshape(64, blocks, 64), axis=2, bitorder="little")
    planes = np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]
    last = np.searchsorted(group, group, side="right") - 1  # of the same group
    row = np.arange(n)
    count = np.where(last > row, last // 64 - row // 64 + 1, 0)
    q = np.repeat(row, count)
    k = q // 64 + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
    low = np.maximum(q + 1 - 64 * k, 0).astype(np.uint64)  # later rows of the group only
    high = np.minimum(last[q] - 64 * k, 63).astype(np.uint64)
    valid = np.where(low > high, np.uint64(0), (ALL << np.minimum(low, np.uint64(63))) & (ALL >> (np.uint64(63) - high)))
    one = np.zeros(len(q), np.uint64)
    two, over = one.copy(), ~valid
    for b in range(64):
        x = planes[b][k] ^ (np.uint64(0) - ((fp[q] >> np.uint64(b)) & np.uint64(1)))
        carry = one & x
        one ^= x
        over |= two & carry  # a fourth difference
        two ^= carry
        if b % 8 == 7:
            alive = over != ALL
            if not alive.all():
                q, k, one, two, over = q[alive], k[alive], one[alive], two[alive], over[alive]
            if not len(q):
                break
    at, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[at], 64 * k[at] + bit


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position is linked with, through others too."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links that span each key's components. Holds whole keys, of BUCKET rows at most, up to BATCH_ROWS."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        new = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        group = np.concatenate([[0], np.cumsum(new)])
        label = joined(len(rows), *close(rows[:, 2].view(np.uint64).copy(), group))
        own = np.flatnonzero(label != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[label[own], 2].copy()), pa.array(rows[own, 2].copy())], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "value", "fp")], axis=1))
        if sum(map(len, held)) >= BATCH_ROWS:
            rows = np.concatenate(held)
            end = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(end[-1]) + 1 if len(end) else 0  # the last key may go on
            yield from links(rows[:cut])
            held = [rows[cut:]]
    if held:
        yield from links(np.concatenate(held))


def links(prints: DataFrame) -> DataFrame:
    """prints: fp, distinct. Pairs a, b within the radius that connect whatever the radius connects."""
    level, frontier, found = 2, prints.select(F.lit(0).alias("parent"), "fp"), None
    size = 4**level
    while True:
        at = masks(level)
        base = F.col("parent") * size
        keys = F.transform(F.sequence(base, base + size - 1), lambda i: F.struct(i.cast("int").alias("mask"), F.col("fp").bitwiseAND(F.get(F.array(*(F.lit(signed(m)) for m in at)), i)).alias("value")))
        rows = frontier.select("fp", F.inline(keys))
        held = checkpointed_counts(rows)
        few = held.filter(F.col("n") <= BUCKET).select("mask", "value", "fp")
        pairs = few.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(linked, "a bigint, b bigint")
        found = pairs if found is None else found.unionByName(pairs)
        many = held.filter(F.col("n") > BUCKET)
        if many.isEmpty():
            return found.distinct()
        level, size, frontier = level + 1, SPLITS, many.select(F.col("mask").alias("parent"), "fp")


def checkpointed_counts(rows: DataFrame) -> DataFrame:
    """Rows whose key has others, with the key's number of rows."""
    counts = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
    return words.checkpointed(rows.join(counts, ["mask", "value"]))


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, distinct: all edges, their reverses, and each end with itself."""
    a, b = F.col("a"), F.col("b")
    pairs = (F.struct(x.alias("a"), y.alias("b")) for x, y in ((a, b), (b, a), (a, a), (b, b)))
    return edges.select(F.inline(F.array(*pairs))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) of all ends of edges a, b. Rounds: labels of neighbours, then of one's label."""
    both = words.checkpointed(both_ways(edges))
    labels = words.checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        own = F.when(F.col("a") == F.col("b"), F.col("label"))
        new = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"), F.min(own).alias("old"))
        up = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = words.checkpointed(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, label (of the component), component_id: a row per document."""
    words.ship(documents.sparkSession)
    words.small_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    slim = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    own = words.checkpointed(slim.mapInArrow(fingerprinted, f"doc_id {kind}, text_hash bigint, fp bigint"))
    prints = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(prints.select("fp")))
    members = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = members.groupBy("label").agg(F.min("least").alias("component_id"))
    return own.join(members.join(ids, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: a row per document."""
    return classes(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents' columns; of each component the row with the smallest id (null last), of equal ids that of the smallest
    text hash, of equal rows one."""
    first = classes(documents).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one")).select("one.*")
    own, hashed = documents.alias("d"), F.xxhash64(F.col("d.text").cast("string"))
    kept = own.join(first.distinct().alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (hashed == F.col("f.text_hash")), "left_semi")
    # Rows of equal id and text are in one component. Only ids with several such rows meet again.
    keys = kept.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    if keys.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("_hash", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
