"""Exact repeats by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that a string of LENGTH bytes covers goes if that string starts anywhere else too, in the same text or another.

1. Each string of LENGTH bytes owns one anchor: of its substrings of GRAM bytes the one with the least hash, leftmost. Equal
   strings own equal anchors. A run of strings with one anchor is a segment; neighbours share no string.
2. Grams that occur once leave. Of the rest, equal segments need no look inside: all their strings repeat.
3. One of each kind of segment is gathered with the others of its gram. Their Burrows-Wheeler transform is expanded
   breadth-first: backward extensions of an interval at length l fix the common prefixes of value l, by increasing value,
   until LENGTH; borders of suffixes that are still open then have a common prefix of LENGTH at least.
4. A gram with over BUCKET kinds of segments (a passage in very many contexts) is not gathered: its strings are counted by
   128-bit hashes instead, pre-aggregated, so no task holds them.

Whole segments are compared by 128-bit hashes, strings within them by their bytes. Memory of a task: BATCH_BYTES of segments
(about 200 times that in arrays), or one text.

Defined cases: null text is empty; texts below LENGTH bytes lose nothing; rows with the same id and text repeat each other,
and each has its own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

LENGTH, GRAM = 400, 200
BUCKET = 400
BATCH_BYTES = 1 << 18
SLICE_BYTES = 1 << 20
POSITION = np.uint64((1 << 30) - 1)
KEY = ["doc_id", "text_hash"]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, gram hash, segment's start, last string's start; two hashes of the segment."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    n = len(data) - GRAM + 1
    if n < LENGTH - GRAM + 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hasher = words.Hasher(data)
    gram = hasher.prefix[GRAM:] - hasher.prefix[:-GRAM]
    gram *= hasher.down[:n]
    gram = words.mix(gram)
    del hasher
    low = gram & ~POSITION
    low |= np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= LENGTH - GRAM + 1:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    own = (low & POSITION).astype(np.int64)
    start = np.arange(len(own))
    doc = np.searchsorted(offsets, start, side="right") - 1
    whole = start + LENGTH <= offsets[doc + 1]
    start, own, doc = start[whole], own[whole], doc[whole]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    first, end, own, doc = start[new], start[last], own[new], doc[new]
    buffer = memoryview(data)
    digest = xxhash.xxh3_128_digest
    full = np.frombuffer(b"".join([digest(buffer[a : b + LENGTH]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    mixed = words.mix(full[:, 0] + (own - first).astype(np.uint64))
    return doc, gram[own].view(np.int64), first - offsets[doc], end - offsets[doc], mixed.view(np.int64), full[:, 1].copy().view(np.int64)


def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches, limit=SLICE_BYTES):
        doc, gram, first, end, full, more = anchors(texts)
        ids = [part.column(k).take(pa.array(doc)) for k in KEY]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(gram), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(full), pa.array(more)], [*KEY, "gram", "first", "end", "full", "more"])


def suffix_array(data: np.ndarray, left: np.ndarray, segment: np.ndarray, segments: int) -> np.ndarray:
    """data: 1 to 256, and 0 after each segment. left: symbols before the segment's end. Prefix doubling on packed symbols;
    the ends of segments differ, by their order, and come before all else."""
    n, packed = len(data), np.zeros(len(data), np.int64)
    for k in range(7):
        shifted = np.zeros(n, np.int64)
        shifted[: n - k] = data[k:]
        packed = packed << 9 | np.where(left >= k, shifted, 0)
    width, rank = 7, packed
    while True:
        if width > 7:
            after = np.where(left >= half, rank[np.minimum(np.arange(n) + half, n - 1)] + segments, segment)
            rank = rank * np.int64(n + segments + 1) + after
        order = np.argsort(rank)
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        half = width
        width *= 2


def open_borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where neighbours in the suffix array share `length` symbols at least: flags of places 1 to n - 1.

    Level l holds intervals of strings of l symbols. Each is extended backwards by the symbols before its suffixes; where an
    extension's right border is open, that border's common prefix is l, and the extension is expanded in the next level.
    Ends of segments extend nothing but the empty string, since they occur once.
    """
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    previous = symbols[order - 1]
    back = inverse[order - 1]
    done = np.zeros(n + 1, bool)
    done[0] = done[n] = True
    left, right = np.array([0]), np.array([n - 1])
    many = int(symbols.max()) + 1
    for level in range(length):
        size = right - left + 1
        own = np.repeat(np.arange(len(left)), size)
        at = np.arange(int(size.sum())) + np.repeat(left - (np.cumsum(size) - size), size)
        symbol = previous[at]
        if level:
            byte = symbol <= 256
            own, at, symbol = own[byte], at[byte], symbol[byte]
        if not len(at):
            break
        key = own * many + symbol
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.concatenate([new[1:], [len(key)]]) - 1
        left, right = back[at[by[new]]], back[at[by[last]]]
        fresh = ~done[right + 1]
        left, right = left[fresh], right[fresh]
        done[right + 1] = True
    return ~done[1:n]


def repeated(segments: list[bytes]) -> list[np.ndarray]:
    """Of each segment: flags of its strings of LENGTH bytes that start elsewhere among the segments, too."""
    data = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(len(data) + len(segments), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = data
    segment = np.repeat(np.arange(len(segments)), sizes + 1)
    left = ends[segment] - np.arange(len(symbols))
    order = suffix_array(symbols, left, segment, len(segments))
    symbols[ends] = 257 + np.arange(len(segments))
    shared = np.flatnonzero(open_borders(symbols, order, LENGTH)) + 1
    a, b = order[shared - 1], order[shared]
    both = (left[a] >= LENGTH) & (left[b] >= LENGTH)
    found = np.zeros(len(symbols), bool)
    found[a[both]] = found[b[both]] = True
    return [found[e - s : e - LENGTH + 1] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


SPANS = "from int, to int"


def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by gram, whole grams at a time: the spans of segments of one kind each that repeat."""
    held: list[dict] = []
    size = 0

    def spans(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row, flags in zip(rows, repeated([r["segment"] for r in rows]) if rows else [], strict=True):
            if row["n"] == 1 and flags.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))) + row["first"]
                out += [(row["doc_id"], row["text_hash"], a, b - 1 + LENGTH) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], [*KEY, "from", "to"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in batch.to_pylist():
            if size >= BATCH_BYTES and row["gram"] != held[-1]["gram"]:
                yield from spans(held)
                held, size = [], 0
            held.append(row)
            size += len(row["segment"])
    if held:
        yield from spans(held)


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes of the segments, by two hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            segment = memoryview(part.column(batch.schema.get_field_index("segment"))[0].as_py())
            n = len(segment) - LENGTH + 1
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(segment[k : k + LENGTH]) for k in range(n)]), "<i8").reshape(-1, 2)
            start = part.column(batch.schema.get_field_index("first"))[0].as_py() + np.arange(n)
            ids = [part.column(batch.schema.get_field_index(k)).take(pa.array(np.zeros(n, np.int64))) for k in KEY]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], [*KEY, "from", "full", "more"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches):
        removed, runs, digests = [], [], []
        for text, spans in zip(texts, part.column(part.schema.get_field_index("spans")).to_pylist(), strict=True):
            kept, reach, gone, n = hashlib.sha256(), 0, 0, 0
            view = memoryview(text)
            for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
                n += a > reach or not gone  # else it goes on with the run
                if a > reach:
                    kept.update(view[reach:a])
                gone += max(0, b - max(a, reach))
                reach = max(reach, b)
            kept.update(view[reach:])
            removed.append(gone)
            runs.append(n)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, from, to (bytes from 0): spans of repeated bytes. They can overlap, and repeat for repeated rows."""
    words.ship(documents.sparkSession)
    rows, kind = texts(documents), documents.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}, text_hash bigint"
    found = rows.mapInArrow(anchored, f"{ids}, gram bigint, first int, end int, full bigint, more bigint")
    twice = found.groupBy("gram").agg(F.count("*").alias("places")).filter("places > 1").select("gram")
    alive = words.checkpointed(found.join(twice, "gram"))
    kinds = alive.groupBy("gram", "full", "more").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "end")).alias("one"))
    whole = alive.join(kinds.filter("n > 1").select("gram", "full", "more"), ["gram", "full", "more"])
    spans = whole.select(*KEY, F.col("first").alias("from"), (F.col("end") + LENGTH).alias("to"))
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    members = kinds.join(several, "gram").select("one.*", "gram", "n", "kinds")

    def segments(of: DataFrame) -> DataFrame:
        joined = of.alias("m").join(rows.alias("d"), same("m", "d"))
        piece = F.substring(F.col("d.text").cast("binary"), F.col("first") + 1, F.col("end") - F.col("first") + LENGTH)
        return joined.select("m.doc_id", "m.text_hash", "gram", "n", "first", piece.alias("segment"))

    few = segments(members.filter(F.col("kinds") <= BUCKET)).dropDuplicates([*KEY, "first"])
    inner = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(expanded, f"{ids}, {SPANS}")
    many = segments(members.filter(F.col("kinds") > BUCKET)).dropDuplicates([*KEY, "first"]).mapInArrow(strings, f"{ids}, from int, full bigint, more bigint")
    often = many.groupBy("full", "more").agg(F.count("*").alias("places")).filter("places > 1").select("full", "more")
    counted = many.join(often, ["full", "more"]).select(*KEY, "from", (F.col("from") + LENGTH).alias("to"))
    return spans.unionByName(inner).unionByName(counted)


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    spans = repeats(documents).groupBy(*KEY).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = texts(documents).alias("d").join(spans.alias("s"), same("d", "s"), "left").select("d.doc_id", "d.text", "s.spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
