"""Hard negatives by a vertical scan over columns of vectors (branch and bound on decomposed data).

Vectors lie in blocks of up to BLOCK rows, one column per dimension, rows in order of label. Columns are read in descending order
of the anchors' own components' magnitude. What the columns not yet read can add to a score is bounded, and so is what all of a
block's columns can, by each column's least and greatest value in the block. Rows whose bounds show that they cannot be in the
result leave the anchor's bitmap, and only the others' next components are read, until all are read and the scores that are left
are exact.

1. Positives: the first POSITIVES other rows of the anchor's label. A row leaves when POSITIVES rows are certain to be before it.
2. Negatives: the first NEGATIVES rows of another label whose score is in the window of a positive, from its score times
   LOW / 100 up to it. A row leaves when it is certain to be outside of each window or, within a window,
   NEGATIVES rows that are certain to be inside are certain to be before it.

Both are scans of all blocks by all anchors. Anchors are packed (up to ANCHORS a row). A task holds one block and one pack at a
time, meets some of the blocks with some of the packs, and carries from block to block what it has found for each anchor, which is
what bounds are held against. Blocks and packs are read from where they are kept, not copied for each other: the disk
that is used grows with the table, and so do the rows that tasks return, at most TASKS times an anchor's result, which Spark ranks. The work
grows with rows times anchors. Nothing goes through the driver but the counts of blocks and anchors.

Of a pack, the anchors are scanned together where doubles (or floats) hold all of the scores exactly: the product of the
greatest lengths says so. Others are scanned one by one, each in the order of its own components, STEP columns at a time, in integers.

A component x counts as floor(SCALE * x), in double precision, held within +-2**28, so that sums of 127 dimensions fit a long.
Scores are exact integers. Higher scores come first, of equal ones the smaller id, then the row's place among the blocks.

Defined cases: rows with a null id, label or vector or a component that is null or not finite take no part; dimensions that a
shorter vector lacks count as 0; an empty vector scores 0; each of repeated rows is a row of its own, and of repeated anchors
each has its result; an anchor without a positive, or a positive without a negative, has no rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamhouse.llm import words

BLOCK = 4096
ANCHORS = 4096
#: Anchors that a task holds, about, and parts that the blocks are in.
ANCHORS_PER_TASK = 4 * ANCHORS
TASKS = 24
#: Anchors of a pack that are scanned together, so that their scores of a block stay in the processor's cache.
TILE = 128
#: Bytes of components that are put in order of label at once.
HELD_BYTES = 1 << 24
STEP = 8
SCALE = 256
BOUND = 1 << 28
POSITIVES, NEGATIVES, LOW = 5, 5, 80
ROW_BITS = 12
BLOCKS_PER_TASK = 1 << 20
#: Scores stay below that.
FAR = 1 << 62


# --- blocks

BLOCK_COLUMNS = ["block", "least", "greatest", "ids", "labels", "columns"]
BLOCKS = "block bigint, least bigint, greatest bigint, ids binary, labels binary, columns binary"

def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scaled components (rows by dimensions), and which rows are whole: not null, all components finite."""
    flat = vectors.flatten()
    value = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    n, wide = len(vectors), int(size.max(initial=0))
    row, start = np.repeat(np.arange(n), size), np.cumsum(size) - size
    fine = np.isfinite(value)
    whole = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool) & (np.bincount(row[~fine], minlength=n) == 0)
    out = np.zeros((n, wide), np.int64)
    scaled = np.clip(np.floor(SCALE * np.where(fine, value, 0.0)), -BOUND, BOUND)
    out[row, np.arange(len(value)) - start[row]] = scaled.astype(np.int64)
    return out, whole


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, vector to blocks: number, least and greatest label; ids, labels and columns as bytes. Rows that take no part leave."""
    task, seq = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def blocks() -> Iterator[pa.RecordBatch]:
        """What is held, in order of label and id."""
        nonlocal held, seq
        wide = max(v.shape[1] for *_, v in held)
        ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        vectors = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for *_, v in held])
        held, by = [], np.lexsort((ids, labels))
        for at in range(0, len(by), BLOCK):
            rows = by[at : at + BLOCK]
            parts = [ids[rows].astype("<i8"), labels[rows].astype("<i8"), np.ascontiguousarray(vectors[rows].T.astype("<i4"))]
            numbers = [task * BLOCKS_PER_TASK + seq, int(labels[rows[0]]), int(labels[rows[-1]])]
            seq += 1
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], BLOCK_COLUMNS)

    for batch in batches:
        keep = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        vectors, whole = matrix(keep.column(2))
        if whole.any():
            held.append((*(keep.column(k).to_numpy()[whole].astype(np.int64) for k in (0, 1)), vectors[whole].astype(np.int32)))
        if sum(h[2].nbytes for h in held) >= HELD_BYTES:
            yield from blocks()
    if held:
        yield from blocks()


def opened(ids: bytes, labels: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
    return a, b, np.frombuffer(columns, "<i4").reshape(-1, len(a))


def anchors_of(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The rows of blocks whose id is divisible by `every`: row, anchor, label, vector."""
    for batch in batches:
        for own in batch.to_pylist():
            ids, labels, columns = opened(own["ids"], own["labels"], own["columns"])
            at = np.flatnonzero(ids % every == 0)
            rows = (own["block"] << ROW_BITS) + at
            vectors = pa.array(list(np.ascontiguousarray(columns[:, at].T)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids[at]), pa.array(labels[at]), vectors], ["row", "anchor", "label", "vector"])


# --- the vertical scan


class Scan:
    """One anchor over the columns of a block."""

    def __init__(self, columns: np.ndarray, low: np.ndarray, high: np.ndarray, vector: np.ndarray, alive: np.ndarray):
        own = np.zeros(len(columns), np.int64)
        own[: len(vector)] = vector[: len(columns)]
        self.order = np.argsort(-np.abs(own), kind="stable")
        self.own, self.columns = own[self.order], columns
        least, most = np.minimum(self.own * low[self.order], self.own * high[self.order]), np.maximum(self.own * low[self.order], self.own * high[self.order])
        #: What the columns from the k-th on can add, at least and at most.
        self.least, self.most = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (least, most))
        self.alive = alive  # the bitmap, as places
        self.score = np.zeros(len(alive), np.int64)
        self.read = 0

    def step(self) -> bool:
        """Read the next columns of the rows that are left; False: all are read."""
        if self.read >= len(self.own) or not len(self.alive):
            return False
        for k in range(self.read, min(self.read + STEP, len(self.own))):
            if self.own[k]:
                self.score += self.own[k] * self.columns[self.order[k]][self.alive]
        self.read = min(self.read + STEP, len(self.own))
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.score + self.least[self.read], self.score + self.most[self.read]

    def keep(self, flags: np.ndarray) -> None:
        if not flags.all():
            self.alive, self.score = self.alive[flags], self.score[flags]


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th greatest; None: there are fewer."""
    return None if len(values) < k else int(np.partition(values, len(values) - k)[len(values) - k])


def first(ids: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The first k of the rows at `at`: by score, then id, then place."""
    return np.lexsort((at, ids[at], -score))[:k]


def positives_in(scan: Scan, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the scan's first k rows."""
    while scan.step():
        low, high = scan.bounds()
        sure = kth(low, k)
        if sure is not None:
            scan.keep(high >= sure)
    by = first(ids, scan.score, scan.alive, k)
    return scan.alive[by], scan.score[by]


def negatives_in(scan: Scan, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores: places and scores of its first k rows."""
    some = {w for w in windows if w[0] <= w[1]}
    scan.keep(np.full(len(scan.alive), bool(some)))
    while scan.step():
        low, high = scan.bounds()
        wanted = np.zeros(len(low), bool)
        for a, b in some:
            may = (high >= a) & (low <= b)
            sure = kth(low[(low >= a) & (high <= b)], k)
            wanted |= may if sure is None else may & (high >= sure)
        scan.keep(wanted)
    out = []
    for a, b in windows:
        inside = np.flatnonzero((scan.score >= a) & (scan.score <= b))
        by = inside[first(ids, scan.score[inside], scan.alive[inside], k)]
        out.append((scan.alive[by], scan.score[by]))
    return out


class Block:
    """A block and what bounds its rows' scores."""

    def __init__(self, number: int, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.first, self.ids, self.labels, self.columns = number << ROW_BITS, ids, labels, columns
        self.low, self.high = (f(columns, axis=1, initial=0).astype(np.int64) for f in (np.min, np.max))
        #: The labels, and from which row to which each is.
        self.kinds, starts = np.unique(labels, return_index=True)
        self.ends = np.append(starts, len(labels))
        self.length = float(np.sqrt(np.square(columns, dtype=np.float64).sum(axis=0).max(initial=0)))
        self.values: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self.values:
            self.values[kind] = self.columns.astype(kind)
        return self.values[kind]

    def rows(self, label: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.kinds, label))
        return (int(self.ends[at]), int(self.ends[at + 1])) if at < len(self.kinds) and self.kinds[at] == label else (0, 0)


class Pack:
    """Anchors, in order of label, and the first `k` rows that have been found for each of an anchor's windows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.rows, self.ids, self.labels, self.vectors, self.k = rows, ids, labels, vectors, k
        #: By anchor and window: least and greatest score inside; how many are found; they, first ones first.
        self.low, self.high = low, high
        self.count = np.zeros(low.shape, np.int64)
        self.score, self.id, self.other = (np.zeros((*low.shape, k), np.int64) for _ in range(3))
        kinds, starts = np.unique(labels, return_index=True)
        self.kinds = list(zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(labels)], strict=True))
        self.order = np.argsort(-np.abs(vectors).sum(axis=0, dtype=np.float64), kind="stable")
        self.lengths = np.sqrt(np.square(vectors, dtype=np.float64).sum(axis=1))

    def least(self, anchors: np.ndarray, smallest: int) -> np.ndarray:
        """By window, the least score by which a row with at least that id can still be among the first."""
        last, full = self.k - 1, self.count[anchors] == self.k
        beyond = self.score[anchors, :, last] + (self.id[anchors, :, last] < smallest)
        return np.where(full, np.maximum(beyond, self.low[anchors]), self.low[anchors])

    def add(self, anchor: np.ndarray, window: np.ndarray, score: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        """Rows inside of windows: the first ones stay."""
        wide = self.low.shape[1]
        group = anchor * wide + window
        touched = np.unique(group)
        there = np.arange(self.k)[None] < self.count.reshape(-1)[touched][:, None]
        old = [np.broadcast_to(touched[:, None], there.shape)[there], *(x.reshape(-1, self.k)[touched][there] for x in (self.score, self.id, self.other))]
        group, score, ids, other = (np.concatenate(x) for x in zip(old, (group, score, ids, other), strict=True))
        by = np.lexsort((other, ids, -score, group))
        group = group[by]
        rank = np.arange(len(by)) - np.searchsorted(group, group)
        by, group, rank = by[rank < self.k], group[rank < self.k], rank[rank < self.k]
        for x, new in ((self.score, score), (self.id, ids), (self.other, other)):
            x.reshape(-1, self.k)[group, rank] = new[by]
        self.count.reshape(-1)[:] = np.maximum(self.count.reshape(-1), np.bincount(group, minlength=self.count.size))

    def meet(self, block: Block, same: bool) -> None:
        """same: rows of the anchor's label, but for itself; else those of other labels."""
        if (self.lengths.max(initial=0) + 1) * (block.length + 1) < 2.0**50:
            self.together(block, same)
            return
        for a in range(len(self.rows)):
            alike = block.labels == self.labels[a]
            at = self.rows[a] - block.first
            if same and 0 <= at < len(alike):
                alike[at] = False
            scan = Scan(block.columns, block.low, block.high, self.vectors[a].astype(np.int64), np.flatnonzero(alike if same else ~alike))
            told = [positives_in(scan, block.ids, self.k)] if same else negatives_in(scan, block.ids, list(zip(self.low[a].tolist(), self.high[a].tolist(), strict=True)), self.k)
            for w, (place, score) in enumerate(told):
                self.add(np.full(len(place), a), np.full(len(place), w), score, block.ids[place], block.first + place)

    def together(self, block: Block, same: bool) -> None:
        size, parts, free = len(block.ids), [], []
        for label, a, b in self.kinds:
            start, end = block.rows(label)
            if same:
                parts += [(np.arange(a, b), start, end)]
            elif start == end:
                free += [np.arange(a, b)]
            else:
                parts += [(np.arange(a, b), 0, start), (np.arange(a, b), end, size)]
        if free:
            parts += [(np.concatenate(free), 0, size)]
        parts = [p for p in parts if p[1] < p[2]]
        if not parts:
            return
        # A block whose columns' ranges leave an anchor nothing is not read for it.
        dims = min(len(block.columns), self.vectors.shape[1])
        up, down = np.maximum(self.vectors[:, :dims], 0).astype(np.float64), np.minimum(self.vectors[:, :dims], 0).astype(np.float64)
        most, least = (up @ x[:dims] + down @ y[:dims] for x, y in ((block.high, block.low), (block.low, block.high)))
        asked = self.least(np.arange(len(self.rows)), int(block.ids.min()))
        some = asked <= self.high
        open_ = (most >= np.where(some, asked, FAR).min(axis=1)) & (least <= np.where(some, self.high, -FAR).max(axis=1))
        kind = np.float32 if (self.lengths.max(initial=0) + 1) * (block.length + 1) < 2.0**22 else np.float64
        scan = Tiles(block, self.order[self.order < dims], kind)
        for anchors, start, end in parts:
            self.tiles(scan, anchors[open_[anchors]], start, end, same)

    def tiles(self, scan: Tiles, anchors: np.ndarray, start: int, end: int, same: bool) -> None:
        for at in range(0, len(anchors) if start < end else 0, TILE):
            some, block = anchors[at : at + TILE], scan.block
            asked = self.least(some, int(block.ids[start:end].min()))
            out = self.rows[some] - block.first if same else None
            poor = self.count[some] < self.k
            a, row, score = scan.scores(self.vectors[some], asked, self.high[some], poor, start, end, out, self.k)
            hit, w = np.nonzero((score[:, None] >= asked[a]) & (score[:, None] <= self.high[some[a]]))
            p, row, score = some[a[hit]], row[hit], score[hit]
            ids, last = block.ids[row], (p, w, self.k - 1)
            before = (self.count[p, w] < self.k) | (score > self.score[last]) | (ids <= self.id[last])
            if before.any():
                self.add(p[before], w[before], score[before], ids[before], block.first + row[before])

    def found(self) -> pa.RecordBatch:
        a, w, i = np.nonzero(np.arange(self.k) < self.count[:, :, None])
        columns = [self.rows[a], self.ids[a], w, self.other[a, w, i], self.id[a, w, i], self.score[a, w, i]]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], ["row", "anchor", "place", "other", "other_id", "score"])


class Tiles:
    """The vertical scan of some anchors over some rows of a block at once. All numbers are whole and exact.

    The first columns of the order are read for all. What the others can add to a score is at most the product of the lengths
    (rounded up) of the anchor's and the row's unread components; the product is one more column of the sum, which is so the
    greatest score that a row can have. Of rows that this leaves in the bitmap, the other columns are read: of each by itself, or of all
    where they are many."""

    def __init__(self, block: Block, order: np.ndarray, kind: type):
        self.block, self.kind, self.order = block, kind, order
        self.head = len(order) - len(order) // 8
        values = block.of(kind)[order]
        rest = values[self.head :]
        bound = np.ceil(np.sqrt(np.square(rest, dtype=np.float64).sum(axis=0)) * (1 + 1e-9)).astype(kind)[None]
        self.first, self.rest = np.concatenate([values[: self.head], bound]), np.concatenate([rest, bound])
        self.by_row = np.ascontiguousarray(self.rest.T)

    def scores(self, vectors: np.ndarray, asked: np.ndarray, high: np.ndarray, poor: np.ndarray, start: int, end: int, out: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors (by place), rows and scores of all that may count. asked, high, poor: by anchor and window, least and greatest score
        that does, and whether fewer than k rows are found; asked rises by what is met here. out: a row of each anchor that does not count."""
        own = vectors[:, self.order].astype(self.kind)
        bound = np.ceil(np.sqrt(np.square(own[:, self.head :], dtype=np.float64).sum(axis=1)) * (1 + 1e-9)).astype(self.kind)[:, None]
        first, rest = np.concatenate([own[:, : self.head], bound], axis=1), np.concatenate([own[:, self.head :], -bound], axis=1)
        score = first @ self.first[:, start:end]
        if out is not None:
            here = np.flatnonzero((out >= start) & (out < end))
            score[here, out[here] - start] = -np.inf
        place = marked(score >= self.least(asked, high))
        if len(place) * 32 < score.size:
            a, row = np.divmod(place, end - start)
            score = score.reshape(-1)[place] + np.einsum("ij,ij->i", rest[a], self.by_row[start + row])
        else:
            score += rest @ self.rest[:, start:end]
            place = marked(score >= self.least(asked, high))
            if len(place) * 64 > score.size and end - start > k:
                for w in range(asked.shape[1]):
                    some = np.flatnonzero(poor[:, w] & (asked[:, w] <= high[:, w]))
                    inside = np.where(score[some] <= high[some, w, None].astype(self.kind), score[some], -np.inf)
                    sure = np.partition(inside, end - start - k, axis=1)[:, end - start - k]
                    asked[some, w] = np.maximum(asked[some, w], np.where(np.isfinite(sure), sure, -FAR).astype(np.int64))
                place = marked(score >= self.least(asked, high))
            a, row = np.divmod(place, end - start)
            score = score.reshape(-1)[place]
        fine = (score <= np.where(asked <= high, high, -FAR).max(axis=1).astype(self.kind)[a]) & np.isfinite(score)
        return a[fine], start + row[fine], score[fine].astype(np.int64)

    def least(self, asked: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over an anchor's windows."""
        return np.where(asked <= high, asked, FAR).min(axis=1).astype(self.kind)[:, None]


def marked(flags: np.ndarray) -> np.ndarray:
    """Places of the flags that are set, in order; fast where few are."""
    flat = flags.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(some) * 32 > whole:
        return np.flatnonzero(flat)
    byte = (some[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([byte[flat[byte]], whole + np.flatnonzero(flat[whole:])])


PACK_COLUMNS = ["least_kind", "greatest_kind", "rows", "anchors", "kinds", "vectors", "low", "high"]
PACKS = "least_kind bigint, greatest_kind bigint, rows binary, anchors binary, kinds binary, vectors binary, low binary, high binary"


def gathered(batches: Iterator[pa.RecordBatch], low_percent: int | None) -> Iterator[pa.RecordBatch]:
    """Anchors to packs, in order of label. low_percent None: one window, of all scores; else one for each of the `found` positives."""
    held: list[dict] = []

    def pack() -> pa.RecordBatch:
        nonlocal held
        some, held = sorted(held, key=lambda x: (x["label"], x["row"])), []
        vectors = np.zeros((len(some), max(len(x["vector"]) for x in some)), "<i4")
        for i, x in enumerate(some):
            vectors[i, : len(x["vector"])] = x["vector"]
        windows = [(-FAR, FAR)] if low_percent is None else None
        told = [windows or [(-(-low_percent * p["score"] // 100), p["score"]) for p in x["found"]] for x in some]  # least and greatest integer score inside
        wide = max(map(len, told))
        low, high = (np.array([[w[k] for w in x] + [1 - k] * (wide - len(x)) for x in told], "<i8") for k in (0, 1))
        columns = [*(np.array([x[c] for x in some], "<i8") for c in ("row", "anchor", "label")), vectors, low, high]
        ends = [pa.array([some[i]["label"]], pa.int64()) for i in (0, -1)]
        return pa.RecordBatch.from_arrays([*ends, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], PACK_COLUMNS)

    for batch in batches:
        for x in batch.to_pylist():
            held.append(x | {"vector": np.array(x["vector"] or [], "<i4")})
            if len(held) >= ANCHORS:
                yield pack()
    if held:
        yield pack()


def scanned(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block and a pack each. What is found for a pack goes from block to block."""
    packs: dict[bytes, Pack] = {}
    block, last = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            parts = [batch.column(c)[i].as_buffer() for c in BLOCK_COLUMNS[3:] + PACK_COLUMNS[2:]]
            if (number := batch.column("block")[i].as_py()) != last:
                last, block = number, Block(number, *opened(*map(bytes, parts[:3])))
            rows, anchors, labels, *_ = (np.frombuffer(p, "<i8") for p in parts[3:6])
            key = bytes(parts[3])
            if key not in packs:
                vectors = np.array(np.frombuffer(parts[6], "<i4")).reshape(len(rows), -1)
                packs[key] = Pack(rows.copy(), anchors.copy(), labels.copy(), vectors, *(np.array(np.frombuffer(p, "<i8")).reshape(len(rows), -1) for p in parts[7:9]), k)
            packs[key].meet(block, same)
    for own in packs.values():
        yield own.found()


FOUND = "row bigint, anchor bigint, place bigint, other bigint, other_id bigint, score bigint"


# --- both searches


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of all blocks for each anchor and place, with their rank."""
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """vectors: vec_id, label, embedding. anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: ids divisible by `every`.

    A negative's score is between low/100 of the positive's and the positive's.
    """
    words.ship(vectors.sparkSession)
    slim = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    blocks = words.checkpointed(slim.mapInArrow(packed, BLOCKS))
    anchors = words.checkpointed(blocks.mapInArrow(partial(anchors_of, every=every), "row bigint, anchor bigint, label bigint, vector array<int>"))
    parts = max(1, -(-anchors.count() // ANCHORS_PER_TASK))

    def scan(of: DataFrame, k: int, low_percent: int | None) -> DataFrame:
        dealt = of.repartitionByRange(parts, "label", "row").coalesce(parts)
        packs = words.checkpointed(dealt.mapInArrow(partial(gathered, low_percent=low_percent), PACKS))
        # Every block meets every pack; for positives, but for those that have no label together.
        together = (F.col("least") <= F.col("greatest_kind")) & (F.col("greatest") >= F.col("least_kind")) if low_percent is None else F.lit(True)
        pairs = blocks.coalesce(TASKS).join(packs, together)
        return ranked(pairs.mapInArrow(partial(scanned, k=k, same=low_percent is None), FOUND), k)

    good = words.checkpointed(scan(anchors, positives, None))
    tops = good.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))
    bad = scan(anchors.join(tops, "row"), negatives, low)
    positive = good.select("row", F.col("anchor").alias("anchor_id"), (F.col("rank") - 1).cast("bigint").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return positive.join(bad.select("row", "place", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Wrong labels on purpose: where the id is divisible by `every`, the next label."""
    label: Column = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")
