"""SentencePiece encoding and decoding: N-best segmentation over the lattice of pieces.

A segmentation's score is the sum of its pieces' scores. A forward Viterbi pass gives the best score from the start to each
place; it is the exact rest of any path that is built from the end, so an A-star search backwards meets complete
segmentations in order of score. No piece holds a space mark behind another character, and none a newline, so a text's lattice is
a chain of chunks, each of which is searched once and kept, with the pieces of its best two segmentations. Chunks of up to SHORT
characters are searched many at once, longer ones one by one; it is the same search. The second segmentation of a text is the
best one with one chunk's second instead.

Spaces become marks, and one is added before the text; nothing else is normalised, so decoding gives the text back. A
character that no piece holds, and a space mark that the text itself has, become their UTF-8 bytes, at UNKNOWN below the
least score (of those above LEAST_SCORE; runs of space marks have a lower one).

Defined cases: null text is empty, and an empty text has no pieces, score 0 and no second segmentation; equal scores come in
order of search; repeated rows and ids each get their own row; an empty table gives no rows; other columns are ignored.
Chunks are kept for a task, up to KEPT, then anew, so memory is bounded whatever the vocabulary of the corpus.
"""

from __future__ import annotations

import gc
import re
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamhouse.llm import words

SPACE = "▁"
LEAST_SCORE = -1e8
UNKNOWN = 10
KEPT = 300_000
#: Bytes of text that a task works on at once.
SLICE_BYTES = 1 << 20
SHORT = 40
#: Arcs of the lattices that are searched at once.
ARCS = 1 << 20
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: A text's own space mark is cut out beforehand and stands as LITERAL.
LITERAL = f"\n{SPACE}"
#: BASE**i and BASE**-i.
POWERS = tuple(np.array([pow(b, i, 2**64) for i in range(SHORT + 1)], np.uint64) for b in (words.BASE, words.INVERSE))
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


def load(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, by id. Read by the driver; the table is a few hundred KB."""
    import sentencepiece  # the driver only

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Segmenter(dict):
    """chunk: ids of its best segmentation (as int32 bytes), its score, and how far the second one is below it. second: the second
one's ids, where there is one."""

    def __init__(self, table: list[tuple[str, float]]):
        self.second: dict[str, bytes] = {}
        byte = {f"<0x{b:02X}>": b for b in range(256)}
        self.bytes = dict(sorted((byte[p], i) for i, (p, _) in enumerate(table) if p in byte))
        self.ids = {p: (s, i) for i, (p, s) in enumerate(table) if p and p not in byte}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((s for s, _ in self.ids.values() if s > LEAST_SCORE), default=0.0) - UNKNOWN
        own = {i: bytes([b]) for b, i in self.bytes.items()}
        self.index()
        self.spelled = [own.get(i, p.replace(SPACE, " ").encode()) for i, (p, _) in enumerate(table)]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a chunk, or all where there are fewer."""
        size, get, longest = len(chunk), self.ids.get, self.longest
        best, into = [0.0], [[]]
        for end in range(1, size + 1):
            arcs, top = [], None
            for start in range(end - longest if end > longest else 0, end):
                if (known := get(chunk[start:end])) is not None:
                    to = best[start] + known[0]
                    arcs.append((to, start, known[1]))
                    if top is None or to > top:
                        top = to
            if not arcs or arcs[-1][1] != end - 1:
                to = best[end - 1] + self.unknown
                arcs.append((to, end - 1, -1))
                if top is None or to > top:
                    top = to
            into.append(arcs)
            best.append(top)
        # Each open path is sure to end at its score, so of the open paths only as many as are still wanted are kept.
        found, order, open_ = [], 0, [(-best[size], 0, size, None)]
        while open_ and len(found) < n:
            score, _, end, path = open_.pop(0)
            if not end:
                out = []
                while path:
                    start, piece, path = path
                    out += [self.bytes[b] for b in chunk[start].encode()] if piece < 0 else [piece]
                found.append((-score, out))
                continue
            rest, wanted = score + best[end], n - len(found)  # rest: less what lies behind
            for to, start, piece in into[end]:
                if len(open_) < wanted or rest - to < open_[-1][0]:
                    order += 1
                    insort(open_, (rest - to, order, start, (start, piece, path)))
                    del open_[wanted:]
        return found

    def keep(self, chunk: str, found: list[tuple[float, bytes]]) -> tuple[bytes, float, float]:
        (score, ids), *others = found
        if others:
            self.second[chunk] = others[0][1]
        self[chunk] = out = ids, score, score - others[0][0] if others else float("inf")
        return out

    def clear(self) -> None:
        super().clear()
        self.second.clear()

    def __missing__(self, chunk: str) -> tuple[bytes, float, float]:
        if chunk == LITERAL:
            return self.keep(chunk, [(self.unknown, np.array([self.bytes[b] for b in SPACE.encode()], np.int32).tobytes())])
        return self.keep(chunk, [(score, np.array(ids, np.int32).tobytes()) for score, ids in self.n_best(chunk, 2)])

    def learn(self, chunks: Iterable[str]) -> None:
        """Search many short chunks at once; others are searched when they are asked for."""
        by: dict[int, list[str]] = {}
        for c in chunks:
            if len(c) <= SHORT and c != LITERAL:
                by.setdefault(len(c), []).append(c)
        for size, group in by.items():
            many = max(1, ARCS // ((size + 1) * min(size, self.longest)))
            for at in range(0, len(group), many):
                some = group[at : at + many]
                (_, score, ids), (others, less, other_ids) = self.n_best_of(some, 2)
                gap = np.full(len(some), np.inf)
                gap[others] = score[others] - less
                self.update(zip(some, zip(ids, score.tolist(), gap.tolist(), strict=True), strict=True))
                self.second.update(zip([some[i] for i in others.tolist()], other_ids, strict=True))

    def n_best_of(self, chunks: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """As n_best(), of many chunks of one length at once: for each rank, which chunks have such a segmentation, their scores, their
        ids as int32 bytes."""
        m, size = len(chunks), len(chunks[0])
        best, arcs, pieces = self.lattices(chunks)
        wide = arcs.shape[1]
        # Each chunk's open paths, best first: what its score is, negative; where it has come to; its last node.
        open_, end, node = np.full((m, n), np.inf), np.zeros((m, n), np.int64), np.full((m, n), -1, np.int64)
        open_[:, 0], end[:, 0] = -best.reshape(m, -1)[:, size], size
        found, score, last = np.zeros(m, np.int64), np.full((m, n), np.inf), np.full((m, n), -1, np.int64)
        parent, piece, nodes = [], [], 0
        row = np.arange(m)
        while len(row):
            through = end[row, 0] == 0
            whole, on = row[through], row[~through]
            if len(whole):
                score[whole, found[whole]], last[whole, found[whole]] = open_[whole, 0], node[whole, 0]
                found[whole] += 1
                for x, none in ((open_, np.inf), (end, 0), (node, -1)):
                    x[whole, :-1], x[whole, -1] = x[whole, 1:], none
            at, path = end[on, 0], node[on, 0]
            place = on * (size + 1) + at
            ways = np.empty((len(on), n - 1 + wide))
            ways[:, : n - 1] = open_[on, 1:]
            np.subtract((open_[on, 0] + best[place])[:, None], arcs.take(place, axis=0), out=ways[:, n - 1 :])
            old_end, old_node, wanted = end[on, 1:], node[on, 1:], n - found[on]
            # Each open path is sure to end at its score, so of the open paths only as many as are still wanted are kept.
            for k in range(n):
                some = np.flatnonzero(wanted > k)
                which = on[some]
                open_[on, k] = np.inf
                if not len(some):
                    continue
                j = (ways if len(some) == len(on) else ways[some]).argmin(axis=1)
                open_[which, k] = value = ways[some, j]
                if k < n - 1:
                    ways[some, j] = np.inf
                new = (j >= n - 1) & (value < np.inf)
                kept = np.flatnonzero(j < n - 1)
                if len(kept):
                    end[which[kept], k], node[which[kept], k] = old_end[some[kept], j[kept]], old_node[some[kept], j[kept]]
                some, which, arc = some[new], which[new], j[new] - (n - 1)
                end[which, k], node[which, k] = at[some] - wide + arc, nodes + np.arange(len(some))
                parent.append(path[some])
                piece.append(pieces[place[some], arc])
                nodes += len(some)
            row = row[(found[row] < n) & (open_[row, 0] < np.inf)]
        parents, told, out = np.concatenate(parent), np.concatenate(piece), []
        for k in range(n):
            some = np.flatnonzero(found > k)
            out.append((some, -score[some, k], self.spelt(last[some, k], parents, told, [chunks[i] for i in some.tolist()])))
        return out

    def lattices(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By chunk and end: the best score to there; by start (the last is one before the end): the best score over the arc, and its
        piece, or one beyond the last where no piece holds the character."""
        m, size = len(chunks), len(chunks[0])
        wide, (up, down) = min(size, self.longest), POWERS
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(m, size).T.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((size + 1, m), np.uint64)
        np.cumsum(codes * up[:size, None], axis=0, out=prefix[1:])
        best, arcs, pieces = np.zeros((size + 1, m)), np.full((size + 1, wide, m), -np.inf), np.zeros((size + 1, wide, m), np.int32)
        for end in range(1, size + 1):
            start = max(0, end - wide)
            at = self.find(((prefix[end] - prefix[start:end]) * down[start:end, None]).reshape(-1)).reshape(end - start, m)
            to = best[start:end] + self.scores[at]
            none = to[-1] == -np.inf
            at[-1][none], to[-1][none] = len(self.scores), best[end - 1][none] + self.unknown
            arcs[end, wide - end + start :], pieces[end, wide - end + start :], best[end] = to, at, to.max(axis=0)
        return np.ascontiguousarray(best.T).reshape(-1), *(np.ascontiguousarray(x.transpose(2, 0, 1)).reshape(-1, wide) for x in (arcs, pieces))

    def spelt(self, node: np.ndarray, parent: np.ndarray, piece: np.ndarray, chunks: list[str]) -> list[bytes]:
        """The ids of paths, from their last nodes, which are the first pieces."""
        if not len(node):
            return []
        steps = []
        while (on := node >= 0).any():
            steps.append(np.where(on, piece[node], -1))
            node = np.where(on, parent[node], -1)
        path = np.stack(steps, axis=1)
        ends = np.cumsum((path >= 0).sum(axis=1)).tolist()
        flat = path[path >= 0]
        unknown = len(self.scores)
        joined = self.numbers[np.minimum(flat, len(self.numbers) - 1)].tobytes()
        out = [joined[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero((path == unknown).any(axis=1)).tolist():
            ids, at = [], 0
            for p in flat[ends[i - 1] if i else 0 : ends[i]].tolist():
                ids += [self.bytes[b] for b in chunks[i][at].encode()] if p == unknown else [int(self.numbers[p])]
                at += 1 if p == unknown else self.sizes[p]
            out[i] = np.array(ids, np.int32).tobytes()
        return out

    def index(self) -> None:
        """An open-addressed table of the pieces' hashes; an empty place has score -inf."""
        up, down = POWERS
        known = list(self.ids.items())
        self.scores = np.array([*(s for _, (s, _) in known), -np.inf])
        self.numbers = np.array([i for _, (_, i) in known], np.int32)
        self.sizes = [len(p) for p, _ in known]
        self.slots, self.held = np.zeros(SLOTS + len(known) + 1, np.uint64), np.full(SLOTS + len(known) + 1, len(known), np.int64)
        for i, (p, _) in enumerate(known):
            code = np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            key = (code * up[: len(p)]).sum(dtype=np.uint64)
            at = (int(key) * words.BASE & 2**64 - 1) >> (64 - SLOT_BITS)
            while self.slots[at]:
                at += 1
            self.slots[at], self.held[at] = key, i

    def find(self, key: np.ndarray) -> np.ndarray:
        at = (key * np.uint64(words.BASE) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        got = self.slots[at]
        todo = np.flatnonzero((got != key) & (got != 0))
        while len(todo):
            at[todo] += 1
            got[todo] = self.slots[at[todo]]
            todo = todo[(got[todo] != key[todo]) & (got[todo] != 0)]
        return np.where(got == key, self.held[at], len(self.numbers))

    @staticmethod
    def chunks(text: str) -> list[str]:
        if SPACE in text:
            parts = [CHUNKS.findall(p.replace(" ", SPACE)) for p in f" {text}".split(SPACE)]
            return [c for p in parts for c in (LITERAL, *p)][1:]
        return CHUNKS.findall(SPACE + text.replace(" ", SPACE))

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, float, float | None, bytes | None]]:
        """Of each text: ids as int32 bytes and score of the best segmentation; score and ids of the second one."""
        chunks = [self.chunks(t) if t else [] for t in texts]
        every = set().union(*chunks)
        new = list(filterfalse(self.__contains__, every))
        if len(self) + len(new) > KEPT:
            self.clear()
            new = list(every)
        collects = gc.isenabled()
        gc.disable()  # many small tuples are made here, and no cycles
        try:
            self.learn(new)
        finally:
            if collects:
                gc.enable()
        out: list[tuple[bytes, float, float | None, bytes | None]] = []
        for cs in chunks:
            if not cs:
                out.append((b"", 0.0, None, None))
                continue
            ids, scores, gaps = zip(*map(self.__getitem__, cs), strict=True)
            score, gap = sum(scores), min(gaps)
            if gap == float("inf"):
                out.append((b"".join(ids), float(score), None, None))
                continue
            at = gaps.index(gap)
            head, tail = b"".join(ids[:at]), b"".join(ids[at + 1 :])
            out.append((head + ids[at] + tail, float(score), score - gap, head + self.second[cs[at]] + tail))
        return out

    def decode(self, ids: bytes) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, np.int32).tolist()])[1:].decode()

    def alike(self, ids: bytes, others: bytes) -> bool:
        """Whether both decode to one text. What they begin and end with together is not decoded."""
        a, b = (np.frombuffer(x, np.int32) for x in (ids, others))
        for _ in range(2):
            m = min(len(a), len(b))
            apart = a[:m] != b[:m]
            at = int(apart.argmax()) if apart.any() else m
            a, b = a[at:][::-1], b[at:][::-1]
        x, y = (b"".join([self.spelled[i] for i in p.tolist()]) for p in (a, b))
        return x == y


_segmenters: dict[int, Segmenter] = {}


def segmenter(table) -> Segmenter:
    """One for each broadcast table in a worker."""
    if table.id not in _segmenters:
        _segmenters.clear()
        words.forget()  # the worker may come from another operator
        _segmenters[table.id] = Segmenter(table.value)
    return _segmenters[table.id]


class Table:
    """A broadcast table and its number."""

    def __init__(self, spark: SparkSession, table: list[tuple[str, float]]):
        self.sent = spark.sparkContext.broadcast(table)
        self.id = hash(tuple(table))

    @property
    def value(self) -> list[tuple[str, float]]:
        return self.sent.value


def encoded(table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = segmenter(table)
    for part, texts in words.slices(batches, limit=SLICE_BYTES):
        plain = [t.decode() for t in texts]
        ids, score, second, others = zip(*s.encode_all(plain), strict=True)
        same = [s.decode(i) == t and (j is None or s.alike(i, j)) for i, j, t in zip(ids, others, plain, strict=True)]
        columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(score, pa.float64()), pa.array(second, pa.float64()), pa.array(same)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_pieces", "score", "second_score", "round_trip"])
    s.clear()  # the worker goes on to other work; a task's own chunks were what paid


def decoded(table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = segmenter(table)
    for part in batches:
        texts = [s.decode(i or b"") for i in part.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(documents: DataFrame, table: list[tuple[str, float]]) -> DataFrame:
    """doc_id, ids (little-endian int32 after each other), n_pieces, score, second_score (null: there is one segmentation
    only), round_trip (the decoded ids of both segmentations are the text): a row per document. The rows are taken later, so the session keeps the
    smaller Arrow batches."""
    spark = documents.sparkSession
    words.ship(spark)
    words.small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(encoded, Table(spark, table)), f"doc_id {kind}, ids binary, n_pieces bigint, score double, second_score double, round_trip boolean")


def decode(tokens: DataFrame, table: list[tuple[str, float]]) -> DataFrame:
    """doc_id, text of rows with ids as encode() gives them; null ids: empty."""
    spark = tokens.sparkSession
    words.ship(spark)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(partial(decoded, Table(spark, table)), f"doc_id {kind}, text string")
