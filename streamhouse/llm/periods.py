"""Periodic runs of words, found by uniting suffix classes in order of decreasing common prefix.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of LEAST words and
POWER * q at least, that no neighbouring word extends keeping the period. A text is collapsed by dropping each word that a
run contains after the run's first q words.

Suffixes of a text that share l words are a class; classes of a smaller l are unions of those of a larger. Neighbours in the
suffix array are united by decreasing common prefix (Kruskal's order), and each class keeps its positions in order. Two
positions i < j that become neighbours when classes meet at l have a common prefix of l words exactly; if j - i <= l, the words
from i to j + l have the period j - i, and cannot be extended to the right. Every run (i, q) is met in this way: a position of
the class between i and i + q would give the run a smaller period. So a seed is a run where the word before i breaks the
period, and where i and j are still neighbours once all of the level is united (else a smaller period is there).

A run of LEAST words and power POWER needs a common prefix of SHORTEST words, so classes below that are never united, and
only texts in which so many words repeat get a suffix array. Words are compared by hashes of 64 bits (see words.py).

Memory of a task: CHUNK bytes of text, or one text, in arrays. Time: n log n in the words of a text.

Defined cases: null text has no words and no runs, its collapsed text is empty; repeated rows and ids each get their own row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

LEAST, POWER = 6, 4
SHORTEST = min(max(LEAST - q, (POWER - 1) * q) for q in range(1, LEAST))
CHUNK = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def repeating(symbol: np.ndarray) -> np.ndarray:
    """Positions at which SHORTEST symbols start that start elsewhere, too."""
    m = len(symbol) - SHORTEST + 1
    if m < 2:
        return np.zeros(0, np.int64)
    g = symbol[:m].copy()
    for k in range(1, SHORTEST):
        g = g * np.uint64(words.BASE) + symbol[k : m + k]
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(m, bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order[twice]


def suffix_array(symbol: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions in order of their suffixes, and the ranks by the first 1, 2, 4, ... symbols (equal where these are the same).

    Prefix doubling; positions whose rank is settled are not sorted again.
    """
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    new = np.concatenate([[True], symbol[order[1:]] != symbol[order[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # beyond the end
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, width = [(1, rank.copy())], 1
    while True:
        shared = np.concatenate([new, [True]])
        open_ = np.flatnonzero(~(shared[:-1] & shared[1:]))  # places of order in groups of two or more
        if not len(open_):
            return order, ranks
        at = order[open_]
        after = rank[np.minimum(at + width, n)]
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[open_] = at
        first = rank[at]
        head = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        new[open_] = head
        rank[at] = open_[head][np.cumsum(head) - 1]
        width *= 2
        ranks.append((width, rank.copy()))


def common(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols suffixes share, by pair."""
    n = len(ranks[0][1]) - 1
    out = np.zeros(len(a), np.int64)
    for width, rank in reversed(ranks):
        x, y = np.minimum(a + out, n), np.minimum(b + out, n)
        out[(rank[x] == rank[y]) & (x != y)] += width
    return out


def seeds(pairs: list[tuple[int, int, int]], symbol: list[int], starts: set[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs. pairs: (common prefix, position, position), by decreasing common prefix."""
    own: dict[int, list[int]] = {}
    out: list[tuple[int, int, int]] = []
    told: list[tuple[int, int]] = []
    level = 0

    def meet(i: int, j: int) -> None:
        q = j - i
        if level >= (POWER - 1) * q and level + q >= LEAST and (i in starts or symbol[i - 1] != symbol[j - 1]):
            told.append((i, j))

    def close() -> None:
        for i, j in told:
            mine = own[i]
            k = bisect_left(mine, i)
            if k + 1 < len(mine) and mine[k + 1] == j:
                out.append((i, level + j - i, j - i))
        told.clear()

    for l, a, b in pairs:
        if l != level:
            if told:
                close()
            level = l
        left, right = own.get(a) or [a], own.get(b) or [b]
        if len(left) < len(right):
            left, right = right, left
        if right[0] > left[-1]:
            meet(left[-1], right[0])
            left.extend(right)
        else:
            moved = set(right)
            for x in right:
                k = bisect_left(left, x)
                if k and left[k - 1] not in moved:
                    meet(left[k - 1], x)
                if k < len(left) and left[k] not in moved:
                    meet(x, left[k])
                left.insert(k, x)
        own[a] = own[b] = left
        for x in right:
            own[x] = left
    if told:
        close()
    return out


def runs_of(c: words.Chunk) -> list[list[tuple[int, int, int]]]:
    """Runs of each text of a chunk, by start, then period."""
    n = len(c.offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not len(c.starts):
        return found
    own = np.arange(n, dtype=np.uint64) * np.uint64(words.BASE)  # no two texts share a symbol
    symbol = words.mix(words.Hasher(c.data).spans(c.starts, c.ends) + own[c.doc])
    doc, alive = c.doc, repeating(symbol)
    if not len(alive):
        return found
    with_any = np.zeros(n, bool)
    with_any[doc[alive]] = True
    at = np.flatnonzero(with_any[doc])
    symbol, doc = symbol[at], doc[at]
    order, ranks = suffix_array(symbol)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(doc[a] == doc[b])
    l = common(ranks, a[near], b[near])
    near, l = near[l >= SHORTEST], l[l >= SHORTEST]
    by = np.argsort(-l, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    first = np.zeros(n, np.int64)
    first[doc[begin]] = begin
    for i, length, q in seeds(list(zip(l[by].tolist(), a[near[by]].tolist(), b[near[by]].tolist(), strict=True)), symbol.tolist(), set(begin.tolist())):
        found[doc[i]].append((i - int(first[doc[i]]), length, q))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """Words that no run drops, joined by one space."""
    each = text.split()  # at the six ASCII white spaces
    if not runs:
        return b" ".join(each)
    out, reach = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in runs):
        out += each[reach:a]
        reach = max(reach, b)
    return b" ".join(out + each[reach:])


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    for part, texts in words.slices(batches, limit=CHUNK):
        c = words.chunk(texts, words.SPACED)
        found = runs_of(c)
        flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type))
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
        clean = pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.counts().astype(np.int64)), runs.cast(kind), clean], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed: a row per document."""
    words.ship(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(searched, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted(documents: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, chosen by their id, all words from one on repeat a stretch of their own text."""
    each = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    told = documents.select("doc_id", "text", F.when(chosen, each).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("bigint")
    placed = told.select("*", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    sized = placed.select("*", p.alias("p"))
    a, rest = F.col("a").cast("int"), (F.col("n") - F.col("a")).cast("int")
    times = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, F.col("p")), times)), F.lit(1), rest)
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the longest run; digests of all runs and of the collapsed text."""
    longest: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("x"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("x.length"), -F.col("x.period")
    return told.select("doc_id", "n_runs", (-F.col("x.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
