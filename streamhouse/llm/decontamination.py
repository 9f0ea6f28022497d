"""Benchmark decontamination by latent semantic retrieval.

1. Passage frequencies of hashed words over all documents give the idf weights.
2. A distributed randomised SVD (random projection, power iterations, QR) of the benchmark's TF-IDF rows gives a latent
   space of RANK dimensions. It is fitted on all items of a block, which are what is searched for.
3. Every document is cut into overlapping windows of a few lengths, whose latent vectors are
   sums over their words. Windows whose cosine with an item of that length class reaches CANDIDATE of what
   the latent space holds of the item are candidates. A window's
   share of idf energy in the items' words bounds its cosines, so many windows are
   left before they meet any item. The products of all words with the items of a length class are taken once in a task, so
   a window sums a number per item and not a vector; the cosine of a candidate is then taken from its vector.
4. Common words weigh nothing in the latent space, so a cosine alone would lose pairs. Windows that could still pass step 5
   are added by counting: who has PARAPHRASE of an item's words has `least` of its `rarest` words, and a bit-parallel
   common subsequence with each 64 words of the item bounds the rest. Neither bound loses a pair, so all windows have been
   searched as if each had gone to step 5.
5. Around a candidate the longest common subsequence of words decides: COPY of the item's words, or PARAPHRASE of them and
   ANSWER of its last sentence's words, all in order.

The benchmark is taken in blocks of about ITEMS rows (by a hash), one scan of the documents each, so what a task holds does
not grow with it. Cost of a scan: the words of all documents once; nothing is shuffled but counts.

Defined cases: null text is empty; items below SHORTEST words are not searched; a pair of document and item has one row, of
the best subsequence; the cosine is 0 where all of an item's or a window's words are common; repeated rows and ids each get their own rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streamhouse.llm import words

TERMS = 1 << 16
PASSAGE = 64
RANK, OVERSAMPLE, POWER = 256, 16, 2
ITEMS = 512
SHORTEST = 5
CANDIDATE, LEAST = 0.5, 0.1
#: Seconds for a hit, and for a window that has enough of them: they set how many of an item's rare words are looked up.
HIT, LOOK = 5e-8, 5e-7
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: More than what single precision changes of a cosine.
SLACK = 1e-3
#: Terms in more than this share of passages are left out of the latent space.
COMMON_SHARE = 0.01


def terms(texts: list[bytes]) -> tuple[words.Chunk, np.ndarray, np.ndarray]:
    """Words in lower case (of any script), their hashes, and the terms that these fall into."""
    c = words.chunk([t.lower() if t.isascii() else t.decode().lower().encode() for t in texts], words.ALNUM)
    h = words.Hasher(c.data).spans(c.starts, c.ends)
    return c, h, (h % np.uint64(TERMS)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that hold each term, summed over the task; term -1: all passages."""
    total, passages = np.zeros(TERMS, np.int64), 0
    for _, texts in words.slices(batches):
        c, _, term = terms(texts)
        first = np.searchsorted(c.doc, np.arange(len(texts)))[c.doc]  # the first word of the same text
        new = (np.arange(len(term)) - first) % PASSAGE == 0
        passages += int(new.sum())
        seen = np.sort((np.cumsum(new) - 1) * TERMS + term)
        total += np.bincount(seen[np.diff(seen, prepend=-1) != 0] % TERMS, minlength=TERMS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([passages, *total[some].tolist()], pa.int64())], ["term", "n"])


def weights(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """idf of each term, 0 for those in more than COMMON_SHARE of passages; and each term's share of passages."""
    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n, passages = np.zeros(TERMS), 0
    for term, count in zip(rows["term"], rows["n"], strict=True):
        if term < 0:
            passages = count
        else:
            n[term] = count
    idf = np.log((passages + 1) / (n + 1)) + 1
    idf[n > max(COMMON_SHARE * passages, 50)] = 0
    return idf, n / max(passages, 1)


@dataclass
class Basis:
    """Vectors of the items' own terms (sorted); all other terms have zero."""

    terms: np.ndarray
    vectors: np.ndarray


def projected(idf: np.ndarray, basis: Basis | None, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's share of A^T (A X), for TF-IDF rows A and X the basis, or Gaussian where there is none: a row per term."""
    out: dict[int, np.ndarray] = {}
    for _, texts in words.slices(batches):
        c, _, term = terms(texts)
        for doc in range(len(texts)):
            own, tf = np.unique(term[c.doc == doc], return_counts=True)
            row = tf * idf[own]
            norm = np.sqrt((row**2).sum())
            if norm == 0:
                continue
            row = row / norm
            own, row = own[row > 0], row[row > 0]
            x = np.stack([gauss(seed, t) for t in own]) if basis is None else basis.vectors[np.searchsorted(basis.terms, own)]
            y = row @ x
            for t, w in zip(own.tolist(), row.tolist(), strict=True):
                out[t] = out.get(t, 0) + w * y
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["term", "vector"])


def gauss(seed: int, term: int) -> np.ndarray:
    return np.random.default_rng((seed, int(term))).standard_normal(RANK + OVERSAMPLE)


def latent(items: DataFrame, idf: np.ndarray) -> Basis:
    """Orthonormal basis, of RANK vectors at most, of the space that the items' TF-IDF rows mostly lie in."""
    basis = None
    for _ in range(1 + POWER):
        sums: dict[int, np.ndarray] = {}
        for row in items.select("text").coalesce(4).mapInArrow(partial(projected, idf, basis, 7), "term bigint, vector binary").toLocalIterator():
            sums[row["term"]] = sums.get(row["term"], 0) + np.frombuffer(row["vector"])
        own = np.array(sorted(sums), np.int64)
        if not len(own):
            return Basis(own, np.zeros((0, RANK)))
        z = np.stack([sums[t] for t in own.tolist()])
        q = np.linalg.qr(z)[0]
        basis = Basis(own, q @ np.linalg.svd(z.T @ q)[2].T)  # main directions first
    return Basis(basis.terms, basis.vectors[:, :RANK])


@dataclass
class Index:
    """What a scan looks for: items of one block."""

    idf: np.ndarray
    row: np.ndarray
    """Of each term: its row in vectors, or -1."""
    vectors: np.ndarray
    """idf times basis."""
    ids: list
    hashes: list[np.ndarray]
    answers: list[np.ndarray]
    queries: np.ndarray
    """Latent vectors of length 1."""
    lengths: np.ndarray
    """Window length of each item's class."""
    bounds: np.ndarray
    """Least cosine of a candidate: CANDIDATE of the share of the item that the latent space holds; infinite where it holds nothing."""
    keys: np.ndarray
    """Hashes of all items' words, sorted; letters has each item's words as places here."""
    letters: list[np.ndarray]
    rare: list[np.ndarray]
    """Each item's rarest words, as places in keys."""
    least: np.ndarray
    """How many of an item's rarest words a pair has at least."""


def rarest(h: np.ndarray, often: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Words of an item, the rarest first, and a number of which a pair has at least. often: chance that a word of a text is this one.

    A pair lacks at most n - need words, so of any n - need + t it has t. Every t is safe; taken is the cheapest, by the hits to
    look at and the windows that then have t hits by chance.
    """
    n = len(h)
    need = int(np.argmax(np.arange(n + 1) / n >= PARAPHRASE))
    order = np.lexsort((h, often))
    cost = []
    for t in range(1, min(need, 64) + 1):
        own = np.unique(h[order[: n - need + t]], return_index=True)[1]
        mean = max(float(often[order[own]].sum()), 1e-12)
        chance = np.exp(np.cumsum([-mean * 2 * length, *np.log(mean * 2 * length / np.arange(1, t))]))  # Poisson: 0 to t - 1 hits
        cost.append(mean * HIT + max(1 - chance.sum(), 0) * 4 / length * LOOK)
    t = 1 + int(np.argmin(cost))
    return np.unique(h[order[: n - need + t]]), t


def index(items: list[tuple], idf: np.ndarray, share: np.ndarray, basis: Basis) -> Index:
    row = np.full(TERMS, -1, np.int32)
    row[basis.terms] = np.arange(len(basis.terms))
    vectors = (idf[basis.terms, None] * basis.vectors).astype(np.float32)
    found = Index(idf.astype(np.float32), row, vectors, [], [], [], np.zeros((0, vectors.shape[1]), np.float32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64), [], [], np.zeros(0, np.int64))
    queries, lengths, bounds, signs, least = [], [], [], [], []
    for item, text in items:
        text = (text or "").encode()
        _, h, term = terms([text])
        own = row[term]
        q = vectors[own[own >= 0]].sum(axis=0)
        if len(h) < SHORTEST:
            continue
        sentences = [s for s in re.split(rb"(?<=[.!?])\s+|\n", text) if len(terms([s])[1]) >= 2]
        found.ids.append(item)
        found.hashes.append(h)
        found.answers.append(terms([sentences[-1]])[1] if sentences else h)
        length = np.sqrt((q**2).sum())
        queries.append(q / max(length, 1e-9))
        bounds.append(max(LEAST, CANDIDATE * length / np.sqrt((idf[term] ** 2).sum())) if length else np.inf)
        lengths.append(8 * 2 ** (np.ceil(2 * np.log2(max(len(h), 8) / 8)) / 2))  # half powers of two
        sign, t = rarest(h, share[term] / PASSAGE, int(lengths[-1]))
        signs.append(sign)
        least.append(t)
    if queries:
        found.keys = np.unique(np.concatenate(found.hashes))
        found.letters = [np.searchsorted(found.keys, h) for h in found.hashes]
        found.rare = [np.searchsorted(found.keys, sign) for sign in signs]
        found.least = np.array(least)
        found.queries, found.lengths = np.stack(queries).astype(np.float32), np.array(lengths).astype(np.int64)
        found.bounds = np.array(bounds)
    return found


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def possible(x: Index, h: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Item, document and start of all windows that could pass the last check, by bounds that lose none."""
    if not x.ids:
        return
    key = np.minimum(np.searchsorted(x.keys, h), len(x.keys) - 1)
    key[x.keys[key] != h] = len(x.keys)
    places = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[places], np.arange(len(x.keys) + 1))
    key = np.append(key, len(x.keys))
    for i in np.flatnonzero([np.sum(cuts[k + 1] - cuts[k]) for k in x.rare] >= x.least).tolist():
        n, length, t = len(x.hashes[i]), int(x.lengths[i]), int(x.least[i])
        step, half = max(length // 4, 1), n // 2
        hit = np.sort(np.concatenate([places[cuts[k] : cuts[k + 1]] for k in x.rare[i].tolist()]))
        a, b = hit[: len(hit) - t + 1], hit[t - 1 :]
        near = (b - a < length + 2 * half) & (doc[a] == doc[b])
        a, b = a[near], b[near]
        d = doc[a]
        last = np.maximum(end[d] - begin[d] - length + step - 1, 0) // step  # number of the document's last window
        low = np.maximum(-(-(b + 1 - half - length - begin[d]) // step), 0)
        high = np.minimum((a + half - begin[d]) // step, last)
        many = np.maximum(high - low + 1, 0)
        d, k = np.repeat(d, many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        start = np.unique(begin[d] + step * k)
        d = doc[start]
        lo, hi = np.maximum(begin[d], start - half), np.minimum(end[d], np.minimum(start + length, end[d]) + half)
        rows = max((1 << 20) // (length + 2 * half), 1)
        for j in range(0, len(start), rows):
            part = slice(j, j + rows)
            words_ = lo[part, None] + np.arange(length + 2 * half)
            words_ = key[np.where(words_ < hi[part, None], words_, len(h))]
            some = bounded(x.letters[i], len(x.keys), words_) / n >= PARAPHRASE
            yield from ((i, *w) for w in zip(d[part][some].tolist(), start[part][some].tolist(), strict=True))


def bounded(letters: np.ndarray, n_keys: int, rows: np.ndarray) -> np.ndarray:
    """Of each row of words: a bound of its common subsequence with the item, the true length for items of up to 64 words."""
    total = np.zeros(len(rows), np.int64)
    for j in range(0, len(letters), 64):
        own = letters[j : j + 64]
        masks = np.zeros(n_keys + 1, np.uint64)
        np.bitwise_or.at(masks, own, np.uint64(1) << np.arange(len(own), dtype=np.uint64))
        full = np.uint64((1 << len(own)) - 1)
        v = np.full(len(rows), full)
        for m in masks[rows.T]:
            u = v & m
            v = (v + u | v - u) & full
        total += len(own) - np.bitwise_count(v)
    return total


def searched(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of documents and items."""
    x: Index = sent.value
    padded = np.concatenate([x.vectors, np.zeros((1, x.vectors.shape[1]), np.float32)])
    items = {length: np.flatnonzero(x.lengths == length) for length in np.unique(x.lengths).tolist()}
    products = {length: padded @ x.queries[which].T for length, which in items.items()}
    for part, texts in words.slices(batches):
        c, h, term = terms(texts)
        n = len(h)
        begin = np.searchsorted(c.doc, np.arange(len(texts)))
        end = np.searchsorted(c.doc, np.arange(len(texts)), side="right")
        own = x.row[term]
        live = np.flatnonzero(own >= 0)
        square, known, place = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, np.int64)
        energy = x.idf[term].astype(np.float64) ** 2
        np.cumsum(energy, out=square[1:])
        np.cumsum(np.where(own >= 0, energy, 0), out=known[1:])
        np.cumsum(own >= 0, out=place[1:])
        best: dict[tuple[int, int], tuple] = {}

        done: set[tuple[int, int]] = set()

        def check(item: int, doc: int, begins: int, least: float = -np.inf, end=end, begin=begin, h=h, best=best, own=own, square=square, done=done) -> None:
            """A window whose cosine reaches `least`, once."""
            if (item, begins) in done:
                return
            ends = min(begins + int(x.lengths[item]), int(end[doc]))
            inside = own[begins:ends]
            vector, norm = x.vectors[inside[inside >= 0]].sum(axis=0), np.sqrt(max(square[ends] - square[begins], 1e-9))
            cosine = float(vector @ x.queries[item] / norm)
            if cosine < least:
                return
            done.add((item, begins))
            size = len(x.hashes[item])
            region = h[max(begin[doc], begins - size // 2) : min(end[doc], ends + size // 2)]
            share = common(x.hashes[item], region) / size
            if share < PARAPHRASE:
                return
            answer = common(x.answers[item], region) / len(x.answers[item])
            if share >= COPY or answer >= ANSWER:
                best[doc, item] = max(best.get((doc, item), (0,)), (share, answer, cosine))

        for item, doc, start in possible(x, h, c.doc, begin, end):
            check(item, doc, start)
        for length, which in items.items():
            step = max(length // 4, 1)
            count = np.where(end > begin, np.maximum(end - begin - length + step - 1, 0) // step + 1, 0)
            of = np.repeat(np.arange(len(texts)), count)
            start = begin[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
            stop = np.minimum(start + length, end[of])
            a, b = place[start], place[stop]
            some = np.flatnonzero((b > a) & (known[stop] - known[start] >= CANDIDATE**2 * (square[stop] - square[start])))
            for k in range(0, len(some), 1024):
                at = some[k : k + 1024]
                size = (b[at] - a[at])[:, None]
                pad = np.arange(size.max())
                total = products[length][np.where(pad < size, own[live[np.minimum(a[at][:, None] + pad, len(live) - 1)]], len(x.vectors))].sum(axis=1)
                norm = np.sqrt(np.maximum(square[stop[at]] - square[start[at]], 1e-9))
                # sums of products are rounded otherwise than products of sums
                for w, j in zip(*np.nonzero(total / norm[:, None] >= x.bounds[which] - SLACK), strict=True):
                    item = int(which[j])
                    check(item, int(of[at[w]]), int(start[at[w]]), x.bounds[item])
        if best:
            docs = part.column("doc_id").take(pa.array([d for d, _ in best]))
            columns = [pa.array(v, pa.float64()) for v in zip(*best.values(), strict=True)]
            ids = pa.array([str(x.ids[i]) for _, i in best], pa.string())
            yield pa.RecordBatch.from_arrays([docs, ids, *columns], ["doc_id", "item_id", "common_share", "answer_share", "cosine"])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, common_share, answer_share, cosine, verdict (copy or paraphrase): a row per pair."""
    spark = documents.sparkSession
    words.ship(spark)
    words.small_batches(spark)
    kind, item = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id string, common_share double, answer_share double, cosine double"
    blocks = -(-items.count() // ITEMS)
    # no rows; an empty Python list would start workers with a daemon of their own, which stay
    found = slim.limit(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))
    idf, share = weights(slim) if blocks else (None, None)
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = [(r["item_id"], r["text"]) for r in own.collect()]
        sent = spark.sparkContext.broadcast(index(rows, idf, share, latent(own, idf)))
        found = found.unionByName(slim.mapInArrow(partial(searched, sent), schema))
    verdict = F.when(F.col("common_share") >= COPY, "copy").otherwise("paraphrase")
    return found.withColumn("item_id", F.col("item_id").cast(item)).withColumn("verdict", verdict)
