"""Periodic runs of words against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from streamhouse.llm import periods, words
from streamhouse.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def smallest_period(w):
    """By the failure function."""
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute(w):
    """All runs: for each period the longest stretches that keep it, if it is their smallest."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and smallest_period(w[i : i + length]) == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def texts(seed):
    r = random.Random(seed)
    out = ["", " \t\n", "a", "a " * 5, "a " * 6, "a\n" * 7, "a b " * 4, "a b " * 3 + "a", "a b c " * 4, "a b c " * 4 + "d", "a a b " * 9, ("a " * 6 + "b ") * 5, "é ü " * 6, "\x1c \x85 " * 4]
    for _ in range(120):
        some = r.choice([1, 2, 2, 3, 5, 400])
        w = [str(r.randrange(some)) for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):
            q, i = r.randint(1, 9), r.randint(0, len(w))
            block = [str(r.randrange(some)) for _ in range(q)] * r.randint(2, 9)
            w[i:i] = block[: len(block) - r.randrange(q)]
        if r.random() < 0.2:
            w = w * r.randint(2, 5)
        out.append(r.choice([" ", "\n", "  \t"]).join(w))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_many_texts_at_once(seed):
    each = texts(seed)
    found = periods.runs_of(words.chunk([t.encode() for t in each], words.SPACED))
    for text, runs in zip(each, found, strict=True):
        assert runs == brute(split(text)), text
        assert periods.collapsed(text.encode(), runs).decode() == dropped(split(text), runs)


def test_long_and_uniform_texts():
    r = random.Random(5)
    stretch = [str(r.randrange(9)) for _ in range(20_000)]
    each = ["x " * 200_000, "x y " * 100_000, " ".join(stretch * 5), " ".join(str(r.randrange(2)) for _ in range(50_000))]
    found = periods.runs_of(words.chunk([t.encode() for t in each], words.SPACED))
    assert found[0] == [(0, 200_000, 1)] and found[1] == [(0, 200_000, 2)]
    assert (0, 100_000, 20_000) in found[2]
    assert [x for x in found[3] if x[2] == 1] == [x for x in brute_period_one(each[3].split())]


def brute_period_one(w):
    starts = [i for i in range(len(w)) if not i or w[i] != w[i - 1]] + [len(w)]
    return [(a, b - a, 1) for a, b in zip(starts, starts[1:], strict=False) if b - a >= 6]


def test_rows(spark):
    rows = [(k, t, [k], "r") for k, t in enumerate(texts(77))] + [(None, "a " * 9, None, None), (3, None, None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs array<long>, collapsed string").repartition(3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect())
    want = []
    for key, text, *_ in rows:
        runs = brute(split(text))
        want.append(((key is not None, key or 0), len(split(text)), runs, dropped(split(text), runs)))
    assert got == sorted(want)
    assert periods.periodic_runs(df.filter("false")).count() == 0


def test_query(spark):
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    want = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        w = planted(r.doc_id, split(r.text))
        runs = brute(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.add((r.doc_id, len(runs), *told, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, dropped(w, runs)))))
    assert got == want and len({x[2] for x in got}) > 5


def test_planted_texts_of_null_and_empty_rows(spark):
    keys = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(keys[0], None), (keys[1], " "), (keys[2], "one"), (keys[3], "a b c d e f g h"), (None, "x y"), (1, " kept  as it is")]
    got = dict(periods.with_planted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for key, text in rows[:4]:
        assert split(got[key]) == planted(key, split(text))
    assert got[None] == "x y" and got[1] == " kept  as it is"
