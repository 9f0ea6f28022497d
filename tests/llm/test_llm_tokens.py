"""Token files: exact round trips, keyed access, the perfect hash function."""

from __future__ import annotations

import random
import uuid
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from streamhouse.llm import token_files, words
from streamhouse.llm.queries import BYTE_BPE, QUERIES

SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "don't  stop\n\n\tnow ", "x<|endoftext|> y", "a  <|endoftext|>", "é   ß\x1c\x1dq", "  \n a 12³ⅷ_ ~~ \r\n", "𝔘 😀​", "\x85\x0b z", " ' s 's'LL", "w" * 70_000, "ab " * 40_000]


def expected(rows):
    """By brute force: (id, start, ids) of the rows in order."""
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, ids))
        start += len(ids)
    return out


def folder(spark):
    return f"{words.checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def ids_of(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


def test_round_trip(spark):
    rows = [(k * 7 - 20, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, shard int, file string").repartition(5)
    token_files.write(df, where := folder(spark), BYTE_BPE)
    got = {r.doc_id: (r.start, ids_of(r.ids)) for r in token_files.read_all(spark, where).collect()}
    assert got == {k: (start, ids) for k, start, ids in expected(rows)}
    store = token_files.Store.open(where)
    assert all(store.get(k).tolist() == ids for k, _, ids in expected(rows))
    assert store.get(5) is None and store.get(-20, 1) is None
    raw = b"".join(open(f"{token_files.place(where)[1]}/{s.file}", "rb").read() for s in spark.read.parquet(f"{where}/shards").orderBy("shard").collect())
    assert np.frombuffer(raw, "<u2").tolist() == [i for *_, ids in expected(rows) for i in ids]
    asked = spark.createDataFrame([(-20, 0), (4, 0), (None, 0)], "doc_id long, copy long")
    assert [r.doc_id for r in token_files.read(asked, where).collect()] == [-20]


def test_repeated_and_null_ids_over_many_tasks(spark, monkeypatch):
    """Half of the rows have one id, and its rows are dealt to several tasks and shards."""
    chance = random.Random(3)
    rows = [(5, chance.choice(["same text", "another"])) for _ in range(200)] + [(None, "null id"), (None, None)] + [(k, f"text {k}") for k in range(-100, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(df, where := folder(spark), BYTE_BPE)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = token_files.read_all(spark, where).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.copy) for r in got}) == len(rows)
    assert sorted(r.copy for r in got if r.doc_id == 5) == list(range(201))
    assert spark.read.parquet(f"{where}/shards").count() > 2
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0, r.copy) for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    want = sorted((k is not None, k or 0, ids) for k, _, ids in expected(rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, ids_of(r.ids)) for r in got) == want
    store = token_files.Store.open(where)
    assert all(store.get(r.doc_id, r.copy).tolist() == ids_of(r.ids) for r in got)


def test_text_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", "one"), ("a", "two"), ("ä", None)], "doc_id string, text string")
    token_files.write(df, where := folder(spark), BYTE_BPE, end_id=50_256)
    assert {r.doc_id: (r.start, ids_of(r.ids)[-1]) for r in token_files.read_all(spark, where).collect()} == {"a": (0, 50_256), "b": (2, 50_256), "ä": (4, 50_256)}
    assert token_files.Store.open(where).get("ä").tolist() == [50_256]
    token_files.write(df.filter("false"), where := folder(spark), BYTE_BPE)
    assert token_files.read_all(spark, where).count() == 0 and token_files.Store.open(where).get("a") is None


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_is_perfect_and_minimal(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 2**64, (2, n), dtype=np.uint64)
    a[: n // 2] = a[0] if n else 0  # one hash may repeat, not both
    own = token_files.Index.load(token_files.index(a, b, np.arange(n), np.arange(n) * 3, np.arange(n) + 1).dump())
    slot = own.find(a, b)
    assert sorted(slot.tolist()) == list(range(n))
    assert own.slots["shard"][slot].tolist() == list(range(n)) and own.slots["at"][slot].tolist() == list(range(0, 3 * n, 3))
    assert sum(own.sizes) <= 8 * n + 64 * len(own.sizes)
    assert (own.find(*r.integers(0, 2**64, (2, 5000), dtype=np.uint64)) >= 0).sum() == 0


def test_equal_hashes_are_refused():
    same = np.zeros(2, np.uint64)
    with pytest.raises(ValueError, match="equal"):
        token_files.index(same, same, *[np.arange(2)] * 3)


def test_query(spark):
    got = {tuple(r) for r in QUERIES["op11_token_files"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got == {(k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, start, ids in expected(rows)}
