"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from streamhouse.llm import hard_negatives
from streamhouse.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(rows, every=100):
    """rows: (id, label, vector)."""
    whole = [(i, c, [math.floor(256 * float(x)) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, c, v) in enumerate(whole):
        if i % every:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=False)) for *_, w in whole]
        by = sorted((k for k in range(len(whole)) if k != at), key=lambda k: (-score[k], whole[k][0]))
        for p in [k for k in by if whole[k][1] == c][:5]:
            inside = [k for k in by if whole[k][1] != c and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            out += [(i, whole[p][0], r + 1, whole[k][0], score[p], score[k]) for r, k in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], "vec_id long, label int, embedding array<float>, block string, anchor int")


def random_rows(seed, n, dims, labels):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, dims)) + r.choice([0, 1.5])
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), r.choice([1, 8])).astype(np.float32)
    return [(k, int(r.integers(labels)), v[k].tolist()) for k in range(n)]


@pytest.mark.parametrize(("seed", "n", "dims", "labels"), [(1, 700, 16, 3), (2, 400, 3, 2), (3, 300, 20, 1), (4, 350, 1, 5), (5, 120, 33, 60)])
def test_brute_force(spark, monkeypatch, seed, n, dims, labels):
    rows = random_rows(seed, n, dims, labels)
    random.Random(seed).shuffle(rows)
    got = hard_negatives.mine(frame(spark, rows).repartition(5), every=20).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 20)


def test_defined_cases(spark):
    base = random_rows(9, 60, 4, 2)
    odd = [(100, None, [1.0] * 4), (200, 1, None), (300, 1, [1.0, None, 1.0, 1.0]), (400, 1, [float("nan")] * 4), (500, 0, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, [1.0] * 4), (600, 1, []), (700, 0, [0.5]), (800, 1, [0.9, 0.1, 0.2, 0.3, 0.7]), (900, 77, [1.0] * 4), (1000, 0, [-3e38] * 4)]
    rows = base + odd
    found = hard_negatives.mine(frame(spark, rows))
    assert sorted(tuple(r) for r in found.collect() if r.anchor_id != 1000) == [r for r in brute(rows[:-1]) if r[0] != 1000]
    assert hard_negatives.mine(frame(spark, rows).filter("false")).collect() == []
    assert found.schema.simpleString() == "struct<anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint>"


def test_repeated_rows_and_ties(spark):
    """Copies of a row are rows of their own; a third of all rows is one vector."""
    rows = random_rows(11, 100, 8, 3)
    rows += [(k, k % 3, [0.3] * 8) for k in range(100, 150)] + [rows[0]] * 2
    got = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_many_blocks_and_pruning(spark, monkeypatch):
    rows = [(k, k % 3, [1.0 if d == k % 9 else 0.0625 * (k % 4) for d in range(24)]) for k in range(9000)]
    got = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows).coalesce(1), every=3000).collect())
    assert got == brute(rows, 3000)
    v = np.array([r[2] for r in rows[:4000]])
    columns = np.ascontiguousarray((256 * v).astype("<i4").T)
    scan = hard_negatives.Scan(columns, columns.min(1), columns.max(1), columns[:, 0].astype(np.int64), np.arange(1, 4000))
    hard_negatives.positives_in(scan, np.arange(4000), 5)
    assert len(scan.alive) < 1000  # rows left before all columns were read


def test_query(spark):
    rows = []
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect():
        label = None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, r.embedding))
    got = QUERIES["op13_hard_negatives"](spark, SMALL)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert got.filter(F.col("rank") > 5).count() == 0


def test_anchors_are_not_copied_for_blocks(spark):
    """Many blocks and packs: what is shuffled and what tasks return does not grow with blocks times anchors."""
    r = np.random.default_rng(3)
    rows = [(k, int(r.integers(4)), v) for k, v in enumerate(np.round(r.normal(size=(3000, 12)), 3).astype(np.float32).tolist())]
    task = iter(range(300))

    class Task:
        def partitionId(self):
            return next(task)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(hard_negatives, "ANCHORS", 32)
        m.setattr(hard_negatives.TaskContext, "get", Task)
        source = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 30], strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["vec_id", "label", "embedding"]) for k in range(0, 3000, 30)]
        blocks = [b for s in source for b in hard_negatives.packed(iter([s]))]
        anchors = list(hard_negatives.anchors_of(iter(blocks), 20))
        packs = list(hard_negatives.gathered(iter(anchors), None))
        assert len(blocks) == 100 and len(packs) == 5
        pairs = [pa.RecordBatch.from_arrays([*b.columns, *p.columns], [*b.schema.names, *p.schema.names]) for b in blocks for p in packs]
        good = pa.Table.from_batches(hard_negatives.scanned(iter(pairs), 5, True))
        assert good.num_rows == 150 * 5  # of all blocks that a task meets, five for each anchor
    plan = hard_negatives.mine(frame(spark, rows), every=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("size", [1, 1e3, 1.5e5])
def test_all_ranges_of_numbers(spark, size):
    """Scores that floats hold, that doubles hold, and that neither does; equal scores; windows of negative scores."""
    r = np.random.default_rng(7)
    v = np.round(r.normal(size=(400, 19)) * size, 2)
    v[200:260] = v[3]
    v[260:300] = -v[20]
    rows = [(k, int(r.integers(3)), v[k].astype(np.float32).tolist()) for k in range(400)]
    got = sorted(tuple(x) for x in hard_negatives.mine(frame(spark, rows).repartition(4), every=20).collect())
    assert got == brute(rows, 20)
