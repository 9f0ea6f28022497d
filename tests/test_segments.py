"""Words by a lexicon, against a dynamic programme in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from streamhouse.functions.segments import explode_segments, segmented


def brute(run, words, longest=8):
    """Least unknown characters, then fewest pieces, then the longest last pieces."""
    best = [[(0, 0, ()), None]]  # of each place: what ends in a word, and in unknown characters
    for end in range(1, len(run) + 1):
        ways = []
        for n in range(1, min(longest, end) + 1):
            if run[end - n : end] in words:
                x = min((b for b in best[end - n] if b is not None), key=lambda b: b[:2])
                ways.append((x[0], x[1] + 1, -n, x[2]))
        w = min(ways, default=None)
        word, other = best[end - 1]
        unknown = [] if other is None else [(other[0] + 1, other[1], 0, (*other[2][:-1], other[2][-1] + run[end - 1]))]
        unknown += [] if word is None else [(word[0] + 1, word[1] + 1, 1, (*word[2], run[end - 1]))]
        u = min(unknown)
        best.append([w and (w[0], w[1], (*w[3], run[end + w[2] : end])), (u[0], u[1], u[3])])
    return list(min((b for b in best[-1] if b is not None), key=lambda b: b[:2])[2])


def cut(spark, runs, words, longest=8):
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.run: r.pieces for r in segmented(df, lexicon, longest).collect()}


def test_titles(spark):
    words = ["小米", "手机", "智能", "智能手机", "全网通", "研究", "研究生", "生命", "起源"]
    assert cut(spark, ["小米智能手机", "研究生命起源", "甲乙手机丙", "甲乙", "手"], words) == {
        "小米智能手机": ["小米", "智能手机"],
        "研究生命起源": ["研究", "生命", "起源"],
        "甲乙手机丙": ["甲乙", "手机", "丙"],
        "甲乙": ["甲乙"],
        "手": ["手"],
    }


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("甲乙丙丁") for _ in range(n))
    words = {text(r.randint(1, 5)) for _ in range(12)} - set("甲乙丙")
    runs = {text(r.randint(1, 25)) for _ in range(150)} | {text(400)}
    assert cut(spark, [*runs, *runs], words, 4) == {run: brute(run, words, 4) for run in runs}


def test_rows_keep_their_columns(spark):
    """Mixed scripts, repeated words and rows, nulls, and a text that half of the rows share."""
    words = {"手机", "小米", "ring"}
    each = ["Red小米 10手机手机X", "", None, "!!", "小米手机", "bearing ring RING"]
    data = [(i, each[i % len(each)] if i % 2 else each[0]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, t string").repartition(4)
    lexicon = spark.createDataFrame([(w, 1) for w in [*words, *words, None]], "word string, id int")
    want = Counter()
    for i, t in data:
        for run in re.findall("[一-鿿]+|[a-z0-9]+", (t or "").lower()):
            want.update((i, t, p) for p in (brute(run, words) if run[0] >= "一" else [run]))
    assert Counter(map(tuple, explode_segments(df, "t", lexicon).collect())) == want
    assert explode_segments(df.where("false"), "t", lexicon).count() == 0


def test_plan_is_built_in_and_without_collect(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plan = explode_segments(df, "t", spark.createDataFrame([("a",)], "word string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("EvalPython", "InArrow", "Cartesian", "NestedLoop"))
