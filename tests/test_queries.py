"""Registered queries against their SQL counterparts, and the shape of their plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_module
from check import compare, connect
from streamhouse.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SMALL, name).startswith("ok ")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["stt", "edt"]
    assert df.count() > 0


@pytest.fixture
def shuffled(spark):
    """No broadcast by size, as when every table is large."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    yield lambda name: plan(entry_module.queries()[name](spark, SMALL))
    for k in keys:
        spark.conf.unset(k)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(shuffled, name):
    text = shuffled(name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        assert bad not in text


def test_nothing_is_broadcast_but_by_size(shuffled):
    for name in QUERIES:
        assert not re.search("BroadcastHashJoin", shuffled(name)), name
