"""Sources and sinks that need no server."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F

from streamhouse import schemas as S
from streamhouse.session import durable_dir, size_shuffles, tune
from streamhouse.sinks.tables import StatsSink, create_dims, upsert_dim, visible
from streamhouse.sinks.topics import publish, to_topic
from streamhouse.sources import tables
from streamhouse.sources.tables import latest_version, read_dim, write_version
from streamhouse.sources.topics import Bus, kafka_options


def test_bus_needs_one_place():
    with pytest.raises(ValueError):
        Bus()
    with pytest.raises(ValueError):
        Bus(servers="a:9092", folder="/tmp/x")


def test_kafka_options():
    bus = Bus(servers="a:9092", per_trigger=10)
    assert kafka_options(bus, "t", "g", "latest") == {
        "kafka.bootstrap.servers": "a:9092",
        "subscribe": "t",
        "startingOffsets": "latest",
        "groupIdPrefix": "g",
        "maxOffsetsPerTrigger": "10",
    }


def test_publish_by_row_and_again(spark, tmp_path, rows):
    bus = Bus(folder=str(tmp_path))
    first = spark.createDataFrame([("x", "1"), ("y", "2")], "topic string, value string")
    publish(first, bus, "job", 0)
    publish(first, bus, "job", 0)
    publish(first.where("topic = 'x'"), bus, "job", 1)
    read = spark.read.option("recursiveFileLookup", "true").text
    assert rows(read(f"{tmp_path}/topic=x")) == [("1",), ("1",)]
    assert rows(read(f"{tmp_path}/topic=y")) == [("2",)]


def test_to_topic(spark, rows):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert rows(to_topic(df, "t")) == [("t", '{"a":1}')]


def test_stats_folder_is_replayed_once(spark, tmp_path, rows):
    sink = StatsSink(folder=str(tmp_path))
    df = spark.createDataFrame([("k", 1, "SEARCH", "s", "e", "hidden")], "keyword string, ct long, source string, stt string, edt string, extra string")
    sink.append(df, "keyword_stats", S.KEYWORD_STATS, "job", 3)
    sink.append(df, "keyword_stats", S.KEYWORD_STATS, "job", 3)
    sink.append(df, "keyword_stats", S.KEYWORD_STATS, "other", 3)
    got = spark.read.parquet(f"{tmp_path}/keyword_stats")
    assert got.columns[:6] == S.KEYWORD_STATS
    assert got.count() == 2


def test_stats_over_jdbc(spark, monkeypatch):
    """The call that reaches the writer; no database is started."""
    calls = []
    monkeypatch.setattr(
        DataFrameWriter, "jdbc", lambda self, url, table, mode=None, properties=None: calls.append((url, table, properties, self._df.columns))
    )
    df = spark.createDataFrame([(1, "k", "S", "s", "e")], "ct long, keyword string, source string, stt string, edt string")
    StatsSink(url="jdbc:x", properties={"driver": "d"}).append(df, "t", S.KEYWORD_STATS, "job", 0)
    assert calls == [("jdbc:x", "t", {"batchsize": "5000", "driver": "d"}, S.KEYWORD_STATS)]


class Database:
    """DuckDB in this process behind Spark's JDBC calls; no server. Rows go through files."""

    def __init__(self, monkeypatch, spark, folder):
        self.con, self.spark, self.folder, self.writes, self.fail = duckdb.connect(), spark, folder, [], set()
        monkeypatch.setattr(DataFrameWriter, "jdbc", lambda w, url, table, mode=None, properties=None: self.write(w._df, table))
        monkeypatch.setattr(DataFrameReader, "jdbc", lambda r, url, table, properties=None: self.read(table))

    def write(self, df, table):
        self.writes.append(table)
        if table in self.fail:
            raise RuntimeError("lost")
        path = f"{self.folder}/{len(self.writes)}"
        df.write.parquet(path)
        self.con.execute(f"INSERT INTO {table} BY NAME SELECT * FROM '{path}/*.parquet'")

    def read(self, table):
        return self.spark.createDataFrame(self.con.execute(f"SELECT * FROM {table}").fetchall(), "attempt long")


def test_ledger_over_jdbc(spark, tmp_path, monkeypatch):
    """Each micro-batch counts once, wherever an attempt at it is lost."""
    base = Database(monkeypatch, spark, tmp_path)
    columns = "keyword VARCHAR, ct BIGINT, source VARCHAR, stt VARCHAR, edt VARCHAR, ts BIGINT"
    base.con.execute(f"CREATE TABLE keyword_stats_staging ({columns}, writer VARCHAR, batch BIGINT, attempt BIGINT)")
    base.con.execute("CREATE TABLE ledger (stats_table VARCHAR, writer VARCHAR, batch BIGINT, attempt BIGINT)")
    base.con.execute(visible("keyword_stats", S.KEYWORD_STATS, "ledger"))
    sink = StatsSink(url="jdbc:x", ledger="ledger")
    df = lambda *words: spark.createDataFrame([(w, 1, "S", "s", "e") for w in words], "keyword string, ct long, source string, stt string, edt string")
    seen = lambda: base.con.execute("SELECT keyword FROM keyword_stats ORDER BY 1").fetchall()
    put = lambda batch, *words, writer="o'job": sink.append(df(*words), "keyword_stats", S.KEYWORD_STATS, writer, batch)
    put(0, "a", "a", "b")
    put(0, "a", "a", "b")
    assert seen() == [("a",), ("a",), ("b",)] and base.writes == ["keyword_stats_staging", "ledger"]
    base.fail = {"ledger"}
    with pytest.raises(RuntimeError):
        put(1, "c")
    assert len(seen()) == 3
    base.fail = set()
    put(1, "c")
    put(1, "c")
    put(1, "d", writer="other")
    assert seen() == [("a",), ("a",), ("b",), ("c",), ("d",)]
    assert base.con.execute("SELECT COUNT(*), MAX(attempt) FROM keyword_stats_staging").fetchone() == (6, 2)


def test_dim_versions(spark, tmp_path, rows):
    root = str(tmp_path)
    routes = spark.createDataFrame([("p", "insert", "hbase", "dim_p", "id,a", "id", None)], S.ROUTES)
    assert read_dim(spark, root, "dim_p") is None
    (table, (schema, pk)), = create_dims(spark, root, routes).items()
    create_dims(spark, root, routes)
    assert table == "DIM_P" and rows(read_dim(spark, root, "dim_p")) == []

    def write(batch, *data):
        df = spark.createDataFrame([(d, i, 0) for i, d in enumerate(data)], "data map<string,string>, position long, at long")
        upsert_dim(spark, root, table, schema, pk, df, batch)

    write(0, {"id": "1", "a": "x"}, {"id": "1", "a": "y"})
    write(4, {"id": "2", "a": "z"})
    want = [("1", "y"), ("2", "z")]
    assert rows(read_dim(spark, root, "dim_p")) == want
    write(4, {"id": "2", "a": "z"})
    assert rows(read_dim(spark, root, "dim_p")) == want
    assert latest_version(spark, f"{root}/DIM_P") == 5
    assert latest_version(spark, f"{root}/DIM_P", before=5) == 1


def files_below(folder):
    return {str(f.relative_to(folder)): f.stat().st_size for f in Path(folder).rglob("part-*.parquet") if "committed" not in f.parts}


def test_upsert_writes_only_what_it_touches(spark, tmp_path, rows):
    root, folder = str(tmp_path), tmp_path / "DIM_P"
    schema = S.layout(id=S.STRING, a=S.STRING)
    change = lambda i, a: ({"id": str(i), "a": a}, i, 0)
    kind = "data map<string,string>, position long, at long"
    upsert = lambda batch, data: upsert_dim(spark, root, "dim_p", schema, "id", spark.createDataFrame(data, kind), batch, buckets=16)
    upsert(0, [change(i, "x" * 50) for i in range(4_000)])
    whole = files_below(folder)
    assert len(whole) == 16
    upsert(1, [change(7, "new"), change(7, "newer"), change(9_999, "more")])
    added = {f: n for f, n in files_below(folder).items() if f not in whole}
    assert 1 <= len(added) <= 2 and sum(added.values()) < 0.2 * sum(whole.values())
    got = {r.id: r.a for r in read_dim(spark, root, "dim_p").collect()}
    assert len(got) == 4_001 and got["7"] == "newer" and got["9999"] == "more" and got["8"] == "x" * 50
    # A repeated batch, also after one that came later, gives the same table.
    once = rows(read_dim(spark, root, "dim_p"))
    upsert(1, [change(7, "new"), change(7, "newer"), change(9_999, "more")])
    assert rows(read_dim(spark, root, "dim_p")) == once
    assert read_dim(spark, root, "dim_p", before=2).count() == 4_000


def test_upsert_without_commit_is_not_seen(spark, tmp_path, rows, monkeypatch):
    """A task or driver lost between the files and the mark leaves the version before, and the batch can run again."""
    root = str(tmp_path)
    schema = S.layout(id=S.STRING, a=S.STRING)
    df = lambda *data: spark.createDataFrame([(d, 1, 0) for d in data], "data map<string,string>, position long, at long")
    upsert_dim(spark, root, "dim_p", schema, "id", df({"id": "1", "a": "x"}), 0)

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "commit", lost)
    with pytest.raises(RuntimeError):
        upsert_dim(spark, root, "dim_p", schema, "id", df({"id": "1", "a": "y"}), 1)
    assert rows(read_dim(spark, root, "dim_p")) == [("1", "x")]
    monkeypatch.undo()
    upsert_dim(spark, root, "dim_p", schema, "id", df({"id": "1", "a": "y"}), 1)
    assert rows(read_dim(spark, root, "dim_p")) == [("1", "y")]


def test_whole_tables_are_cut_at_the_first_upsert(spark, tmp_path, rows):
    root = str(tmp_path)
    schema = S.layout(id=S.STRING, a=S.STRING)
    change = spark.createDataFrame([({"id": "3", "a": "new"}, 1, 0), ({"a": "no key"}, 2, 0)], "data map<string,string>, position long, at long")
    write_version(spark.createDataFrame([(str(i), "x") for i in range(30)], schema), f"{root}/DIM_P", 0)
    upsert_dim(spark, root, "dim_p", schema, "id", change, 0, buckets=4)
    upsert_dim(spark, root, "dim_p", schema, "id", change, 1, buckets=8)
    assert rows(read_dim(spark, root, "dim_p")) == sorted((str(i), "new" if i == 3 else "x") for i in range(30))
    upsert_dim(spark, root, "dim_p", schema, "id", change.where("position = 2"), 2, buckets=8)
    assert read_dim(spark, root, "dim_p").count() == 30


def test_source_time_orders_changes_before_position(spark, tmp_path, rows):
    root = str(tmp_path)
    routes = spark.createDataFrame([("p", "insert", "hbase", "dim_p", "id,a", "id", None)], S.ROUTES)
    ((table, (schema, pk)),) = create_dims(spark, root, routes).items()
    data = [({"id": "1", "a": "older"}, 900, 100, 1), ({"id": "1", "a": "newest"}, 3, 200, 2), ({"id": "1", "a": "newer"}, 4, 200, 1)]
    df = spark.createDataFrame(data, "data map<string,string>, position long, at long, xid long")
    upsert_dim(spark, root, table, schema, pk, df, 0)
    assert rows(read_dim(spark, root, "dim_p")) == [("1", "newest")]


def test_shuffles_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size_shuffles(spark, 0)
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
    size_shuffles(spark, 64 * 1024**3)
    assert spark.conf.get(key) == "512"
    size_shuffles(spark, 100 * 1024**4)
    assert spark.conf.get(key) == str(100 * 1024**4 // (128 * 1024**2))
    tune(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")


def test_tasks_read_bounded_parts_of_large_input(spark, tmp_path):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, size in zip(keys, ("128MB", "1m"), strict=True):
            spark.conf.set(k, size)
        with open(f"{tmp_path}/large", "wb") as f:
            f.truncate(1024**3)
        tune(spark, str(tmp_path))
        assert [spark.conf.get(k) for k in keys] == [str(16 * 1024**2), "1m"]
        assert spark.conf.get(initial) == "128"
    finally:
        for k, size in old.items():
            spark.conf.set(k, size)
        size_shuffles(spark, 0)


def test_durable_dir_comes_from_the_session(spark):
    assert durable_dir(spark, "x") == spark.conf.get("spark.checkpoint.dir") + "/x"


def test_routes_read_as_a_table(spark, tmp_path, rows):
    data = [("t", "insert", "kafka", "dwd_t", "id", "id", None)]
    spark.createDataFrame(data, S.ROUTES).write.parquet(f"{tmp_path}/table_process")
    assert rows(spark.read.parquet(f"{tmp_path}/table_process").select(F.col("source_table"))) == [("t",)]
