from __future__ import annotations

import json
import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="streamhouse-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from streamhouse.streaming.runner import prepare

    yield prepare(session)
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame's rows."""

    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return take


@pytest.fixture
def feed(tmp_path):
    """Write JSON lines as further files of a topic below a folder."""
    count = iter(range(1, 10_000))

    def write(folder, topic, records):
        where = Path(folder) / f"topic={topic}"
        where.mkdir(parents=True, exist_ok=True)
        text = "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records)
        number = next(count)
        file = where / f"part-{number:05d}.txt"
        file.write_text(text + "\n")
        # Files are read in order of their time, one second apart.
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))

    return write


@pytest.fixture
def log():
    """Build one page log record."""

    def make(mid, ts, page_id="home", last=None, is_new="1", **more):
        page = {"page_id": page_id, "during_time": 100}
        if last is not None:
            page["last_page_id"] = last
        page.update(more.pop("page", {}))
        common = {"mid": mid, "is_new": is_new, "vc": "v1", "ch": "web", "ar": "11"}
        return {"common": common, "page": page, "ts": ts, **more}

    return make


@pytest.fixture
def logs_of(spark):
    """Page logs as a batch DataFrame."""
    from streamhouse.operators.logs import parse_json
    from streamhouse.schemas import PAGE_LOG

    def make(records):
        values = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
        return parse_json(values, PAGE_LOG).good

    return make
