"""Streaming jobs over a folder of topics, against the batch operators."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from streamhouse import constants as C
from streamhouse import schemas as S
from streamhouse.operators import logs, visitor, visits
from streamhouse.plans import jobs
from streamhouse.sinks.tables import StatsSink
from streamhouse.sources.tables import find_in_dim, read_dim, write_version
from streamhouse.sinks.topics import publish
from streamhouse.sources.topics import Bus, kafka_options, read_topic
from streamhouse.streaming.processors import bounces_stream, with_first_days
from streamhouse.streaming.runner import late_rows, start_console

BASE = 1_700_000_000_000
LATER = BASE + 40 * 24 * 3600 * 1000


@pytest.fixture
def house(spark, tmp_path):
    return jobs.Warehouse(
        spark=spark,
        bus=Bus(folder=str(tmp_path / "topics"), per_trigger=1),
        dims=str(tmp_path / "dims"),
        stats=StatsSink(folder=str(tmp_path / "stats")),
        checkpoints=str(tmp_path / "checkpoints"),
        available_now=True,
    )


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None
    assert not query.isActive


def topic(house, name, schema):
    values = house.spark.read.option("recursiveFileLookup", "true").text(
        f"{house.bus.folder}/topic={name}"
    )
    return logs.parse_json(values, schema).good


def topic_text(house, name):
    return house.spark.read.option("recursiveFileLookup", "true").text(f"{house.bus.folder}/topic={name}")


def stats(house, table):
    return house.spark.read.parquet(f"{house.stats.folder}/{table}")


def test_split_log(house, feed, log, rows):
    day = 24 * 3600 * 1000
    first = [
        log("a", BASE, displays=[{"item_type": "sku_id", "item": "7"}, {"item_type": "x", "item": "8"}]),
        log("b", BASE, start={"entry": "icon"}),
    ]
    second = [log("a", BASE + day), log("a", BASE + day, is_new="0"), "not json", log("b", BASE + 1)]
    feed(house.bus.folder, C.TOPIC_RAW_LOG, first)
    feed(house.bus.folder, C.TOPIC_RAW_LOG, second)
    finish(jobs.split_log(house))
    page = topic(house, C.TOPIC_PAGE, S.PAGE_LOG)
    assert rows(page, "common.mid", "common.is_new", "ts") == [
        ("a", "0", BASE + day),
        ("a", "0", BASE + day),
        ("a", "1", BASE),
        ("b", "1", BASE + 1),
    ]
    start = topic(house, C.TOPIC_START, S.PAGE_LOG)
    assert rows(start, "common.mid", "start.entry") == [("b", "icon")]
    shown = topic(house, C.TOPIC_DISPLAY, S.layout(item_type=S.STRING, item=S.STRING, page_id=S.STRING))
    assert rows(shown) == [("sku_id", "7", "home"), ("x", "8", "home")]


def test_split_log_passes_the_whole_log_on(house, feed, log, rows):
    day = 24 * 3600 * 1000
    more = {"err": {"code": 7}, "actions": [{"a": 1}]}
    second = log("a", BASE + day, displays=[{"item_type": "sku_id", "item": "7", "pos": 3}, {}], page={"page_item_type": "x"}, **more)
    second["common"]["md"] = "phone"
    feed(house.bus.folder, C.TOPIC_RAW_LOG, [log("a", BASE)])
    feed(house.bus.folder, C.TOPIC_RAW_LOG, [second, "not json", {"common": {"mid": "q"}, "ts": "soon"}])
    finish(jobs.split_log(house))
    read = house.spark.read.option("recursiveFileLookup", "true").text
    page = [json.loads(r.value) for r in read(f"{house.bus.folder}/topic={C.TOPIC_PAGE}").collect()]
    second["common"]["is_new"] = "0"
    assert second in page
    shown = [json.loads(r.value) for r in read(f"{house.bus.folder}/topic={C.TOPIC_DISPLAY}").collect()]
    assert {"item_type": "sku_id", "item": "7", "pos": 3, "page_id": "home"} in shown and {"page_id": "home"} in shown
    lost = [json.loads(r.value) for r in read(f"{house.bus.folder}/topic={C.TOPIC_DEAD_LETTER}").collect()]
    assert sorted(x["value"] for x in lost) == sorted(["not json", json.dumps({"common": {"mid": "q"}, "ts": "soon"})])
    assert all(x["source_topic"] == C.TOPIC_RAW_LOG and x["position"] for x in lost)


def test_new_visitor_days_in_any_order(house, feed, log, logs_of, rows):
    day = 24 * 3600 * 1000
    records = [log(mid, BASE + d * day + i) for i in range(3) for d in (3, 1, 2) for mid in ("a", "b")] + [log(None, BASE), log(None, BASE + day)]
    feed(house.bus.folder, C.TOPIC_RAW_LOG, records)
    finish(jobs.split_log(house))
    got = topic(house, C.TOPIC_PAGE, S.PAGE_LOG)
    want = logs.repair_new_visitors(logs_of(records))
    columns = ("common.mid", "ts", "common.is_new")
    assert rows(got, *columns) == rows(want, *columns)


def test_first_days_of_a_hot_device(house, feed, log, logs_of, rows):
    """Half of the rows have one device; its state gets one row per task, and no other flag changes."""
    day = 24 * 3600 * 1000
    first = [log("hot" if i % 2 else f"m{i}", BASE + (i % 3) * day, is_new=None if i % 7 == 0 else "1") for i in range(900)]
    second = [log("hot", BASE - day), *(log("hot", BASE + i, is_new=str(i % 2)) for i in range(90))]
    feed(house.bus.folder, C.TOPIC_RAW_LOG, first)
    feed(house.bus.folder, C.TOPIC_RAW_LOG, second)
    finish(jobs.split_log(house))
    columns = ("common.mid", "ts", "common.is_new")
    flags = {mid: min(r["ts"] // day for r in first if r["common"]["mid"] == mid and r["common"]["is_new"] == "1") for mid in {r["common"]["mid"] for r in first if r["common"]["is_new"]}}
    want = [(r["common"]["mid"], r["ts"], r["common"]["is_new"] and str(int(r["ts"] // day == flags[r["common"]["mid"]]))) for r in first]
    want += [("hot", BASE - day, "1"), *(("hot", BASE + i, "0") for i in range(90))]
    assert rows(topic(house, C.TOPIC_PAGE, S.PAGE_LOG), *columns) == sorted(want, key=repr)


def test_late_known_bounce_is_counted(house, feed, log, rows):
    """The bounce of T is known, and written, once the page log is past T + 10 s."""
    bounce = log("a", BASE)
    feed(house.bus.folder, C.TOPIC_PAGE, [bounce])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("b", BASE + 15_000, last="home")])
    feed(house.bus.folder, C.TOPIC_UNIQUE_VISIT, [bounce])
    feed(house.bus.folder, C.TOPIC_UNIQUE_VISIT, [log("b", BASE + 15_000)])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("c", BASE + 30_000, last="home")])
    feed(house.bus.folder, C.TOPIC_BOUNCE, [log("z", BASE - 60_000)])
    feed(house.bus.folder, C.TOPIC_BOUNCE, [log("z", BASE - 50_000)])
    feed(house.bus.folder, C.TOPIC_BOUNCE, [bounce])
    for name in (C.TOPIC_PAGE, C.TOPIC_UNIQUE_VISIT, C.TOPIC_BOUNCE):
        feed(house.bus.folder, name, [log("end", LATER)])
    query = jobs.visitor_stats(house)
    finish(query)
    assert late_rows(query) == 0
    got = stats(house, "visitors_stats").where("uv_ct > 0 and pv_ct > 0")
    assert [r.uj_ct for r in got.orderBy("stt").collect()][0] == 1


def test_unique_visit(house, feed, log, logs_of, rows):
    day = 24 * 3600 * 1000
    records = [
        log("a", BASE), log("a", BASE + 5), log("b", BASE + 6, last="home"),
        log("b", BASE + 7, last=""), log("a", BASE + day), log("c", BASE + day + 1),
    ]
    feed(house.bus.folder, C.TOPIC_PAGE, records[:3])
    feed(house.bus.folder, C.TOPIC_PAGE, records[3:])
    finish(jobs.unique_visit(house))
    got = topic(house, C.TOPIC_UNIQUE_VISIT, S.PAGE_LOG)
    want = visits.unique_visits(logs_of(records))
    assert rows(got, "common.mid", "ts") == rows(want, "mid", "ts")


def test_bounces_out_of_order(house, feed, log, logs_of, rows):
    chance = random.Random(5)
    records = []
    for mid in "abcdef":
        ts = BASE
        for _ in range(40):
            ts += chance.choice([1, 400, 3_000, 9_999, 10_000, 10_001, 30_000])
            records.append(log(mid, ts, last=chance.choice([None, "", "home"])))
    records.sort(key=lambda r: r["ts"])
    # Disorder within each file.
    for i in range(0, len(records), 40):
        part = records[i : i + 40]
        chance.shuffle(part)
        feed(house.bus.folder, C.TOPIC_PAGE, part)
    feed(house.bus.folder, C.TOPIC_PAGE, [log("end", LATER)])
    finish(jobs.bounce_detail(house))
    got = topic(house, C.TOPIC_BOUNCE, S.PAGE_LOG)
    want = visits.bounces(logs_of(records))
    assert rows(got, "common.mid", "ts") == rows(want, "common.mid", "ts")
    assert want.count() > 20


def test_bounces_at_equal_times(house, feed, log, logs_of, rows):
    """Ties, copies, and devices without a name, each row up to three seconds late."""
    chance = random.Random(8)
    records = []
    for mid in ("a", "b", "c", None, ""):
        ts = BASE
        for _ in range(60):
            ts += chance.choice([0, 0, 1, 999, 1_000, 9_000, 9_999, 10_000, 11_000])
            page = chance.choice(["home", "list", "cart", None])
            records += [log(mid, ts, page, last=chance.choice([None, "", "home"]))] * chance.choice([1, 1, 2])
    records.sort(key=lambda r: r["ts"] + chance.randrange(3_000))
    for i in range(0, len(records), 60):
        feed(house.bus.folder, C.TOPIC_PAGE, records[i : i + 60])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("end", LATER, last="home")])
    bounced = bounces_stream(house.records(C.TOPIC_PAGE, S.PAGE_LOG), delay="4 seconds")
    finish(house.start_topics("bounced", bounced.select(F.lit("bounced").alias("topic"), "value")))
    columns = ("common.mid", "ts", "page.page_id")
    want = rows(visits.bounces(logs_of(records)), *columns)
    assert rows(topic(house, "bounced", S.PAGE_LOG), *columns) == want
    assert len({r[0] for r in want}) == 5


def test_bounces_of_a_hot_device(house, feed, log, logs_of, rows):
    """All rows of one device: a start meets a few sums of its later rows, not the rows."""
    records = [log("hot", BASE + 7 * i, last=None if i % 3 else "home") for i in range(6_000)]
    feed(house.bus.folder, C.TOPIC_PAGE, records)
    feed(house.bus.folder, C.TOPIC_PAGE, [log("end", LATER, last="home")])
    query = jobs.bounce_detail(house)
    finish(query)
    assert rows(topic(house, C.TOPIC_BOUNCE, S.PAGE_LOG), "ts") == rows(visits.bounces(logs_of(records)), "ts")
    kept = {state.operatorName: state.numRowsTotal for p in query.recentProgress[:1] for state in p.stateOperators}
    assert kept["symmetricHashJoin"] <= 4_000 + 2 * 44


def test_streams_run_no_python(house):
    Path(house.bus.folder, f"topic={C.TOPIC_PAGE}").mkdir(parents=True)
    page = house.records(C.TOPIC_PAGE, S.PAGE_LOG)
    for df in (bounces_stream(page), with_first_days(page), visits.unique_visits(page)):
        text = df._jdf.queryExecution().analyzed().toString()
        assert not any(bad in text for bad in ("Python", "TransformWithState", "Pandas", "Arrow"))


def test_visitor_stats(house, feed, log, logs_of, rows):
    chance = random.Random(3)
    records = [
        log(chance.choice("abc"), BASE + i * 1700, last=chance.choice([None, "home"]),
            is_new=chance.choice("01"))
        for i in range(120)
    ]
    page = logs_of(records)
    first, bounced = visits.unique_visits(page), visits.bounces(page, 4_000)
    flush = [log("end", LATER)]
    for name, df in (
        (C.TOPIC_PAGE, page),
        (C.TOPIC_UNIQUE_VISIT, first),
        (C.TOPIC_BOUNCE, bounced),
    ):
        lines = [r.v for r in df.select(F.to_json(F.struct(*page.columns)).alias("v"), "ts").orderBy("ts").collect()]
        feed(house.bus.folder, name, lines)
        feed(house.bus.folder, name, flush)
    finish(jobs.visitor_stats(house))
    columns = [c for c in S.VISITOR_STATS if c != "ts"]
    want = visitor.visitor_stats(page, first, bounced)
    got = stats(house, "visitors_stats")
    assert rows(got, *columns) == rows(want, *columns)
    assert got.where("ts is null").count() == 0


def test_late_row_is_dropped(house, feed, log, rows):
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE, "good_list", page={"item": "red Ring"})])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE + 60_000, "good_list", page={"item": "bolt"})])
    # The drop takes effect one batch after the watermark has passed.
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE + 60_001, "home")])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE + 1, "good_list", page={"item": "late"})])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("end", LATER, "good_list", page={"item": "end"})])
    query = jobs.keyword_stats(house)
    finish(query)
    assert late_rows(query) == 1
    told = [json.loads(r.value) for r in topic_text(house, C.TOPIC_DEAD_LETTER).collect()]
    assert [(x["source_topic"], x["event_ms"], json.loads(x["value"])["page"]["item"]) for x in told] == [(C.TOPIC_PAGE, BASE, "late")]
    # Event time has whole seconds, the watermark is two seconds behind.
    assert told[0]["late_ms"] == 58_000
    got = stats(house, "keyword_stats")
    assert rows(got, "keyword", "ct", "source") == [
        ("bolt", 1, "SEARCH"), ("red", 1, "SEARCH"), ("ring", 1, "SEARCH"),
    ]


def test_late_rows_of_many_batches_and_a_restart(house, feed, log, rows):
    """As many rows in the side output as the query drops, also in the first batch after a restart."""
    chance = random.Random(2)
    page = lambda ts, word: log("a", ts, "good_list", page={"item": word})
    dropped, at = 0, BASE
    for part in range(2):
        for _ in range(6):
            at += chance.choice([1_000, 12_000, 40_000])
            words = [page(at - chance.choice([0, 2_000, 11_000, 25_000, 90_000]), f"w{chance.randrange(10**6)}") for _ in range(8)]
            feed(house.bus.folder, C.TOPIC_PAGE, [*words, log("a", at - 50_000, "home"), page(at, "now")])
        query = jobs.keyword_stats(house)
        finish(query)
        dropped += late_rows(query)
    told = [json.loads(r.value) for r in topic_text(house, C.TOPIC_DEAD_LETTER).collect()]
    assert len(told) == dropped > 10
    assert all(x["late_ms"] > 0 and json.loads(x["value"])["page"]["page_id"] == "good_list" for x in told)


def test_late_rows_of_every_branch(house, feed, log, rows):
    for topic_ in (C.TOPIC_PAGE, C.TOPIC_UNIQUE_VISIT, C.TOPIC_BOUNCE):
        for ts in (BASE, LATER, LATER + 1, BASE + 5, LATER + 2):
            feed(house.bus.folder, topic_, [log("a", ts)])
    query = jobs.visitor_stats(house)
    finish(query)
    told = [json.loads(r.value) for r in topic_text(house, C.TOPIC_DEAD_LETTER).collect()]
    assert sorted((x["source_topic"], x["event_ms"]) for x in told) == sorted((t, BASE + 5) for t in (C.TOPIC_PAGE, C.TOPIC_UNIQUE_VISIT, C.TOPIC_BOUNCE))
    assert stats(house, "visitors_stats").groupBy().sum("pv_ct", "uv_ct", "uj_ct").first()[:] == (1, 1, 1)


@pytest.mark.parametrize("idle", [None, "30 minutes"])
def test_silent_topics(house, feed, log, rows, idle):
    """Two topics bring one early row and others none: they hold windows open for good, or for half an hour of event time."""
    folder = house.bus.folder
    at, hour = "2023-11-14 22:13:20", 3_600_000
    feed(folder, C.TOPIC_FAVOR, [{"sku_id": 7, "create_time": at}])
    feed(folder, C.TOPIC_PAYMENT_WIDE, [{"payment_id": 1, "order_id": 1, "sku_id": 7, "split_total_amount": 1.0, "payment_create_time": at}])
    for name in (C.TOPIC_CART, C.TOPIC_REFUND, C.TOPIC_COMMENT, C.TOPIC_ORDER_WIDE):
        Path(folder, f"topic={name}").mkdir()
    view = lambda ts: log("a", ts, "good_detail", page={"item": "7"})
    feed(folder, C.TOPIC_PAGE, [view(BASE), view(BASE + 1)])
    feed(folder, C.TOPIC_PAGE, [view(BASE + hour), view(BASE + hour + 10_000)])
    feed(folder, C.TOPIC_PAGE, [view(BASE + 2 * hour)])
    query = jobs.product_stats(replace(house, idle=idle))
    finish(query)
    if idle is None:
        assert not Path(house.stats.folder, "product_stats").exists() or stats(house, "product_stats").count() == 0
        return
    assert late_rows(query) == 0
    got = stats(house, "product_stats")
    assert rows(got, "stt", "click_ct", "favor_ct", "paid_order_ct") == [
        (at, 2, 1, 1), ("2023-11-14 23:13:20", 1, 0, 0), ("2023-11-14 23:13:30", 1, 0, 0),
    ]


def test_a_branch_may_lag_less_than_the_idle_time(house, feed, log, rows):
    page = [log("a", BASE), log("a", BASE + 50_000, last="home"), log("a", BASE + 100_000, last="home"), log("a", BASE + 300_000, last="home")]
    for record in page:
        feed(house.bus.folder, C.TOPIC_PAGE, [record])
    for ts in (BASE + 20_000, BASE + 60_000):
        feed(house.bus.folder, C.TOPIC_BOUNCE, [log("b", ts)])
    feed(house.bus.folder, C.TOPIC_UNIQUE_VISIT, [log("b", BASE + 40_000)])
    query = jobs.visitor_stats(replace(house, idle="2 minutes"))
    finish(query)
    assert late_rows(query) == 0
    got = stats(house, "visitors_stats")
    assert got.groupBy().sum("pv_ct", "uj_ct", "uv_ct").first()[:] == (3, 2, 1)


def test_keywords_by_lexicon(house, feed, log, rows, spark):
    lexicon = spark.createDataFrame([("小米",), ("智能手机",)], "word string")
    house = replace(house, lexicon=lambda: lexicon)
    search = lambda ts, text: log("a", ts, "good_list", page={"item": text})
    feed(house.bus.folder, C.TOPIC_PAGE, [search(BASE, "小米智能手机 Pro"), search(BASE + 1, "小米智能手机 Pro"), search(BASE + 2, "小米")])
    feed(house.bus.folder, C.TOPIC_PAGE, [search(LATER, "end")])
    finish(jobs.keyword_stats(house))
    assert rows(stats(house, "keyword_stats"), "keyword", "ct", "source") == [
        ("pro", 2, "SEARCH"), ("小米", 3, "SEARCH"), ("智能手机", 2, "SEARCH"),
    ]
    row = {"spu_name": "小米智能手机", "click_ct": 3, "cart_ct": 0, "order_ct": 1, "stt": "s", "edt": "e"}
    feed(house.bus.folder, C.TOPIC_PRODUCT_STATS, [row])
    finish(jobs.product_keyword_stats(house))
    got = stats(house, "keyword_stats").where("stt = 's'")
    assert rows(got, "keyword", "ct", "source") == [
        ("小米", 1, "ORDER"), ("小米", 3, "CLICK"), ("智能手机", 1, "ORDER"), ("智能手机", 3, "CLICK"),
    ]


def dim(house, table, columns, data):
    df = house.spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    write_version(df, f"{house.dims}/{table}", 0)


def order(i, at, **more):
    return {"id": i, "province_id": 1, "user_id": 5, "order_status": "1001", "total_amount": 30.5,
            "create_time": at, **more}


def detail(i, order_id, at, sku, amount):
    return {"id": i, "order_id": order_id, "sku_id": sku, "order_price": amount, "sku_num": 2,
            "sku_name": "own", "create_time": at, "split_total_amount": amount}


def test_order_chain(house, feed, log, rows):
    """Orders to wide rows, payments, product and province statistics, product keywords."""
    # One batch per job: its flush rows share part files with the others.
    house = replace(house, bus=Bus(folder=house.bus.folder))
    dim(house, "DIM_BASE_PROVINCE", ["id", "name", "area_code", "iso_code", "iso_3166_2"],
        [("1", "North", "11", "N", "CN-N")])
    dim(house, "DIM_USER_INFO", ["id", "birthday", "gender"], [("5", "1990-01-01", "F")])
    dim(house, "DIM_SKU_INFO", ["id", "sku_name", "price", "spu_id", "category3_id", "tm_id"],
        [("7", "Red Ring", "9.5", "70", "3", "4")])
    dim(house, "DIM_SPU_INFO", ["id", "spu_name"], [("70", "Ring")])
    at, pay, late = "2023-11-14 22:13:20", "2023-11-14 22:13:25", "2023-11-14 23:13:20"
    far = "2024-02-01 00:00:00"
    folder = house.bus.folder
    feed(folder, C.TOPIC_ORDER_INFO, [order(1, at), order(2, at), order(99, far)])
    feed(folder, C.TOPIC_ORDER_DETAIL, [
        detail(11, 1, at, 7, 10.25), detail(12, 1, at, 7, 20.25), detail(21, 2, at, 8, 5.0),
        detail(31, 2, pay, 7, 1.0), detail(991, 99, far, 8, 1.0),
    ])
    finish(jobs.order_wide(house))
    wide = topic(house, C.TOPIC_ORDER_WIDE, S.ORDER_WIDE)
    assert rows(
        wide.where("order_id < 99"), "detail_id", "sku_name", "spu_name", "tm_name",
        "province_name", "user_gender", "create_date", "create_hour",
    ) == [
        (11, "Red Ring", "Ring", None, "North", "F", "2023-11-14", "22"),
        (12, "Red Ring", "Ring", None, "North", "F", "2023-11-14", "22"),
        (21, "own", None, None, "North", "F", "2023-11-14", "22"),
    ]

    feed(folder, C.TOPIC_PAYMENT_INFO, [
        {"id": 900, "order_id": 1, "user_id": 6, "total_amount": 31.0, "subject": "s",
         "payment_type": "1101", "create_time": pay, "callback_time": pay},
        {"id": 901, "order_id": 2, "user_id": 6, "total_amount": 31.0, "subject": "s",
         "payment_type": "1101", "create_time": late, "callback_time": late},
    ])
    finish(jobs.payment_wide(house))
    paid = topic(house, C.TOPIC_PAYMENT_WIDE, S.PAYMENT_WIDE)
    assert rows(paid, "payment_id", "detail_id", "user_id", F.col("total_amount").cast("double")) == [
        (900, 11, 6, 31.0), (900, 12, 6, 31.0),
    ]

    flush_pay = [{"payment_id": 1, "order_id": 990, "sku_id": 8, "split_total_amount": 1.0,
                  "payment_create_time": far}]
    small = {"sku_id": 8, "create_time": far}
    feed(folder, C.TOPIC_PAYMENT_WIDE, flush_pay)
    feed(folder, C.TOPIC_PAGE, [log("a", BASE, "good_detail", page={"item": "7"},
                                    displays=[{"item_type": "sku_id", "item": "7"}])])
    feed(folder, C.TOPIC_PAGE, [log("end", LATER + LATER - BASE)])
    feed(folder, C.TOPIC_FAVOR, [{"sku_id": 7, "create_time": at}, small])
    feed(folder, C.TOPIC_CART, [{"sku_id": 7, "create_time": at}, small])
    feed(folder, C.TOPIC_REFUND, [
        {"sku_id": 7, "order_id": 1, "refund_amount": 2.5, "create_time": at},
        {"sku_id": 7, "order_id": 1, "refund_amount": 2.5, "create_time": at},
        {**small, "order_id": 990, "refund_amount": 1.0},
    ])
    feed(folder, C.TOPIC_COMMENT, [
        {"sku_id": 7, "appraise": "1201", "create_time": at},
        {"sku_id": 7, "appraise": "1203", "create_time": at}, {**small, "appraise": "1201"},
    ])
    finish(jobs.product_stats(house))
    product = stats(house, "product_stats").where("sku_id = 7")
    got = [r.asDict() for r in product.orderBy("stt").collect()]
    assert len(got) == 1
    first = got[0]
    assert (first["stt"], first["edt"]) == (at, "2023-11-14 22:13:30")
    assert (first["order_ct"], first["order_sku_num"], float(first["order_amount"])) == (1, 4, 30.5)
    assert (first["paid_order_ct"], float(first["payment_amount"])) == (1, 30.5)
    assert (first["refund_order_ct"], float(first["refund_amount"])) == (1, 5.0)
    assert (first["click_ct"], first["display_ct"], first["favor_ct"], first["cart_ct"]) == (1, 1, 1, 1)
    assert (first["comment_ct"], first["good_comment_ct"]) == (2, 1)
    assert (first["sku_name"], first["spu_name"], first["tm_id"]) == ("Red Ring", "Ring", 4)

    finish(jobs.province_stats(house))
    province = stats(house, "province_stats").where(F.col("stt") == at)
    assert rows(province, "province_name", "area_code", "order_count", F.col("order_amount").cast("double")) == [
        ("North", "11", 2, 35.5)
    ]

    finish(jobs.product_keyword_stats(house))
    words = stats(house, "keyword_stats")
    assert rows(words, "keyword", "ct", "source", "stt") == [
        ("ring", 1, "CART", at), ("ring", 1, "CLICK", at), ("ring", 1, "ORDER", at),
    ]


def test_route_changes(house, feed, spark, rows):
    routes = spark.createDataFrame(
        [
            ("base_province", "insert", "hbase", "dim_base_province", "id,name", "id", None),
            ("base_province", "update", "hbase", "dim_base_province", "id,name", "id", None),
            ("order_info", "insert", "kafka", "dwd_order_info", "", "id", None),
        ],
        S.ROUTES,
    )
    house = replace(house, routes=lambda: routes)
    change = lambda table, kind, **data: {"table": table, "type": kind, "data": data, "ts": 1}
    folder = house.bus.folder
    feed(folder, C.TOPIC_RAW_DB, [
        change("base_province", "bootstrap-insert", id=1, name="North", extra="x"),
        change("base_province", "insert", id=2, name="South", extra="x"),
        change("order_info", "insert", id=5, total=3.5), change("order_info", "delete", id=5),
        change("unknown", "insert", id=5), {"table": "order_info", "type": "insert", "data": {}},
        "broken",
    ])
    feed(folder, C.TOPIC_RAW_DB, [change("base_province", "update", id=1, name="North-East")])
    finish(jobs.route_changes(house))
    facts = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/topic=dwd_order_info")
    assert rows(facts) == [('{"id":"5","total":"3.5"}',)]
    dim_rows = read_dim(spark, house.dims, "dim_base_province")
    assert rows(dim_rows) == [("1", "North-East"), ("2", "South")]
    assert rows(find_in_dim(dim_rows, id="2", name="South")) == [("2", "South")]
    assert rows(find_in_dim(dim_rows, id="2", name="North")) == []


def test_routes_survive_a_restart(house, feed, spark, rows):
    """A route that left the configuration is still in use after a restart."""
    first = [("order_info", "insert", "kafka", "dwd_order_info", "", "id", None), ("cart", "insert", "kafka", "dwd_cart", "id", "id", None)]
    change = lambda table, **data: {"table": table, "type": "insert", "data": data, "ts": 1}
    folder = house.bus.folder
    feed(folder, C.TOPIC_RAW_DB, [change("order_info", id=1)])
    finish(jobs.route_changes(replace(house, routes=lambda: spark.createDataFrame(first, S.ROUTES))))
    feed(folder, C.TOPIC_RAW_DB, [change("order_info", id=2), change("cart", id=3, sku=4)])
    later = [("cart", "insert", "kafka", "dwd_cart", "id,sku", "id", None)]
    finish(jobs.route_changes(replace(house, routes=lambda: spark.createDataFrame(later, S.ROUTES))))
    assert rows(topic_text(house, "dwd_order_info")) == [('{"id":"1"}',), ('{"id":"2"}',)]
    assert rows(topic_text(house, "dwd_cart")) == [('{"id":"3","sku":"4"}',)]


def test_routes_of_a_repeated_batch(spark, tmp_path, rows):
    """A batch starts from the routes before it, not from what its own first try stored."""
    route = lambda name, sink: (name, "insert", "kafka", sink, "", "id", None)
    refresh = lambda batch, *routes: rows(jobs.refresh_routes(spark, str(tmp_path / "r"), spark.createDataFrame(list(routes), S.ROUTES), batch), "source_table", "sink_table")
    assert refresh(0, route("a", "x")) == [("a", "x")]
    assert refresh(1, route("b", "y")) == [("a", "x"), ("b", "y")]
    assert refresh(1, route("a", "z")) == [("a", "z")]
    assert refresh(2, route("a", "z")) == [("a", "z")]
    with pytest.raises(ValueError, match="empty"):
        jobs.refresh_routes(spark, str(tmp_path / "other"), spark.createDataFrame([], S.ROUTES), 0)


def test_a_batch_written_twice_is_read_once(house, log, rows, spark, tmp_path):
    bus = Bus(folder=f"{house.bus.folder}-once", per_trigger=1, once=True)
    run = tmp_path / "run"
    run.mkdir()
    (run / "metadata").write_text('{"id":"r1"}')
    record = lambda ts, item: (C.TOPIC_PAGE, json.dumps(log("a", ts, "good_list", page={"item": item})))
    df = lambda *data: spark.createDataFrame(list(data), "topic string, value string")
    first = [record(BASE, "red ring"), record(BASE, "red ring"), record(BASE + 1, "bolt")]
    publish(df(*first), bus, "writer", 0, str(run))
    publish(df(*reversed(first)), bus, "writer", 0, str(run))
    publish(df(record(BASE + 2, "bolt")), bus, "writer", 1, str(run))
    # What a repeated batch computes anew does not count, only what its first try wrote.
    publish(df(record(BASE + 3, "other")), bus, "writer", 1, str(run))
    folder = f"{bus.folder}/topic={C.TOPIC_PAGE}"
    spark.createDataFrame([(record(at, "nut")[1], None) for at in (BASE + 4, LATER)], "value string, record string").coalesce(1).write.mode("append").parquet(folder)
    assert spark.read.parquet(folder).count() == 10
    once = replace(house, bus=bus)
    finish(jobs.keyword_stats(once))
    want = [("bolt", 2), ("nut", 1), ("red", 2), ("ring", 2)]
    assert rows(stats(once, "keyword_stats").where("stt < '2023-12-01'"), "keyword", "ct") == want
    # A reader that has read the first try already drops the second as well.
    publish(df(*first), bus, "writer", 0, str(run))
    finish(jobs.keyword_stats(once))
    assert rows(stats(once, "keyword_stats").where("stt < '2023-12-01'"), "keyword", "ct") == want


def test_jobs_on_an_exactly_once_bus(house, log, rows, spark):
    """The page jobs from raw log to statistics; then each topic's last batch is published again."""
    bus = Bus(folder=f"{house.bus.folder}-once", once=True)
    once = replace(house, bus=bus)
    records = [log("a", BASE), log("a", BASE + 1_000, last="home"), log("b", BASE + 2_000), log("end", LATER)]
    raw = spark.createDataFrame([(json.dumps(r), None) for r in records], "value string, record string")
    raw.write.parquet(f"{bus.folder}/topic={C.TOPIC_RAW_LOG}")
    finish(jobs.split_log(once))
    for job in (jobs.unique_visit, jobs.bounce_detail):
        finish(job(once))
    for name in ("split_log", "unique_visit", "bounce_detail"):
        publish(spark.createDataFrame([], "topic string, value string"), bus, name, 0, once.folder(name))
    for name in (C.TOPIC_UNIQUE_VISIT, C.TOPIC_BOUNCE):
        spark.createDataFrame([(json.dumps(log("end", LATER + 1)), None)], "value string, record string").write.mode("append").parquet(f"{bus.folder}/topic={name}")
    finish(jobs.visitor_stats(once))
    got = stats(once, "visitors_stats").where("stt < '2023-12-01'")
    assert rows(got.groupBy().sum("uv_ct", "pv_ct", "sv_ct", "uj_ct")) == [(2, 3, 2, 1)]


def test_records_with_ids_in_kafka():
    assert kafka_options(Bus(servers="a:9092", once=True), "t", None, "latest")["includeHeaders"] == "true"
    with pytest.raises(ValueError, match="checkpoint"):
        publish(None, Bus(servers="a:9092", once=True), "w", 0)


def test_console_prints_every_row(house, feed, capsys):
    feed(house.bus.folder, "t", [f"hello {i}" for i in range(30)])
    topic_rows = read_topic(house.spark, house.bus, "t").select("value")
    query = start_console(topic_rows, "shown", house.checkpoints, available_now=True)
    finish(query)
    assert capsys.readouterr().out.count('{"value":"hello') == 30


def test_repeated_batches_change_nothing(house, feed, log, rows):
    """A job that starts over without its checkpoint replaces what it wrote before."""
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE), log("b", BASE + 1), log("a", BASE + 2)])
    finish(jobs.unique_visit(house))
    once = rows(topic(house, C.TOPIC_UNIQUE_VISIT, S.PAGE_LOG), "common.mid", "ts")
    again = replace(house, checkpoints=f"{house.checkpoints}-again")
    finish(jobs.unique_visit(again))
    assert rows(topic(house, C.TOPIC_UNIQUE_VISIT, S.PAGE_LOG), "common.mid", "ts") == once


def test_restart_goes_on_where_it_stopped(house, feed, log, rows):
    day = 24 * 3600 * 1000
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE), log("b", BASE + 1)])
    finish(jobs.unique_visit(house))
    feed(house.bus.folder, C.TOPIC_PAGE, [log("a", BASE + 5), log("b", BASE + day), log("c", BASE + 6)])
    finish(jobs.unique_visit(house))
    assert rows(topic(house, C.TOPIC_UNIQUE_VISIT, S.PAGE_LOG), "common.mid", "ts") == [
        ("a", BASE), ("b", BASE + 1), ("b", BASE + day), ("c", BASE + 6),
    ]


def test_first_day_survives_a_restart(house, feed, log, rows):
    day = 24 * 3600 * 1000
    feed(house.bus.folder, C.TOPIC_RAW_LOG, [log("a", BASE), log("old", BASE, is_new="0")])
    finish(jobs.split_log(house))
    feed(house.bus.folder, C.TOPIC_RAW_LOG, [log("a", BASE + day), log("old", BASE + day)])
    finish(jobs.split_log(house))
    page = topic(house, C.TOPIC_PAGE, S.PAGE_LOG)
    assert rows(page, "common.mid", "ts", "common.is_new") == [
        ("a", BASE, "1"), ("a", BASE + day, "0"), ("old", BASE, "0"), ("old", BASE + day, "1"),
    ]


def test_bounces_with_disorder_across_files(house, feed, log, logs_of, rows):
    """Rows up to the delay late, spread over files, give the batch result."""
    chance = random.Random(11)
    records = []
    for mid in "abcd":
        ts = BASE
        for _ in range(30):
            ts += chance.choice([300, 3_000, 9_999, 10_000, 25_000])
            records.append(log(mid, ts, last=chance.choice([None, "home"])))
    # Each record arrives up to 15 seconds after its time.
    records.sort(key=lambda r: r["ts"] + chance.randrange(15_000))
    for i in range(0, len(records), 20):
        feed(house.bus.folder, C.TOPIC_PAGE, records[i : i + 20])
    feed(house.bus.folder, C.TOPIC_PAGE, [log("end", LATER)])
    log_stream = house.records(C.TOPIC_PAGE, S.PAGE_LOG)
    bounced = bounces_stream(log_stream, delay="20 seconds")
    out = bounced.select(F.lit("bounced").alias("topic"), "value")
    finish(house.start_topics("bounced", out))
    want = visits.bounces(logs_of(records))
    assert rows(topic(house, "bounced", S.PAGE_LOG), "common.mid", "ts") == rows(
        want, "common.mid", "ts"
    )
