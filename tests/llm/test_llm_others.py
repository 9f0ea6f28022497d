"""Chat windows, pages, the pipeline and the registration."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from streamhouse.llm import chat, pages
from streamhouse.llm.queries import PROBE, QUERIES

SMALL = "/root/testdata/sf0.001"


def digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = set()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        every = "".join(f"{role}\n{x}\n" for *_, role, x in turns)
        out.add((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_chat_windows(spark):
    r = random.Random(1)
    roles, texts = ["user", "assistant", "system", None, "a\nb", "</s>"], [None, "", "</s> x \\", "[INST]\n", "<|end|>\n<|turn|>"]
    rows = [(c, t, r.choice(roles), r.choice([*texts, "é" * r.randint(0, 900)])) for c in (1, 2, None) for t in [*range(600), 5, 5, None]]
    rows += [(9, 0, "system", "sys"), *((9, t, "assistant" if t % 2 == 0 else "user", "w" * r.randint(0, 3000)) for t in range(1, 530)), (10, 0, "assistant", "z" * 50_000), *PROBE]
    df = spark.createDataFrame([(*x, "own", 1) for x in rows], "conv_id long, turn long, role string, text string, block string, kind int").repartition(7)
    windows = chat.windows(df).cache()
    found = chat.digests(windows).collect()
    assert {tuple(x)[:5] for x in found} == digests(rows)
    assert all(x.formatted_chars > 0 for x in found)
    for w in windows.filter("conv_id = 9").collect():
        turns = chat.parsed(w.text)
        assert turns[0] == ("system", "sys")
        assert sum(chat.tokens(t) for _, t in turns) <= chat.BUDGET or w.n_turns == 1
        assert len(w.loss_from) == sum(role == "assistant" for role, _ in turns[w.n_repeated :])
    assert windows.filter("conv_id = 9 and block > 0 and n_repeated < 1").count() == 0
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


@pytest.mark.parametrize("at", [None, -700, -3, 0, 5, 300, 511, 900])
def test_every_window_after_the_first_system_turn_has_it(spark, at):
    """Whatever its number; a later system turn does not take its place."""
    numbers = [None, *range(-900, -500, 9), *range(-300, 0, 7), *range(1, 1_400, 3)]
    rows = [(1, t, "user" if k % 2 else "assistant", f"{k} " + "w" * 400) for k, t in enumerate(numbers)]
    df = spark.createDataFrame([*rows, (1, at, "system", "rules"), (1, 1_399, "system", "later")], "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.windows(df).orderBy("block", "window").collect()
    turns = [(w.n_repeated, chat.parsed(w.text)) for w in windows]
    own = [x for n, t in turns for x in t[n:]]
    first = own.index(("system", "rules"))
    seen = 0
    for n, each in turns:
        assert (each[0] == ("system", "rules") and n > 0) == (seen > first), each[0]
        seen += len(each) - n
    assert {tuple(x)[:5] for x in chat.digests(chat.windows(df)).collect()} == digests([tuple(r) for r in df.collect()])


def test_escaping():
    r = random.Random(2)
    parts = ["<", "s>", "</s>", "[INST]", "\\", "\n", "a", "<|end|>", "<|turn|>", "|>", "<</SYS>>"]
    for _ in range(2000):
        t = "".join(r.choices(parts, k=r.randint(0, 8)))
        escaped = chat.escape(t)
        assert chat.unescape(escaped) == t and not any(c in escaped for c in chat.CONTROLS)
        assert chat.parsed(chat.formatted([(t, t), (t, "")], 0)[0]) == [(t, t), (t, "")]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/x">X</a></ul></nav>'
    '<!-- ad --><div class="ad">Buy</div><article><h1>H &amp; é</h1><p><b>One<br><p>Two  <i>x</i>y\n z</p><aside>s</aside><p class="notice">N</p>'
    '<p>Three 1 < 2 &lt;b&gt;</p><form><input>f</form><section class="comments"><article class="comment"><p>c</p></article></section><p>Four</article>'
    "<footer>&copy; f</footer></body>"
)


def test_page_structure():
    assert pages.main_text(PAGE, [])[0] == "H & é\nOne\nTwo xy z\nThree 1 < 2 <b>\nFour"
    assert pages.main_text("", [])[0] == "" and pages.main_text("plain &am", [])[0] == "plain &am"
    assert pages.main_text("<p>a<script>b", [])[0] == "a" and pages.main_text("<!-- x", [])[0] == ""


def test_embedded_elements_and_teasers():
    text = lambda html: pages.main_text(html, [])[0]
    assert text("<article><p>a<svg/>b</p><p>rest</p></article>") == "ab\nrest"
    assert text('<article><p>a<math xmlns="m" />b</p><svg width=1><text>x</text></svg><p>rest</p></article>') == "ab\nrest"
    assert text("<article><p>a<svg><path>b</p><p>rest</p><iframe>c</article>") == "ab\nrest\nc"
    assert text("<p>a<script/>b</p>") == "a" and text("<p>a<style>b</style>c</p>") == "ac"
    assert text('<div><p>Body</p><article class="teaser"><p>More</p></article></div>') == "Body\nMore"
    assert text('<main><p>Body</p><article class="card"><p>More</p></article></main><p>x</p>') == "Body\nMore"


def test_shared_lines():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        found = pages.shared(a, b)
        rest = iter(b)
        assert len(found) == d[-1][-1] and all(a[i] in rest for i in sorted(found))


def test_pages(spark):
    plain = "<div>Menu</div><p>Text {}</p><div>Rights</div>"
    rows = [(i, f"http://a.example/p/{i}", plain.format(i)) for i in range(30)] + [(40, "http://b.example/", plain.format("alone")), (41, None, None), (42, "::bad", ""), (43, "http://a.example/p/3", PAGE), (43, "http://a.example/p/3", PAGE)]
    df = spark.createDataFrame([(*x, "own") for x in rows], "page_id long, url string, html string, other string").repartition(4)
    found = sorted((tuple(r) for r in pages.extract(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    main = pages.main_text(PAGE, [])[0]
    expected = [(i, f"http://a.example/p/{i}", f"Text {i}", len(f"Text {i}")) for i in range(30)]
    expected += [(40, "http://b.example/", "Menu\nText alone\nRights", 22), (41, None, "", 0), (42, "::bad", "", 0)] + [(43, "http://a.example/p/3", main, len(main))] * 2
    beside = {3, 30}  # pages next to an article share no furniture with it
    strip = lambda rows: [r for r in rows if r[0] not in beside]
    assert [r for r in strip(found) if r[0] != 4] == [r for r in strip(sorted(expected, key=str)) if r[0] != 4]
    assert pages.extract(df.limit(0)).count() == 0


def test_nearest_pages_do_not_depend_on_ranges(spark):
    rows = [(i, f"http://h{i % 2}.example/{i * 7 % 50:03d}") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.col("page_id"))
    expected = {}
    for host in (0, 1):
        own = sorted((u, i) for i, u in rows if i % 2 == host)
        for k, (_, i) in enumerate(own):
            expected[i] = own[k - 1][1] if k else own[1][1]
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {r.key: r.other for r in pages.nearest(df.repartition(3)).collect()} == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 or name.startswith(("op3", "op6"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= ids, name
        ids = now
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == ids and all(r.round_trip for r in out)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert sum(labels[i].quality == 0 for i in ids if i in labels) <= 2


def test_pipeline_stages_share_parquet_only(spark, monkeypatch):
    """Each stage reads what the stage before it has written, in a folder of the run's own."""
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs.withColumn("n_chars", F.col("n_chars") + 1)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    outs = [corpus_pipeline.run(spark, SMALL) for _ in range(2)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for out in outs:
        assert sorted((r.doc_id, r.n_chars) for r in out.collect()) == sorted((r.doc_id, r.n_chars + 3) for r in docs.collect())
    assert all(SMALL in f for k in (0, 3) for f in read[k])
    assert all(SMALL not in f for k in (1, 2, 4, 5) for f in read[k]) and not set(read[2]) & set(read[5])
