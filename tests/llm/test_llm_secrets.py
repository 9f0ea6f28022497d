"""Secret candidates against Python's regexes, the corpus's dictionary, findings of other templates."""

from __future__ import annotations

import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from streamhouse.llm import secret_scan

SCHEMA = "doc_id long, text string, value string, score string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "own", "own") for i, t in enumerate(texts)], SCHEMA)


def brute(text):
    out, at = [], 0
    hits = list(re.finditer(secret_scan.CANDIDATE, text))
    for m, after in zip(hits, [*(x.start() for x in hits[1:]), len(text)], strict=False):
        own = re.match(rf"(?s)^(?:{secret_scan.LEAD})?(.*)$", m[0])[1]
        lead = len(m[0]) - len(own)
        out.append((m.start() + lead, own, text[at : m.start()][-40:] + m[0][:lead], text[m.end() : after][:40]))
        at = m.end()
    return out


def test_candidates(spark):
    r = random.Random(1)
    parts = ["password=", "token: '", "AKIA", "ghp_", "key ", "\n", " ", '"', "src/", "=", "a" * 30, "é", ", "]
    texts = ["", "x" * 63 + "1", "A" * 50 + "b9" + "c" * 20, "QwErTyUiOpAsDfGhJkLzXcVb", "quitealongplainwordwithoutany", "a/b/c/d/e/f/g/h/i/j/k/l/m/n/o/p"]
    for _ in range(300):
        alphabet = r.choice([string.ascii_letters, string.ascii_letters + string.digits, string.ascii_lowercase + "/", "0123456789abcdef", string.ascii_letters + string.digits + "+/_-."])
        texts.append("".join(r.choice([*parts, "".join(r.choices(alphabet, k=r.randint(1, 70)))]) for _ in range(r.randint(0, 14))))
    found = frame(spark, texts).select("doc_id", secret_scan.candidates(F.col("text")).alias("f")).collect()
    assert {x.doc_id: [tuple(c) for c in x.f] for x in found} == {i: brute(t) for i, t in enumerate(texts)}
    assert len(brute(texts[1])) == len(brute(texts[2])) == len(brute(texts[3])) == 1 and not brute(texts[4])


def test_many_candidates_in_a_text(spark):
    """In proportion: a list of all candidates is not copied for each."""
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000))
    found = frame(spark, [text, None]).select(secret_scan.candidates(F.col("text")).alias("f")).select(F.size("f"), F.col("f")[29_999].alias("last")).first()
    assert found[0] == 30_000 and found.last.start == 29_999 * 33


def test_dictionary_counts_whole_texts(spark):
    filler = " ".join(f"w{i}x" for i in range(2_000))
    texts = [f"{filler} Zèbre {i} gamma/delta epsilon_zeta key=wordofkeys1" for i in range(5)] + ["zèbre zèbre", None, ""]
    known = {r.word: r.docs for r in secret_scan.dictionary(secret_scan.slim(frame(spark, texts))).collect()}
    assert known == {"zèbre": 6}


def test_known_words_and_pairs(spark):
    texts = ["system network manager letters of the corpus"] * 3
    rows = secret_scan.slim(frame(spark, texts))
    known = secret_scan.dictionary(rows)
    values = ["systemNetworkManager2", "SYSTEM_network", "xq9Zk2vB7wQp1LmN", "", "Системы12"]
    found = spark.createDataFrame([(v, "", "") for v in [*values, values[0]]], "value string, before string, after string")
    got = {r.value: (round(r.known, 3), r.natural) for r in secret_scan.features(found, known, secret_scan.letter_pairs(known)).collect()}
    assert [got[v][0] for v in values] == [round(20 / 21, 3), round(13 / 14, 3), 0.0, 0.0, 0.0]
    assert got[values[0]][1] > got[values[2]][1] and got[""][1] == 0.0


def test_known_words_join_on_plain_columns(spark):
    """The driver works out a join's key for every row of a side that is broadcast; lower-casing there loads its tables, too."""
    found = spark.createDataFrame([("systemNetworkManager2",)], "value string")
    known = spark.createDataFrame([("system", 3)], "word string, docs long")
    plan = secret_scan.covered(found, known)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[", plan) and not re.search(r"Join \[[^\]]*lower\(", plan)


def test_training_rows_lie_in_bounded_partitions(spark, monkeypatch):
    """However many partitions the session's shuffles have."""
    fitted = []
    monkeypatch.setattr(secret_scan, "PARTITIONS", 2)
    monkeypatch.setattr(secret_scan.RandomForestClassifier, "fit", lambda self, data: fitted.append(data))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        secret_scan.fit(frame(spark, ["system network manager letters of the corpus"] * 9))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert fitted[0].rdd.getNumPartitions() <= 2 and fitted[0].count() == 9 * 30


def test_findings_of_other_templates(spark):
    """Secrets and look-alikes in surroundings that the training does not make; recall and precision held out."""
    r = random.Random(4)
    plain = "the quick brown system reads every network message before letters of the morning reach their offices".split()
    prose = lambda k: " ".join(r.choices(plain, k=k))
    rand = lambda n, of=string.ascii_letters + string.digits: "".join(r.choices(of, k=n))
    texts = [prose(60) for _ in range(300)]
    secrets, clean = [], []
    for i in range(60):
        own = [rand(36), rand(24), "AKIA" + rand(16, string.ascii_uppercase + "234567"), rand(44)][i % 4]
        text = [f"export API_KEY='{own}'", f'"passwd": "{own}"', f"aws id {own} was left here", f"auth_key: {own}"][i % 4]
        secrets.append((len(texts), own))
        texts.append(f"{prose(12)} {text} {prose(9)}")
    for i in range(60):
        own = [f"{r.choice(plain)}/{r.choice(plain)}/{r.choice(plain)}/part{i}", hashlib.sha1(str(i).encode()).hexdigest(), f"{r.choice(plain)}-{r.choice(plain)}-{r.choice(plain)}-20{i}", f"{r.choice(plain).title()}{r.choice(plain).title()}{r.choice(plain).title()}Handler"][i % 4]
        text = [f"in {own} we", f"commit {own} fixed", f"page {own} said", f"class {own} of"][i % 4]
        clean.append(len(texts))
        texts.append(f"{prose(12)} {text} {prose(9)}")
    kept = {r.doc_id for r in secret_scan.findings(frame(spark, texts)).filter("kept").collect()}
    found = sum(i in kept for i, _ in secrets)
    wrong = sum(i in kept for i in clean)
    assert found >= 54 and wrong <= 6, (found, wrong)


def test_masks_of_many_spans(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "KEPT_SCORE", -1.0)  # all candidates
    keys = [hashlib.sha512(str(i).encode()).hexdigest()[:24] for i in range(400)]
    text = "é start " + " then ".join(f"password={k}" for k in keys) + " end"
    clean = secret_scan.redact(frame(spark, [text, "plain words", None])).orderBy("doc_id").collect()
    assert clean[0].text == "é start " + " then ".join(["password=<SECRET>"] * 400) + " end" and clean[0].n_secrets == 400
    assert clean[1].text == "plain words" and clean[2].text is None and clean[0].value == "own"
