"""Secret scans: a random forest removes false positives from candidate strings. Built-in functions and the JVM's forest only.

Candidates are key-like strings: with a digit among letters however late it comes, of mixed letters, with a known prefix, or
assigned to a credential's name. The forest sees their length, shares of character kinds, transitions between kinds, how
natural their pairs of letters are, how much of them are words of the corpus, path marks, and the words before and after.

The dictionary counts the words of all whole texts: known is a word that stands by itself in one of KNOWN_IN documents or
more. It stays a table (its size is at most KNOWN_IN times the words of a mean document) that candidates' words are joined
with. Pairs of letters are counted over the same words; they are 676 numbers at most.

The forest is trained on labelled findings that are derived from a bounded sample of documents (SAMPLE rows expected, by a
hash): random strings made from the row's SHA-512 under several names and prefixes, and look-alikes made from the row's own
words, paths, numbers, digests and placeholders.

Defined cases: null text is empty and has no candidates; spans count characters from 0; repeated rows and ids each have their
findings, and redaction treats rows of equal id and text alike; empty tables give no rows; other columns are ignored by the
scan and kept by redact(). A document's spans are gathered per document, never per source. Time grows in proportion with the
candidates of a text, but for a part of (candidates / BLOCK) ** 2.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

SAMPLE = 1_200
TREES, DEPTH = 24, 8
#: Of the training rows at most; each round of the forest starts a task for each.
PARTITIONS = 64
KEPT_SCORE = 0.5
#: A known word stands in one of so many documents, and has so many letters.
KNOWN_IN, LETTERS = 1_000, 4
NEAR = 40
BLOCK = 256
MASK = "<SECRET>"
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key"
PREFIXES = "AKIA|ASIA|AGPA|AIDA|ghp_|gho_|ghs_|github_pat_|glpat-|xoxb-|xoxp-|xoxa-|sk_live_|rk_live_|sk-|AIza|ya29|eyJ|npm_|pypi-"
LEAD = rf"""(?i:{NAMES})["']?\s{{0,2}}[:=]\s{{0,2}}["']?"""
CANDIDATE = (
    rf"""{LEAD}[^\s"',;<>()]{{8,}}"""
    rf"|(?<![A-Za-z0-9+/_\-])(?:(?:{PREFIXES})[A-Za-z0-9+/_.\-]{{10,}}|(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{{16,}}={{0,2}}"
    r"|(?=[a-z+/]*+[A-Z]++[a-z+/]++[A-Z]++[a-z+/]++[A-Z])[A-Za-z+/]{20,}={0,2})"
)
#: Words beside digests, numbers and examples.
HARMLESS = r"(?i)\b(?:sha\d*|md5|commit|hash|digest|checksum|uuid|guid|isbn|issn|doi|tel|phone|fax|id|version|example|sample|placeholder|test|dummy|http|https|www)\W{0,4}$"
HARMLESS_AFTER = r"(?i)^\W{0,4}(?:is|was|an?|as|for)?\W{0,2}\b(?:sha\d*|md5|commit|hash|digest|checksum|uuid|isbn|example|sample|placeholder|dummy|revision|version|path|file|folder)\b"
#: Kinds of characters: lower, upper, digit; all others are themselves, or o.
KINDS = {"l": string.ascii_lowercase, "u": string.ascii_uppercase, "d": string.digits}
PAIRS = [a + b for a in "ludo" for b in "ludo" if a != b]
FEATURES = ["length", "digits", "uppers", "lowers", "others", *PAIRS, *"distinct natural known hexes path dots named assigned quoted prefixed harmless harmless_after".split()]


def value(hit: Column) -> Column:
    return F.regexp_extract(hit, rf"(?s)^(?:{LEAD})?(.*)$", 1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def sums_before(sizes: Column) -> Column:
    """For each size the sum of those before it: within blocks of BLOCK, then from block to block, so no long list is copied for each."""
    empty = F.array().cast("array<int>")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)))

    def within(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), empty.alias("out"))
        return F.aggregate(block, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    def placed(blocks: Column) -> Column:
        def begin(totals: Column) -> Column:
            starts = F.transform(totals, lambda _, k: total(F.slice(totals, F.lit(1), k)))
            return F.flatten(F.zip_with(blocks, starts, within))

        return let(F.transform(blocks, total), begin)

    return let(cut, placed)


def candidates(text: Column) -> Column:
    """Of a text: start and text of each candidate value, and what stands before it and after it."""
    pattern = F.lit(CANDIDATE)
    cut = F.struct(F.call_function("split", text, pattern, F.lit(-1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def found(x: Column) -> Column:
        gap, hits = x["gap"], x["hit"]
        sizes = F.zip_with(gap, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def each(before: Column) -> Column:
            def one(hit: Column, k: Column) -> Column:
                own = value(hit)
                lead = F.length(hit) - F.length(own)
                return F.struct(
                    (before[k] + F.length(gap[k]) + lead).alias("start"),
                    own.alias("value"),
                    F.concat(F.right(gap[k], F.lit(NEAR)), F.left(hit, lead)).alias("before"),
                    F.left(gap[k + 1], F.lit(NEAR)).alias("after"),
                )

            return F.transform(hits, one)

        return let(sums_before(sizes), each)

    return let(cut, found)


def dictionary(rows: DataFrame) -> DataFrame:
    """word, docs: lower-cased words that stand by themselves in one of KNOWN_IN documents, of all whole texts."""
    alone = rf"(?<![\p{{L}}0-9_/+=\-])\p{{L}}{{{LETTERS},}}(?![\p{{L}}0-9_/+=\-])"
    told = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(alone), F.lit(0)))).alias("word"))
    return told.groupBy("word").agg(F.count("*").alias("docs")).filter(F.col("docs") * KNOWN_IN >= rows.count())


def letter_pairs(known: DataFrame) -> Column:
    """For each pair of the letters a to z, row by row, the logarithm of its share among the words' pairs: a list of 676 numbers."""
    two = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))
    counts = known.select("docs", F.explode(two).alias("two")).filter(F.col("two").rlike("^[a-z]{2}$")).groupBy("two").agg(F.sum("docs").alias("n")).collect()
    n = {r["two"]: r["n"] for r in counts}
    every = [n.get(a + b, 0) + 1 for a in string.ascii_lowercase for b in string.ascii_lowercase]
    shares = (math.log(x * len(every) / sum(every)) for x in every)
    return F.split(F.lit(" ".join(map(repr, shares))), " ").cast("array<double>")  # one literal in the plan


def naturalness(own: Column, pairs: Column) -> Column:
    """Mean over the pairs of letters in a value; 0 where there are none."""

    def of(low: Column) -> Column:
        code = lambda k: F.ascii(F.substring(low, k, F.lit(1))) - 97
        inside = lambda c: (c >= 0) & (c < 26)
        told = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda k: F.struct(code(k).alias("a"), code(k + 1).alias("b")))
        fine = F.filter(told, lambda t: inside(t["a"]) & inside(t["b"]))
        return let(F.transform(fine, lambda t: F.get(pairs, t["a"] * 26 + t["b"])), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).otherwise(0.0))

    return let(F.lower(own), of)


def covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with `known`: the share of the value's characters in known words. Each different value is looked up once."""
    own = rf"\p{{Lu}}?\p{{Ll}}{{{LETTERS - 1},}}|\p{{Lu}}{{{LETTERS},}}"
    values = found.select("value").distinct()
    parts = values.select("value", F.posexplode(F.regexp_extract_all("value", F.lit(own), F.lit(0))).alias("k", "part"))
    # Lower-cased by the tasks: where Spark broadcasts the parts, the driver works out whatever expression the join's key holds.
    parts = parts.select("value", F.lower("part").alias("low"), F.length("part").alias("n"))
    hits = parts.join(known.select("word"), F.col("low") == F.col("word"))
    sums = hits.groupBy("value").agg(F.sum("n").alias("told"))
    # One more key, always 0, gives the sums a shuffle of their own: a value that many rows share can be split then.
    zero = lambda c: F.pmod(F.xxhash64(c), F.lit(1))
    other = sums.select(F.col("value").alias("of"), "told", zero("value").alias("zero"))
    joined = found.join(other, (F.col("value") == F.col("of")) & (zero("value") == F.col("zero")), "left")
    return joined.withColumn("known", F.coalesce("told", F.lit(0)) / F.greatest(F.length("value"), F.lit(1))).drop("of", "told", "zero")


def sampled(documents: DataFrame, share: int) -> DataFrame:
    return documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) < share)


def features(found: DataFrame, known: DataFrame, pairs: Column) -> DataFrame:
    """found: value, before, after, and others. Adds FEATURES as doubles."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    size = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.translate(v, "".join(KINDS.values()), "".join(k * len(x) for k, x in KINDS.items())), "[^lud]", "o")
    c = F.col("kinds")
    count = lambda what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)
    columns = {
        "length": F.length(v),
        "digits": count("d") / size,
        "uppers": count("u") / size,
        "lowers": count("l") / size,
        "others": count("o") / size,
        **{p: count(p) / size for p in PAIRS},
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / size,
        "natural": naturalness(v, pairs),
        "known": F.col("known"),
        "hexes": v.rlike("^[0-9a-f]+$"),
        "path": F.length(v) - F.length(F.replace(v, F.lit("/"), F.lit(""))),
        "dots": F.length(v) - F.length(F.replace(v, F.lit("."), F.lit(""))),
        "named": before.rlike(rf"(?i)(?:{NAMES})\W{{0,6}}$"),
        "assigned": before.rlike(r"""[=:]\s*["']?$"""),
        "quoted": before.rlike("""["']$"""),
        "prefixed": v.rlike(f"^(?:{PREFIXES})"),
        "harmless": before.rlike(HARMLESS) | v.rlike("(?i)example|changeme|placeholder|your[_-]|xxxx|1234567|dummy"),
        "harmless_after": after.rlike(HARMLESS_AFTER),
    }
    return covered(found, known).withColumn("kinds", kinds).withColumns({k: columns[k].cast("double") for k in FEATURES})


def labelled(documents: DataFrame, share: int) -> DataFrame:
    """value, before, after, label: findings derived from the sample's rows."""
    h = F.col("h")
    b64 = F.base64(F.unhex(h))
    plain = F.regexp_replace(b64, "[+/=]", "")
    word = lambda i: F.coalesce(F.get(F.col("w"), F.lit(i)), F.lit("word"))
    digits = F.regexp_replace(h, "[a-f]", "")
    rows = sampled(documents, share).select(F.sha2(F.concat_ws(" ", "doc_id", "text"), 512).alias("h"), F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0)).alias("w"))
    said, then = F.concat(word(0), F.lit(" "), word(1), F.lit(" ")), F.concat(F.lit(" "), word(5), F.lit(" "), word(6))
    true = [
        ("password=", F.substring(h, 1, 18)),
        ('token = "', F.substring(h, 3, 40)),
        ("secret: ", F.substring(b64, 1, 24)),
        ("api_key=", F.substring(plain, 5, 32)),
        ("pwd: '", F.substring(plain, 9, 12)),
        ("", F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16)))),
        ("", F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 17, 16)))),
        ("key ", F.concat(F.lit("ghp_"), F.substring(plain, 3, 36))),
        ("", F.concat(F.lit("sk_live_"), F.substring(plain, 7, 24))),
        ("access_key=", F.substring(plain, 20, 40)),
        ("", F.regexp_replace(F.substring(F.concat(plain, F.reverse(plain)), 1, 60), "[0-9]", "")),
    ]
    false = [
        ("password=", F.concat(word(0), word(1), F.lit("1"))),
        ("password: ", F.concat(word(2), F.lit("changeme"))),
        ("token = ", F.concat(F.lit("your_"), word(1), F.lit("_here1"))),
        ("token: ", F.concat(word(3), word(4))),
        ("commit ", F.substring(h, 1, 40)),
        ("sha256: ", F.substring(h, 1, 64)),
        ("", F.substring(h, 5, 32)),
        ("", F.concat(word(2), F.lit("-"), word(3), F.lit("-"), F.substring(digits, 1, 4))),
        ("", F.concat(F.lit("src/"), word(0), F.lit("/"), word(1), F.lit("/"), word(2), F.lit("2"))),
        ("tel ", F.substring(digits, 1, 16)),
        ("isbn ", F.concat(F.lit("978-"), F.substring(digits, 2, 12))),
        ("id ", F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 12))),
        ("", F.concat(word(0), F.lower(word(1)), F.lower(word(2)), F.lit("20"))),
        ("https://", F.concat(F.lower(word(3)), F.lit("/"), F.lower(word(4)), F.lit("/"), F.substring(digits, 1, 6))),
        ("", F.concat(F.initcap(word(0)), F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)))),
        ("", F.concat(F.lit("/"), F.initcap(word(4)), F.lit("/"), F.initcap(word(5)), F.lit("/"), F.initcap(word(6)))),
    ]
    later = [("", F.substring(h, 11, 40), " commit of "), ("", F.substring(h, 7, 64), " (sha256 of "), ("", F.substring(plain, 2, 22), " is an example ")]
    told = [(1.0, *x, "") for x in true] + [(0.0, *x, "") for x in false] + [(0.0, *x) for x in later]
    each = [F.struct(v.alias("value"), F.concat(said, F.lit(before)).alias("before"), F.concat(F.lit(after), then).alias("after"), F.lit(y).alias("label")) for y, before, v, after in told]
    return rows.select(F.inline(F.array(*each)))


def fit(documents: DataFrame) -> tuple[RandomForestClassificationModel | None, DataFrame, Column]:
    """The forest, the known words, the pairs of letters. No forest where there are no documents."""
    rows = slim(documents)
    share = int(min(1.0, SAMPLE / max(rows.count(), 1)) * 2**31)
    known = words.checkpointed(dictionary(rows))
    pairs = letter_pairs(known)
    # The forest's jobs read it again and again; their plans are small then, and so are their numbers of tasks: the sample is bounded.
    data = words.checkpointed(assembled(features(labelled(rows, share), known, pairs)).select("label", "features").coalesce(PARTITIONS))
    if data.isEmpty():
        return None, known, pairs
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label")
    return forest.fit(data), known, pairs


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def slim(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, length, kind, score, kept: a row per candidate."""
    model, known, pairs = fit(documents)
    rows = slim(documents)
    # The lookup of words reads them twice; the texts are searched once.
    found = words.checkpointed(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(candidates(F.col("text")))))
    ready = features(found, known, pairs)
    if model is None:
        scored = ready.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(assembled(ready)).withColumn("score", vector_to_array("probability")[1])
    kind = F.when(F.col("prefixed") > 0, "prefix").when(F.col("named") > 0, "assignment").otherwise("string")
    return scored.select("doc_id", "text_hash", "start", F.length("value").alias("length"), kind.alias("kind"), F.round("score", 4).alias("score"), (F.col("score") > KEPT_SCORE).alias("kept"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents' columns with kept findings masked in text, and n_secrets. Null text stays null."""
    spans = findings(documents).filter("kept").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
    own, other = documents.alias("d"), spans.alias("s")
    text = F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    joined = own.join(other, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(text) == F.col("s.text_hash")), "left")

    def masked(x: Column) -> Column:
        """What stands before each span, and the mask; then what follows the last."""
        end = lambda k: F.when(k > 0, F.get(x, k - 1)["start"] + F.get(x, k - 1)["length"]).otherwise(0)
        before = F.transform(x, lambda s, k: F.concat(F.substring(F.col("d.text"), end(k) + 1, s["start"] - end(k)), F.lit(MASK)))
        return F.concat(F.array_join(before, ""), F.substring(F.col("d.text"), end(F.size(x)) + 1, F.length("d.text")))

    clean = F.when(F.col("s.spans").isNull(), F.col("d.text")).otherwise(let(F.col("s.spans"), masked))
    columns = [clean.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in documents.columns]
    return joined.select(*columns, F.coalesce(F.size("s.spans"), F.lit(0)).alias("n_secrets"))
