"""License scans by ordered signature rules, in built-in functions only.

Rules are regexes over a text's words (lower-cased A-Z, joined by single spaces). A rule runs only where one of its
keywords occurs; each alternative of its regex holds one of them. Where found intervals of words nest, the outer stays; of equal ones that of the smaller priority number.

Defined cases: null text is empty; an empty text has no words, no places and score 0; repeated rows and ids each get their
own row, since nothing is grouped; an empty table gives no rows; other columns are ignored. The scan works within a row,
so no key can be hot; a very long text costs its task time in proportion, and memory of a few times its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases that are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label: keywords, names as regexes over words, SPDX identifiers as words.
LICENSES = {
    "gpl": ("gnu", "gnu general public license|gnu gpl", r"gpl \d \d(?: only| or later)?"),
    "lgpl": ("lesser", "gnu lesser general public license|gnu library or lesser general public license", r"lgpl \d \d(?: only| or later)?"),
    "agpl": ("affero", "(?:gnu )?affero general public license", r"agpl \d \d(?: only| or later)?"),
    "gfdl": ("documentation", "gnu free documentation license", r"gfdl \d \d"),
    "apache": ("apache asl", "apache (?:software )?license|asl", r"apache \d \d"),
    "mit": ("mit", "mit license|mit x11 license", "mit"),
    "expat": ("expat", "expat license", "expat"),
    "bsd": ("bsd", r"(?:simplified |modified |new |revised )?bsd (?:\d clause )?license|bsd \d clause", r"bsd \d clause"),
    "0bsd": ("0bsd zero", "0bsd|zero clause bsd(?: license)?", "0bsd"),
    "cc-by": ("cc creative", "cc by|creative commons attribution", r"cc by \d \d"),
    "cc-by-sa": ("sa creative", "cc by sa|creative commons attribution share ?alike", r"cc by sa \d \d"),
    "cc-by-nd": ("nd creative", "cc by nd|creative commons attribution no ?derivatives", r"cc by nd \d \d"),
    "cc-by-nc": ("nc creative", "cc by nc|creative commons attribution non ?commercial", r"cc by nc \d \d"),
    "cc-by-nc-sa": ("nc", "cc by nc sa", r"cc by nc sa \d \d"),
    "cc-by-nc-nd": ("nc", "cc by nc nd", r"cc by nc nd \d \d"),
    "cc0": ("cc0 creative", r"cc0(?: 1 0)?|creative commons zero", "cc0 1 0"),
    "mpl": ("mozilla", "mozilla public license", r"mpl \d \d"),
    "epl": ("eclipse", "eclipse public license", r"epl \d \d"),
    "edl": ("eclipse", "eclipse distribution license", r"edl \d \d"),
    "cddl": ("cddl distribution", "cddl|common development and distribution license", r"cddl \d \d"),
    "cpl": ("common", "common public license", r"cpl \d \d"),
    "isc": ("isc", "isc license", "isc"),
    "zlib": ("zlib", "zlib license|zlib libpng license", "zlib"),
    "unlicense": ("unlicense", "(?:the )?unlicense", "unlicense"),
    "wtfpl": ("wtfpl want", "wtfpl|do what the f\\S* you want to public license", "wtfpl"),
    "artistic": ("artistic", "artistic license", r"artistic \d \d"),
    "boost": ("boost", "boost software license", r"bsl \d \d"),
    "psf": ("python", "python software foundation license|python license", r"psf \d \d"),
    "postgresql": ("postgresql", "postgresql license", "postgresql"),
    "openssl": ("openssl", "openssl license", "openssl"),
    "ofl": ("font", "(?:sil )?open font license", r"ofl \d \d"),
    "eupl": ("european", "european union public license", r"eupl \d \d"),
    "lppl": ("latex", "latex project public license", r"lppl \d \d\w?"),
    "ms-pl": ("microsoft", "microsoft public license", "ms pl"),
    "ms-rl": ("microsoft", "microsoft reciprocal license", "ms rl"),
    "afl": ("academic", "academic free license", r"afl \d \d"),
    "osl": ("open", "open software license", r"osl \d \d"),
    "cecill": ("cecill", "cecill(?: \\w)? license|cecill", r"cecill \d \d"),
    "ncsa": ("ncsa", "university of illinois ncsa open source license|ncsa license", "ncsa"),
    "w3c": ("w3c", "w3c (?:software )?(?:notice and )?license", "w3c"),
    "php": ("php", "php license", r"php \d \d+"),
    "ruby": ("ruby", "ruby license", "ruby"),
    "busl": ("business", "business source license", r"busl \d \d"),
    "sspl": ("side", "server side public license", r"sspl \d \d"),
    "elastic": ("elastic", "elastic license", r"elastic \d \d"),
    "commons-clause": ("clause", "commons clause(?: license)?", "commons clause"),
    "odbl": ("database", "open database license", r"odbl \d \d"),
    "odc-by": ("attribution", "open data commons attribution license", r"odc by \d \d"),
    "pddl": ("domain", "public domain dedication and license", r"pddl \d \d"),
    "public-domain": ("domain", "(?:in|into|to) the public domain|public domain dedication", "public domain"),
    "proprietary": ("rights", "all rights reserved", "licenseref proprietary"),
}
#: form: priority, weight, regex around the names (or around the identifiers).
FORMS = {
    "identifier": (10, 1.0, "spdx license identifier (?:{ids})"),
    "grant": (20, 0.9, r"(?:licensed|released|distributed|published|available|provided|made available|covered) (?:to you )?(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{names})"),
    "later": (30, 0.9, r"(?:{names}) (?:version |v )?v?\d+(?: \d+)? or (?:\w+ ){{0,3}}later(?: version)?"),
    "versioned": (40, 0.8, r"(?:{names}) (?:version |v )?v?\d+(?: \d+)?"),
    "named": (50, 0.6, "(?:{names})"),
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "first int, before int, priority int, label string, weight double, base boolean, last int"


def rules() -> list[tuple[str, str, int, str, float, bool]]:
    """keywords, regex, priority, label, weight, base."""
    found = [(phrase.split()[0], phrase, 45, label, 0.7, True) for phrase, label in BASE.items()]
    for label, (keywords, names, ids) in LICENSES.items():
        found += [("spdx" if form == "identifier" else keywords, f.format(names=names, ids=ids), priority, label, weight, False) for form, (priority, weight, f) in FORMS.items()]
    return found


def n_words(text: Column) -> Column:
    """Words in either case: lower-casing A-Z changes no border of a word."""
    return F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long")


def normal(text: Column) -> Column:
    """The words, lower-cased, each with a space before and after."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), " "), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def matches(text: Column, rule: Column) -> Column:
    """Intervals of words that a rule's regex matches in normal(text), from left to right."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
    pairs = F.arrays_zip(F.call_function("split", text, pattern, F.lit(-1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{FOUND}>>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + spaces(pair["gap"]) - 1
        end = first + spaces(pair["hit"]) + 1
        hit = F.struct(first.alias("first"), (-end).alias("before"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"), (end - 1).alias("last"))
        return F.when(pair["hit"].isNotNull(), F.struct(end.alias("at"), F.concat(state["found"], F.array(hit)).alias("found"))).otherwise(state)

    return F.aggregate(pairs, start, step)["found"]


def outermost(found: Column) -> Column:
    """Intervals that no other one contains, in order: sorted by start, longer first, then priority."""
    start = F.struct(F.lit(-1).alias("top"), F.array().cast(f"array<struct<{FOUND}>>").alias("kept"))
    keep = lambda s, x: F.when(x["last"] > s["top"], F.struct(x["last"].alias("top"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    return F.aggregate(F.array_sort(found), start, keep)["kept"]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first and last word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = ("keywords", "regex", "priority", "label", "weight", "base")
    table = F.array(*(F.struct(*(F.lit(v.split() if k == "keywords" else v).alias(k) for k, v in zip(names, r, strict=True))) for r in rules()))
    lower = F.lower(text)
    may = F.lit(False)
    for k in ("licen", "spdx", "gpl", "cc", "domain", "rights", "clause", "unlicense", "wtfpl", "0bsd", "asl", "cddl", "cecill", "gnu", "creative", "documentation"):
        may = may | lower.contains(k)  # every name holds one of these
    rows = documents.select("doc_id", n_words(text).alias("n_words"), F.when(may, normal(text)).otherwise(F.lit(" ")).alias("text"))
    due = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.col("text").contains(F.concat(F.lit(" "), k, F.lit(" ")))))
    rows = rows.select("doc_id", "n_words", F.flatten(F.transform(due, lambda r: matches(F.col("text"), r))).alias("found"))
    rows = rows.select("doc_id", "n_words", F.filter("found", lambda x: x["base"]).alias("base"), outermost(F.col("found")).alias("kept"))
    labels = lambda xs: F.transform(xs, lambda x: x["label"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).cast("long").alias("last_word"),
        joined(labels(F.col("base"))).alias("base_labels"),
        joined(F.concat(labels(F.col("base")), labels(F.col("kept")))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: x["weight"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), x["last"].alias("last"))).alias("spans"),
    )
