"""Main text of web pages: structure of the page, and differences to the page with the nearest URL.

Every page is cut into lines, one for each block of text in page order. Pages are paired with the one before them by URL path
within their host (the first with the one after), the lines of a pair are aligned by their longest common subsequence, and
shared lines are deleted as boilerplate. Lines in elements of page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) go by structure. Lines of an article or main element stay even where the nearest page has
them too: there a shared line is text (copies of a page lie next to each other), and none of it may be lost.

Pairing orders slim keys by range, so a host with a third of all pages is spread over tasks; only each range's last key per
host meets others. Texts are shuffled once, line hashes once.

Defined cases: null html is empty, a page without text gives an empty string; null or unreadable URLs form one host; pages of
equal URL are neighbours in order of id; repeated rows each get a row; an empty table gives no rows; other columns are
ignored. Broken markup: unclosed elements end with their parent, a stray end tag is ignored, an unclosed comment, script or
style reaches to the end, other embedded elements without an end are ignored, a `<` that starts no tag is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamhouse.llm import words

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|textarea|object|math)\b[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
MARKS = re.compile(r"(?:\b(?:class|id|role|aria-label|itemprop))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("head title nav footer aside form menu dialog button select option label fieldset".split())
CONTENT = frozenset(("article", "main"))
#: Words in class, id or role that mark furniture.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side-bar menu navbar nav navigation breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice notices notification alert banner comment comments commentlist respond reply replies disqus discussion"
    " social share sharing related recommended newsletter subscribe subscription signup popup modal overlay widget login search searchbox pagination pager toolbar"
    " complementary contentinfo skip skip-link".split()
)
#: An article with such a mark announces another page; it is text like its surroundings.
TEASERS = frozenset("teaser preview excerpt card post-card article-card article-preview".split())
HEADER_MARKS = frozenset(("header", "site-header", "page-header", "topbar"))


def lines(html: str) -> tuple[list[str], list[int]]:
    """Lines in page order, and of each: 0 furniture, 1 text, 2 text of an article or main element."""
    out, kinds, buffer, stack, at = [], [], [], [], 0
    level = 1

    def flush() -> None:
        if buffer:
            if line := " ".join("".join(buffer).split()):
                out.append(line)
                kinds.append(level)
            buffer.clear()

    for m in TOKEN.finditer(html):
        closing, name, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8]) if m[7] else ("", "", "")
        if m.start() > at:
            piece = html[at : m.start()]
            buffer.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = name.lower()
        if not tag:
            continue
        end, block = closing, tag in BLOCKS
        if tag == "br":
            buffer.append(" ")
            continue
        if block:
            flush()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    level = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in CONTENT and not block:
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            if block:  # a paragraph, item or cell ends where the next block begins
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        level = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            stack.append((tag, level))
            if level:
                marks = {w for g in MARKS.findall(attributes) for w in re.split(r"[\s]+", "".join(g).lower())}
                outside = level == 1 and (tag == "header" or marks & HEADER_MARKS)
                if tag in FURNITURE or outside or tag not in ("html", "body", "main") and marks & MARKED:
                    level = 0
                elif tag in CONTENT and not marks & TEASERS or "main" in marks:
                    level = 2
    piece = html[at:]
    buffer.append(unescape(piece))
    flush()
    return out, kinds


def hashes(found: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63 for line in found]


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b. Bit i of a row: a[: i + 1] has no longer one than a[:i]."""
    both = set(a) & set(b)
    own = [i for i, x in enumerate(a) if x in both]
    left, right = [a[i] for i in own], [x for x in b if x in both]
    bits: dict[int, int] = {}
    for i, x in enumerate(left):
        bits[x] = bits.get(x, 0) | 1 << i
    full = (1 << len(left)) - 1
    rows = [full]
    for x in right:
        u = rows[-1] & bits[x]
        rows.append((rows[-1] + u | rows[-1] - u) & full)
    i, j, found = len(left), len(right), set()
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif left[i - 1] == right[j - 1]:
            found.add(own[i - 1])
            i, j = i - 1, j - 1
        else:
            j -= 1
    return found


def main_text(html: str, other: list[int]) -> tuple[str, int]:
    """The text, and how many lines the nearest page shares."""
    found, kinds = lines(html)
    same = shared(hashes(found), other) if other else set()
    if 2 in kinds:
        kept = [line for line, kind in zip(found, kinds, strict=True) if kind == 2]
    else:
        kept = [line for i, (line, kind) in enumerate(zip(found, kinds, strict=True)) if kind == 1 and i not in same]
    return "\n".join(kept), len(same)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches, "html"):
        found = [hashes(lines(t.decode())[0]) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "hashes"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches, "html"):
        other = part.column(part.schema.get_field_index("other")).to_pylist()
        found, same = zip(*(main_text(t.decode(), o or []) for t, o in zip(texts, other, strict=True)), strict=True)
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(same, pa.int64())], ["page_id", "url", "text", "n_shared"])


def nearest(pages: DataFrame) -> DataFrame:
    """key, other: of each page with another one on its host, the key of the page before it by path, or else after it."""
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.col("url"), F.lit(""))
    keys = pages.select("key", host.alias("host"), path.alias("path"), "page_id").distinct()
    place = ["path", "page_id", "key"]
    ranges = words.checkpointed(keys.repartitionByRange("host", *place).withColumn("part", F.spark_partition_id()))
    lag = F.lag("key").over(Window.partitionBy("part", "host").orderBy(*place))
    inside = ranges.select("key", "part", "host", lag.alias("other"))
    ends = ranges.groupBy("host", "part").agg(F.max_by("key", F.struct(*place)).alias("last"))
    ends = ends.select("host", "part", F.lag("last").over(Window.partitionBy("host").orderBy("part")).alias("last"))
    before = inside.join(ends, ["host", "part"]).select("key", F.coalesce("other", "last").alias("other"))
    after = before.filter("other is not null").groupBy(F.col("other").alias("key")).agg(F.min("key").alias("next"))
    return before.join(after, "key", "left").select("key", F.coalesce("other", "next").alias("other")).filter("other is not null")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared: a row per page."""
    words.ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    found = rows.select("key", "html").mapInArrow(hashed, "key bigint, hashes array<bigint>").dropDuplicates(["key"])
    others = nearest(rows).join(found.select(F.col("key").alias("other"), F.col("hashes").alias("of_other")), "other").select("key", "of_other")
    joined = rows.join(others, "key", "left").select("page_id", "url", "html", F.col("of_other").alias("other"))
    out = joined.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_shared bigint")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
