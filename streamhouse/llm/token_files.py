"""Token ids in raw shards, found by document key through a minimal perfect hash index.

A store is a folder:

- `ids-*.bin`: ids of consecutive documents, nothing else, little-endian, two bytes each where the vocabulary allows, else four.
  Documents stand in ascending order of their key (null first), then of a hash of their text; each ends with `end_id`.
- `index-*.mph`: the index of one part of the keys (those whose hash has one remainder): a minimal perfect hash function by
  levels of bits, then a slot per key: fingerprint, shard, first id's place in it, number of ids. A key's slot is found in
  constant time; a key that the store has not is refused but for one in 2**32.
- `shards`, `parts`, `keys`, `format`: tables in parquet: files of the shards and their first id's place among all ids, files
  of the index, keys, and width, end id and number of parts.

A key is the document's id and, where ids repeat, its number among the rows of that id (`copy`, from 0).

Tasks hold one part of the index (about PART_KEYS keys), SLICE_BYTES of text and ids, or one text, and ids of up to KEPT words; words
are told apart by hashes of 64 bits. The driver holds a row per
shard and per writing task. Files get a name of their own in each attempt, and only names that Spark has committed are in
the tables, so a task that is repeated leaves a file that nobody reads.

Defined cases: null text is empty, and an empty text has its end id only; a null id is a key like others; repeated ids and
rows each get their own row; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamhouse.llm import words

SHARD_BYTES = 64 << 20
SLICE_BYTES = 2 << 20
PART_KEYS = 1 << 16
KEPT, RECENT = 1_000_000, 100_000
#: Of an Arrow batch of texts.
BATCH_ROWS = 1000
SHARDS_PER_TASK = 1 << 24
#: Of Spark's hashes.
SEED = 42
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<i8"), ("at", "<i8"), ("n", "<i8")])
#: White space of Unicode.
SPACE = "\t-\r \x85\xa0  -     　"
#: Where a space does not begin a word's chunk, or the white space before it is not a chunk of its own.
SPACED_TWICE = re.compile(f"[{SPACE}] ")
#: The byte-level pre-tokeniser cuts at each place where this does, and at others within.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The byte-level pre-tokeniser's pattern, and the bytes that stand for themselves in its alphabet.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that are a word of their own behind letters.
MARKS = ".,;:!?"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def alphabet() -> dict[int, int]:
    """Latin-1 characters to those of the byte-level alphabet."""
    others = [b for b in range(256) if b not in set(PRINTED)]
    return {b: b for b in PRINTED} | {b: 256 + k for k, b in enumerate(others)}


class Vocabulary:
    """Ids of words by the words' hashes of 64 bits: an old and a recent list, each in order of hash, and all ids in one array.

    About 30 bytes a word; with KEPT words it starts anew.
    """

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.flat = np.zeros(0, self.kind)
        self.old = self.recent = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each begin, and how many; none: 0."""
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, places_, sizes in (self.old, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                begin[hit], size[hit] = places_[at[hit]], sizes[at[hit]]
        return begin, size

    def add(self, h: np.ndarray, ids: list[array]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in ids], np.int32)
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), self.kind)])
        self.recent = self.merged(self.recent, (h, begin, size))
        if len(self.recent[0]) > RECENT:
            self.old, self.recent = self.merged(self.old, self.recent), tuple(x[:0] for x in self.recent)
        return begin, size

    @staticmethod
    def merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        by = np.argsort(both[0], kind="stable")
        return tuple(x[by] for x in both)


class Encoder:
    """Ids of texts. A word is what follows a space, up to the next; it is encoded with its space, and then known for later texts."""

    def __init__(self, model: str, width: int, added: list[str], by_chunks: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.alphabet = Tokenizer.from_str(model), "H" if width == 2 else "I", alphabet()
        self.tokenize, self.added, self.by_chunks = self.tokenizer.model.tokenize, added, by_chunks
        self.known = Vocabulary(self.kind)
        self.marks = {m: self.of(m) for m in MARKS}

    def word(self, after: str) -> array:
        if after.isalpha():
            own = f"Ġ{after}" if after.isascii() else f" {after}".encode().decode("latin-1").translate(self.alphabet)
            return array(self.kind, [t.id for t in self.tokenize(own)])
        if after[-1:] in self.marks and after[:-1].isalpha():
            return self.word(after[:-1]) + self.marks[after[-1]]
        return self.of(f" {after}")

    def of(self, text: str) -> array:
        """Word by word of the pre-tokeniser; no added token is in the text."""
        ids = array(self.kind)
        for c in CHUNK.findall(text):
            for word in WORD.findall(c):
                ids.extend([t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
        return ids

    def whole(self, text: str) -> array:
        """What the tokenizer's encode(text, add_special_tokens=False) gives."""
        if self.by_chunks and not any(a in text for a in self.added):
            return self.of(text)
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids)

    def many(self, texts: list[str], end: int) -> list[memoryview]:
        """Of each text: its ids as whole() has them, then `end`. Each different word of the texts is looked up once."""
        if len(self.known.old[0]) > KEPT:
            self.known.clear()
        plain = [self.by_chunks and not SPACED_TWICE.search(t) and not any(a in t for a in self.added) for t in texts]
        pieces = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()), " ")
        starts = pieces.offsets.to_numpy()
        inner = np.ones(int(starts[-1]), bool)
        inner[starts[:-1]] = False  # a text's first piece has no space
        flat = pieces.flatten()
        heads = flat.take(pa.array(starts[:-1])).to_pylist()
        told = flat.filter(pa.array(inner)).dictionary_encode()
        kinds = told.dictionary
        _, offsets, data = kinds.buffers()
        bounds = np.frombuffer(offsets, np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        h = words.Hasher(raw).spans(bounds[:-1], bounds[1:])
        begin, size = self.known.find(h)
        new = np.flatnonzero(size == 0)
        if len(new):
            begin[new], size[new] = self.known.add(h[new], [self.word(w) for w in kinds.take(pa.array(new)).to_pylist()])
        first = [self.of(x) if p else self.whole(t) for t, p, x in zip(texts, plain, heads, strict=True)]
        # A text is its head, its words, the end.
        n, count = len(texts), np.diff(starts)
        sizes = np.concatenate([size, [len(x) for x in first], [1]])
        own = np.cumsum(sizes[len(kinds) :]) - sizes[len(kinds) :] + len(self.known.flat)
        begins = np.concatenate([begin, own])
        ids = np.concatenate([self.known.flat, np.frombuffer(b"".join(first), self.kind), np.array([end], self.kind)])
        order = np.full(len(inner) + n, len(sizes) - 1, np.int64)
        at = np.repeat(np.arange(n), count) + np.arange(len(inner))
        order[at[inner]] = told.indices.to_numpy()
        order[at[~inner]] = len(kinds) + np.arange(n)
        length = sizes[order]
        reach = np.cumsum(length)
        out = ids[np.arange(int(reach[-1])) + np.repeat(begins[order] - (reach - length), length)]
        cuts = np.concatenate([[0], reach[starts[1:] + np.arange(n)]]) * out.itemsize
        view = memoryview(out.astype(out.dtype.newbyteorder("<"))).cast("B")
        return [view[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def traits(model: str) -> tuple[list[str], bool]:
    """Added tokens of a tokenizer's file, and whether a text's ids are those of its chunks, one after another."""
    told = json.loads(model)
    level = told.get("pre_tokenizer") or {}
    plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
    others = any(told.get(k) for k in ("normalizer", "truncation", "padding"))
    return [t["content"] for t in told["added_tokens"]], bool(plain) and told["model"]["type"] == "BPE" and not others


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(model: str, width: int, added: list[str], by_chunks: bool) -> Encoder:
    """One tokenizer for the worker's next tasks, too."""
    key = zlib.crc32(model.encode()), width
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, width, added, by_chunks)
    return _encoders[key]


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def written(batches: Iterator[pa.RecordBatch], folder: str, model: str, of: tuple[list[str], bool], width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of their keys to shards; a row for each: key, copy (within this task), lead (has the task's first key), shard, file, at, n."""
    files, root = place(folder)
    own, task = encoder(model, width, *of), TaskContext.get().partitionId()
    out, name, size, seq = None, "", 0, -1
    first: list = []
    last, copies = None, 0
    for part, texts in words.slices(batches, limit=SLICE_BYTES):
        rows: list[tuple] = []
        for key, ids in zip(part.column(0).to_pylist(), own.many([t.decode() for t in texts], end_id), strict=True):
            if out is None or size >= SHARD_BYTES:
                if out is not None:
                    out.close()
                seq, size, name = seq + 1, 0, f"ids-{task:06d}-{seq + 1:06d}-{uuid.uuid4().hex}.bin"
                out = files.open_output_stream(f"{root}/{name}")
            out.write(ids)
            first = first or [key]
            copies = copies + 1 if copies and key == last else 1
            last = key
            rows.append((copies - 1, key == first[0], task * SHARDS_PER_TASK + seq, name, size // width, len(ids) // width))
            size += len(ids)
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "copy", "lead", "shard", "file", "at", "n"])
    if out is not None:
        out.close()


# --- minimal perfect hashing


def places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Of the keys (two hashes each) at a level of so many bits."""
    turn = np.uint64(words.BASE * (2 * level + 1) % 2**64)
    return (words.mix(a ^ words.mix(b + turn)) % np.uint64(size)).astype(np.int64)


@dataclass
class Index:
    """Slots of a part's keys. sizes: bits of each level; bits: of all levels; before: set bits before each word of 64."""

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray
    slots: np.ndarray

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where the part has no such key. At each level a key looks at one bit, and few keys see many levels."""
        found, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + places(a[open_], b[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = self.bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[open_[here]] = self.before[word[here]] + np.bitwise_count(below)
            open_ = open_[~here]
            base += size
        known = found >= 0
        known[known] = self.slots["fingerprint"][found[known]] == fingerprint(b[known])
        return np.where(known, found, -1)

    def dump(self) -> bytes:
        head = json.dumps({"sizes": self.sizes, "keys": len(self.slots)}).encode()
        return b"".join((len(head).to_bytes(8, "little"), head, self.bits.astype("<u8").tobytes(), self.before.astype("<i8").tobytes(), self.slots.tobytes()))

    @staticmethod
    def load(data: bytes) -> Index:
        n = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(bytes(data[8:n]))
        many = sum(head["sizes"]) // 64
        bits, before = np.frombuffer(data, "<u8", many, n), np.frombuffer(data, "<i8", many, n + 8 * many)
        return Index(head["sizes"], bits, before, np.frombuffer(data, SLOT, head["keys"], n + 16 * many))


def fingerprint(b: np.ndarray) -> np.ndarray:
    return (b >> np.uint64(32)).astype(np.uint32)


def index(a: np.ndarray, b: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> Index:
    """Level by level, a key takes its bit where no other key of the level wants it; the others go on. Ranks of bits are slots."""
    open_, base = np.arange(len(a)), 0
    sizes: list[int] = []
    owner, taken = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(open_):
        if len(sizes) >= 200:
            raise ValueError("keys whose hashes of 128 bits are equal")
        size = max(64, -(-2 * len(open_) // 64) * 64)
        want = places(a[open_], b[open_], len(sizes), size)
        single = np.bincount(want, minlength=size)[want] == 1
        owner.append(open_[single])
        taken.append(base + want[single])
        open_ = open_[~single]
        sizes.append(size)
        base += size
    key, bit = np.concatenate(owner), np.concatenate(taken)
    bits = np.zeros(base // 64, np.uint64)
    np.bitwise_or.at(bits, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    key = key[np.argsort(bit)]
    slots = np.empty(len(a), SLOT)
    slots["fingerprint"], slots["shard"], slots["at"], slots["n"] = fingerprint(b[key]), shard[key], at[key], n[key]
    return Index(sizes, bits, before, slots)


def hashes() -> list[Column]:
    """Two hashes of a key; over ids of 64 bits each is one to one for a given copy."""
    return [F.xxhash64("doc_id", "copy").alias("a"), F.xxhash64("copy", "doc_id").alias("b")]


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows in order of part: each part's, at once."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column(batch.schema.get_field_index("part")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if now is not None and part[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(part[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def indexed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = place(folder)
    for part, rows in by_part(batches):
        name = f"index-{part:06d}-{uuid.uuid4().hex}.mph"
        a, b = (column(rows, k).view(np.uint64) for k in "ab")
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(index(a, b, *(column(rows, k) for k in ("shard", "at", "n"))).dump())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([rows.num_rows], pa.int64())], ["part", "file", "n_keys"])


def sought(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Keys in order of part, with the part's file: their shard, place and number of ids. Unknown keys have no row."""
    files, root = place(folder)
    for _, rows in by_part(batches):
        with files.open_input_file(f"{root}/{rows.column('file')[0].as_py()}") as f:
            own = Index.load(f.read())
        slot = own.find(*(column(rows, k).view(np.uint64) for k in "ab"))
        known = np.flatnonzero(slot >= 0)
        told = own.slots[slot[known]]
        out = rows.select(["doc_id", "copy"]).take(pa.array(known))
        for k in ("shard", "at", "n"):
            out = out.append_column(k, pa.array(np.ascontiguousarray(told[k])))
        yield from out.to_batches()


def fetched(batches: Iterator[pa.RecordBatch], folder: str, width: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of shard and place: their ids, four bytes each, or a digest of these bytes. Neighbours are read at once, up to SLICE_BYTES."""
    files, root = place(folder)
    now, f = None, None
    for batch in batches:
        name, at, n = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("file", "at", "n"))
        i = 0
        while i < len(at):
            j = i + 1
            while j < len(at) and name[j] == name[i] and at[j] == at[j - 1] + n[j - 1] and (at[j] + n[j] - at[i]) * width <= SLICE_BYTES:
                j += 1
            if name[i] != now:
                if f is not None:
                    f.close()
                now, f = name[i], files.open_input_file(f"{root}/{name[i]}")
            size = at[j - 1] + n[j - 1] - at[i]
            raw = f.read_at(size * width, at[i] * width)
            ids = memoryview(np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4").tobytes())
            if len(ids) != 4 * size:
                raise ValueError(f"{name[i]} ends before the ids that the index names")
            each = [ids[4 * (a - at[i]) : 4 * (a - at[i] + m)] for a, m in zip(at[i:j], n[i:j], strict=True)]
            own = batch.slice(i, j - i)
            last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
            yield pa.RecordBatch.from_arrays([*(own.column(own.schema.get_field_index(k)) for k in ("doc_id", "copy", "start", "n")), last], ["doc_id", "copy", "start", "n_tokens", "ids_crc32" if digest else "ids"])
            i = j
    if f is not None:
        f.close()


# --- stores


def carried(tasks: list) -> dict[int, int]:
    """By task: how many rows of its first key the tasks before it have."""
    out: dict[int, int] = {}
    key, count = None, 0
    for t in sorted(tasks, key=lambda t: t.task):
        before = count if count and key == t.first else 0
        if before:
            out[t.task] = before
        count = t.last.copy + 1 + (before if t.last.doc_id == t.first else 0)
        key = t.last.doc_id
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows while something runs: they lie in the memory of both Spark and its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode all documents and write a store to a new folder, which all executors share. tokenizer: a file of the tokenizers library."""
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    words.ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    width = 2 if max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    files, root = place(folder)
    files.create_dir(root)
    kind = documents.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "text_hash", "row"]  # the last splits the rows of one key and text between tasks
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = f"doc_id {kind}, copy bigint, lead boolean, shard bigint, file string, at bigint, n bigint"
    with batches_of(spark, BATCH_ROWS):
        entries = words.checkpointed(ranged.mapInArrow(partial(written, folder=folder, model=model, of=traits(model), width=width, end_id=end_id), names))

    shards = entries.groupBy("shard", "file").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids")).collect()
    base, rows = 0, []
    for s in sorted(shards, key=lambda s: s.shard):
        rows.append((s.shard, s.file, s.n_docs, s.n_ids, base))
        base += s.n_ids
    spark.createDataFrame(rows, "shard bigint, file string, n_docs bigint, n_ids bigint, base bigint").coalesce(1).write.parquet(f"{folder}/shards")

    task = F.floor(F.col("shard") / SHARDS_PER_TASK)
    tasks = entries.groupBy(task.alias("task")).agg(F.max(F.when(F.col("lead"), F.struct("doc_id")))["doc_id"].alias("first"), F.max(F.struct("doc_id", "copy")).alias("last"))
    more = carried(tasks.collect())
    if more:
        further = spark.createDataFrame(list(more.items()), "task bigint, before bigint")
        entries = entries.withColumn("task", task).join(further, "task", "left").withColumn("copy", F.col("copy") + F.when(F.col("lead"), F.coalesce("before", F.lit(0))).otherwise(0))
    parts = max(1, -(-sum(r[2] for r in rows) // PART_KEYS))
    own = entries.select(*hashes(), "shard", "at", "n").withColumn("part", F.pmod("a", F.lit(parts)))
    made = own.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(partial(indexed, folder=folder), "part bigint, file string, n_keys bigint")
    made.write.parquet(f"{folder}/parts")
    entries.select("doc_id", "copy").write.parquet(f"{folder}/keys")
    spark.createDataFrame([(width, end_id, parts, kind)], "width int, end_id int, parts bigint, kind string").coalesce(1).write.parquet(f"{folder}/format")


def read(keys: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, copy, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers): a row for each
    key (doc_id and copy) that the store has. With digest, ids_crc32 of these bytes stands for ids."""
    spark = keys.sparkSession
    words.ship(spark)
    told = spark.read.parquet(f"{folder}/format").first()
    kind = spark.read.parquet(f"{folder}/keys").schema["doc_id"].dataType.simpleString()
    parts, shards = spark.read.parquet(f"{folder}/parts").select("part", "file"), spark.read.parquet(f"{folder}/shards")
    asked = keys.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("copy").cast("bigint").alias("copy"))
    asked = asked.select("doc_id", "copy", *hashes()).withColumn("part", F.pmod("a", F.lit(told.parts)))
    dealt = asked.join(parts, "part").repartition("part").sortWithinPartitions("part")
    found = dealt.mapInArrow(partial(sought, folder=folder), f"doc_id {kind}, copy bigint, shard bigint, at bigint, n bigint")
    placed = found.join(shards.select("shard", "file", "base"), "shard").select("doc_id", "copy", "shard", "file", "at", "n", (F.col("base") + F.col("at")).alias("start"))
    ranged = placed.repartition("shard").sortWithinPartitions("shard", "at")
    return ranged.mapInArrow(partial(fetched, folder=folder, width=told.width, digest=digest), f"doc_id {kind}, copy bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids binary'}")


def read_all(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """All documents of a store, each found by its key."""
    return read(spark.read.parquet(f"{folder}/keys"), folder, digest)


@dataclass
class Store:
    """Keyed access without Spark, as a data loader wants it, for ids that are bigint, int or string. A part of the index is read at its first key."""

    folder: str
    kind: str
    count: int
    width: int
    parts: dict[int, str]
    shards: dict[int, str]
    opened: dict[int, Index] = field(default_factory=dict)

    @staticmethod
    def open(folder: str) -> Store:
        import pyarrow.parquet as pq

        files, root = place(folder)
        told, parts, shards = (pq.read_table(f"{root}/{k}", filesystem=files).to_pylist() for k in ("format", "parts", "shards"))
        x = told[0]
        return Store(folder, x["kind"], x["parts"], x["width"], {r["part"]: r["file"] for r in parts}, {r["shard"]: r["file"] for r in shards})

    def hashed(self, doc_id: int | str | None, seed: int) -> int:
        """As hashes() has it: null leaves the seed."""
        if doc_id is None:
            return seed
        raw = doc_id.encode() if isinstance(doc_id, str) else doc_id.to_bytes({"bigint": 8, "int": 4}[self.kind], "little", signed=True)
        return xxhash.xxh64_intdigest(raw, seed)

    def get(self, doc_id: int | str | None, copy: int = 0) -> np.ndarray | None:
        """Ids of a document with its end id; None: not in the store."""
        files, root = place(self.folder)
        number = copy.to_bytes(8, "little")
        a, b = xxhash.xxh64_intdigest(number, self.hashed(doc_id, SEED)), self.hashed(doc_id, xxhash.xxh64_intdigest(number, SEED))
        part = (a - 2**64 if a >> 63 else a) % self.count
        if part not in self.parts:
            return None
        if part not in self.opened:
            with files.open_input_file(f"{root}/{self.parts[part]}") as f:
                self.opened[part] = Index.load(f.read())
        own = self.opened[part]
        slot = own.find(np.array([a], np.uint64), np.array([b], np.uint64))[0]
        if slot < 0:
            return None
        s = own.slots[slot]
        with files.open_input_file(f"{root}/{self.shards[int(s['shard'])]}") as f:
            return np.frombuffer(f.read_at(int(s["n"]) * self.width, int(s["at"]) * self.width), "<u2" if self.width == 2 else "<u4").astype(np.int64)
