"""Words of many texts at once: numpy on one byte buffer, inside a task.

Texts are joined by newlines, which no word class holds, so no word crosses texts. A word's hash is a polynomial over its
bytes modulo 2**64, finished by a mixer: equal words have equal hashes, and within a text different words meet with a
probability of about 2**-64 per pair. Memory is proportional to `limit` bytes of text, or to one text where it is longer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker works on at once; its arrays take many times as many.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch, which lies in the memory of both Spark and its Python worker.
BATCH_ROWS = 2_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became a-z: digits, letters, all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n, kept for the next chunk."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + CHUNK_BYTES // 4)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def forget() -> None:
    """Give back what powers() keeps."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of any spans of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


@dataclass
class Chunk:
    data: np.ndarray
    offsets: np.ndarray
    """Where each text starts; one more than texts. A text ends one before the next start."""
    mask: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have the flag."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:] - 1] - total[self.offsets[:-1]]

    def counts(self, keep: np.ndarray | None = None) -> np.ndarray:
        """Words of each text; keep: which of them."""
        return np.bincount(self.doc if keep is None else self.doc[keep], minlength=len(self.offsets) - 1)


def chunk(texts: list[bytes], word: np.ndarray) -> Chunk:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    mask = word[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]  # the last byte is a newline
    return Chunk(data, offsets, mask, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null: empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches with at most `limit` bytes of text, or one row."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        sizes = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column(i)).to_pylist())])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
            part = batch.slice(at, to - at)
            yield part, encoded(part.column(i))
            at = to


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless it is installed there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most so many rows in this session, for results are taken later; never more than it has set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of the driver's only where it names none (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/streamhouse-checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
