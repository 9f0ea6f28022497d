"""Chat formatting in budgeted windows.

The turns of a conversation, in order of turn, role and text, are cut into windows of BUDGET tokens. Prefix sums of the
turns' tokens choose where a window ends, always between turns; a turn over the budget has a window of its own, whole. Every
window after the first repeats the conversation's first system turn and up to HISTORY turns (HISTORY_TOKENS at most) before
it. Only the assistant's new turns are under the loss mask, so each is a target once.

Control strings in roles and texts are broken by a backslash behind their first character, backslashes are doubled, and a
newline in a role gets a backslash before it; removing each escaping backslash gives the text back.

A long conversation is dealt over tasks in blocks of BLOCK turn numbers; a block starts a new window, and gets the system
turn and the history from before. Rows stream through a task in order, with one window in memory.

Defined cases: null role or text is empty, null turn numbers come first, null conv_id is a conversation of its own; equal
turns are kept in order of role and text, repeated rows too; a conversation without an assistant has an empty mask; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

BUDGET, HISTORY, HISTORY_TOKENS = 1_024, 2, 256
BLOCK = 256
#: The block of turns without a number, before all others.
FIRST = -(1 << 60)
TURN, END = "<|turn|>", "<|end|>"
CONTROLS = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
BROKEN = re.compile("|".join(re.escape(c) for c in CONTROLS))
ESCAPED = re.compile(r"\\(.)", re.S)
ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
SYSTEM, CARRIED, OWN = 0, 1, 2


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return BROKEN.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def tokens(text: str) -> int:
    """An estimate: four characters each, and four for the turn's marks."""
    return len(text) // 4 + 5


def formatted(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[int], list[int]]:
    """Text of a window, and where its masked-in parts start and end. The first `repeated` turns are no targets."""
    parts, size, start, end = [], 0, [], []
    for i, (role, text) in enumerate(turns):
        head = f"{TURN}{escape(role).replace('\n', '\\\n')}\n"
        body = escape(text)
        parts += [head, body, f"{END}\n"]
        if role == "assistant" and i >= repeated:
            start.append(size + len(head))
            end.append(size + len(head) + len(body))
        size += len(head) + len(body) + len(END) + 1
    return "".join(parts), start, end


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a window."""
    out = []
    for part in text.split(f"{END}\n")[:-1]:
        m = ROLE.match(part, len(TURN))
        out.append((unescape(m[1].replace("\\\n", "\n")), unescape(part[m.end() :])))
    return out


class Block:
    """Windows of one block, from its rows in order."""

    def __init__(self, key: tuple):
        self.key, self.number = key, 0
        self.system: tuple[str, str] | None = None
        self.history: list[tuple[str, str]] = []
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]

    def add(self, kind: int, role: str, text: str) -> Iterator[tuple]:
        if kind == SYSTEM:
            self.system = role, text
        elif kind == CARRIED:
            self.history.append((role, text))
        else:
            if not self.turns and not self.number:
                self.history = self.limited(self.history)
            self.turns.append((role, text))
            self.sums.append(self.sums[-1] + tokens(text))
            while self.sums[-1] > self.room() and len(self.turns) > 1:
                yield self.window(max(bisect_right(self.sums, self.room()) - 1, 1))

    def repeats(self) -> list[tuple[str, str]]:
        return [*([self.system] if self.system else []), *self.history]

    def room(self) -> int:
        return max(BUDGET - sum(tokens(t) for _, t in self.repeats()), 0)

    def limited(self, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
        kept, size = [], 0
        for turn in reversed(turns[-HISTORY:]):
            size += tokens(turn[1])
            if size > HISTORY_TOKENS or turn == self.system:
                break
            kept.append(turn)
        return kept[::-1]

    def window(self, n: int) -> tuple:
        """Takes the first n turns."""
        repeats, own = self.repeats(), self.turns[:n]
        text, start, end = formatted(repeats + own, len(repeats))
        out = (*self.key, self.number, len(repeats), len(own), text, start, end)
        if self.system is None:  # no block before has one
            self.system = next((t for t in own if t[0] == "system"), None)
        self.history = self.limited(self.history + own)
        self.turns, self.number = self.turns[n:], self.number + 1
        self.sums = [0]
        for _, t in self.turns:
            self.sums.append(self.sums[-1] + tokens(t))
        return out


NAMES = ["conv_id", "block", "window", "n_repeated", "n_turns", "text", "loss_from", "loss_to"]


def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, block, kind, turn, role, text."""
    now: Block | None = None
    for batch in batches:
        out, kind_of = [], batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            key = row["conv_id"], row["block"]
            if now is None or now.key != key:
                if now is not None and now.turns:
                    out.append(now.window(len(now.turns)))
                now = Block(key)
            out += now.add(row["kind"], row["role"], row["text"])
        yield as_batch(out, kind_of)
    if now is not None and now.turns:
        yield as_batch([now.window(len(now.turns))], kind_of)


def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], NAMES)


def windows(conversations: DataFrame) -> DataFrame:
    """conv_id, block, window (order), n_repeated (leading turns), n_turns (new ones), text, loss_from, loss_to (code points)."""
    words.ship(conversations.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(FIRST)).cast("long")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role"), plain("text")).withColumn("block", block)
    near = F.pmod("turn", F.lit(BLOCK)) >= BLOCK - HISTORY
    here = F.struct(F.col("block"), F.lit(OWN).alias("kind"))
    next_ = F.struct((F.col("block") + 1).alias("block"), F.lit(CARRIED).alias("kind"))
    dealt = rows.select("conv_id", "turn", "role", "text", F.inline(F.when(near, F.array(here, next_)).otherwise(F.array(here))))
    later = rows.select("conv_id", "block").distinct()
    first = rows.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "text", "block")).alias("first"))
    systems = later.alias("l").join(first.alias("f"), F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.block") > F.col("first.block")))
    systems = systems.select("l.conv_id", F.col("first.turn").alias("turn"), F.lit("system").alias("role"), F.col("first.text").alias("text"), "l.block", F.lit(SYSTEM).alias("kind"))
    every = dealt.unionByName(systems).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return every.mapInArrow(windowed, f"conv_id {kind}, block bigint, window bigint, n_repeated bigint, n_turns bigint, text string, loss_from array<bigint>, loss_to array<bigint>")


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, block, window: digests of the conversation as the windows have it."""
    key, started, n, chars, loss_chars = None, False, 0, 0, 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def row(kind: pa.DataType) -> pa.RecordBatch:
        values = [key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for r in batch.to_pylist():
            if not started or r["conv_id"] != key:
                if started:
                    done.append(row(kind))
                key, started, n, chars, loss_chars = r["conv_id"], True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in parsed(r["text"])[r["n_repeated"] :]:
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            for a, b in zip(r["loss_from"], r["loss_to"], strict=True):
                target = unescape(r["text"][a:b])
                loss.update(target.encode())
                loss_chars += len(target)
            chars += len(r["text"])
        yield from done
    if started:
        yield row(kind)


def digests(formatted_windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: a row per conversation, read from its
    windows. A digest of a whole conversation is one sequence, so its windows stream through one task, one at a time."""
    kind = formatted_windows.schema["conv_id"].dataType.simpleString()
    rows = formatted_windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return rows.mapInArrow(read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
