"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on two questions: is the text of low quality, and is it toxic.
For each question expectation-maximisation estimates every labeller's vote probabilities given the hidden class, from the
counts of vote patterns over all documents (at most 3**8 and 3**4 patterns, so their table is small by construction). The
posterior labels of a sample then train a linear scorer on hashed words, word beginnings and style marks, which judges all
documents. Where a table of labelled rows is given, its toxicity labels stand for the posterior in the sample: insults that
no word list holds can be learned from them only. Quality is learned without labels.

The training sample is bounded: TRAIN_ROWS documents expected, taken by a hash of id and text. All else uses all data.

Defined cases: null text is empty and of low quality; repeated rows and ids each get the same scores; an empty table gives
no rows; other columns are ignored. Nothing is grouped by source or text, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamhouse.llm import words

TRAIN_ROWS = 16_000
HASHED = 1 << 14
EPOCHS = 8
STEM_BYTES = 4
#: Marks of style per document; they follow its words.
MARKS = 12
ROUNDS = 60
NONE, GOOD, BAD = 0, 1, 2
QUESTIONS = ("quality", "toxicity")
#: Insults, as things and as properties.
INSULTS = (
    "idiot moron loser scum clown trash imbecile fool jerk dumbass dummkopf trottel abschaum versager crétin ordure minable basura imbécil payaso".split(),
    "stupid worthless pathetic disgusting dumb useless ugly idiotic moronic wertlos erbärmlich widerlich pathétique dégoûtant nul estúpido inútil patético asqueroso".split(),
)
#: Frequent words.
COMMON = "the of and to in is that for it was on are as with be by this from at or an a der die und das den von zu mit sich auf für ist im dem nicht ein eine le la les et des en un une du que est pour qui dans par sur de el los las y del se por con su para al lo".split()
QUALITY_LABELLERS, TOXICITY_LABELLERS = 8, 4


def hashes(texts: list[str]) -> np.ndarray:
    c = words.chunk([t.encode() for t in texts], words.ALNUM)
    return np.sort(words.Hasher(c.data).spans(c.starts, c.ends))


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def statistics(texts: list[bytes]) -> tuple[words.Chunk, np.ndarray, dict[str, np.ndarray]]:
    """Words, their hashes (lower case), and figures of each text."""
    c = words.chunk(texts, words.ALNUM)
    h = words.Hasher(words.LOWER[c.data]).spans(c.starts, c.ends)
    n = c.counts()
    per = lambda flags: c.per_doc(flags) / np.maximum(n, 1)
    letters = c.per_doc((words.LOWER[c.data] >= 97) & (words.LOWER[c.data] <= 122))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (c.doc[1:] == c.doc[:-1])
    mixed = h + c.doc.astype(np.uint64) * np.uint64(words.BASE)
    _, first = np.unique(mixed, return_index=True)
    follow = c.data[np.minimum(c.ends, len(c.data) - 1)]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&<>@^~=+\\{}[]_")] = True
    mark = np.zeros(256, bool)
    mark[list(b".,;:?!")] = True
    insults = [c.counts(among(h, hashes(x))) for x in INSULTS]
    every = hashes([w for x in INSULTS for w in x])
    return c, h, {
        "n": n,
        "upper": c.per_doc((c.data >= 65) & (c.data <= 90)) / np.maximum(letters, 1),
        "bangs": per(c.data == ord("!")),
        "symbols": per(symbol[c.data]),
        "pipes": per(c.data == ord("|")),
        "again": c.counts(again) / np.maximum(n, 1),
        "distinct": c.counts(np.isin(np.arange(len(h)), first)) / np.maximum(n, 1),
        "common": c.counts(among(h, hashes(COMMON))) / np.maximum(n, 1),
        "marks": c.counts(mark[follow]) / np.maximum(n, 1),
        "things": insults[0],
        "properties": insults[1],
        "kinds": np.bincount(c.doc[first][among(h[first], every)], minlength=len(texts)),
    }


def votes(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A column per labeller, for each question."""
    n = s["n"]
    vote = lambda good, bad: np.where(bad, BAD, np.where(good, GOOD, NONE))
    quality = [  # six that know one kind of junk each, two that know prose
        vote(False, s["upper"] > 0.4),
        vote(False, s["bangs"] > 0.3),
        vote(False, s["symbols"] > 0.3),
        vote(False, s["pipes"] > 0.2),
        vote(False, s["again"] > 0.12),
        vote(False, (s["distinct"] < 0.12) & (n >= 30)),
        vote((s["common"] > 0.12) & (s["common"] < 0.7) & (s["symbols"] < 0.3) & (s["upper"] < 0.4), (s["common"] < 0.08) & (n >= 20)),
        vote((s["marks"] > 0.02) & (s["marks"] < 0.4) & (s["symbols"] < 0.3), (n < 3) | ((s["marks"] < 0.02) | (s["marks"] > 0.5)) & (n >= 20)),
    ]
    count = s["things"] + s["properties"]
    toxicity = [
        vote(s["things"] == 0, s["things"] > 0),
        vote(s["properties"] == 0, s["properties"] > 0),
        vote(s["kinds"] == 0, s["kinds"] > 1),
        vote(count == 0, count > 0.004 * n),
    ]
    return np.stack(quality, axis=1), np.stack(toxicity, axis=1)


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in words.slices(batches):
        q, t = votes(statistics(texts)[2])
        yield pa.RecordBatch.from_arrays([pa.array(patterns(q)), pa.array(patterns(t))], list(QUESTIONS))


def expectation_maximisation(counts: np.ndarray, labellers: int) -> tuple[np.ndarray, np.ndarray]:
    """counts: documents of each vote pattern. Posterior of the bad class for each pattern, and each labeller's vote
    probabilities by class, labeller and vote. The first guess is the majority of votes."""
    digits = np.arange(3**labellers)[:, None] // 3 ** np.arange(labellers) % 3
    balance = (digits == BAD).sum(1) - (digits == GOOD).sum(1) / 2
    bad = 1 / (1 + np.exp(-2.0 * balance))
    shown = digits[:, :, None] == np.arange(3)
    for _ in range(ROUNDS):
        by = np.stack([1 - bad, bad]) * counts
        chance = np.einsum("cp,plv->clv", by, shown) + 0.5
        chance /= chance.sum(2, keepdims=True)
        prior = (by.sum(1) + 1) / (counts.sum() + 2)
        log = np.einsum("plv,clv->cp", shown, np.log(chance)) + np.log(prior)[:, None]
        bad = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return bad, chance


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """document, hashed feature and value, in order of documents: each word and word beginning once a document, and marks
    of the text's style."""
    c, h, s = statistics(texts)
    hasher = words.Hasher(words.LOWER[c.data])
    stems = ~hasher.spans(c.starts, np.minimum(c.starts + STEM_BYTES, c.ends))
    kind = np.concatenate([h, stems]) % np.uint64(HASHED)
    pairs = np.unique(np.concatenate([c.doc, c.doc]) * HASHED + kind.astype(np.int64))
    of, kind = pairs // HASHED, pairs % HASHED
    value = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=len(texts)), 1))[of]
    steps = {k: np.minimum((s[k] * 20).astype(np.int64), 20) for k in ("upper", "bangs", "symbols", "pipes", "again", "common", "marks")}
    steps |= {k: np.minimum(s[k], 3) for k in ("things", "properties", "kinds")}
    steps["n"] = np.minimum(np.log2(s["n"] + 1).astype(np.int64), 12)
    steps["distinct"] = (s["distinct"] * 10).astype(np.int64) * 16 + steps["n"]
    every = np.arange(len(texts))
    marks = [words.mix(np.uint64(1000 * (i + 1)) + x.astype(np.uint64)) % np.uint64(HASHED) for i, x in enumerate(steps.values())]
    of = np.concatenate([of, *[every] * len(marks)])
    order = np.argsort(of, kind="stable")
    kind = np.concatenate([kind, *(m.astype(np.int64) for m in marks)])[order]
    return of[order], kind, np.concatenate([value, np.ones(len(marks) * len(texts))])[order], s


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches):
        of, kind, value, s = features(texts)
        ends = np.cumsum(np.bincount(of, minlength=part.num_rows))[:-1]
        q, t = (patterns(v) for v in votes(s))
        lists = pa.array([x.tobytes() for x in np.split(kind.astype(np.uint16), ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([lists, pa.array(q), pa.array(t), part.column("toxic")], ["kinds", *QUESTIONS, "toxic"])


def inputs_of(kinds: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a sampled document, as features() has them, and the bias."""
    kinds = np.append(np.frombuffer(kinds, np.uint16).astype(np.int32), HASHED)
    shares = np.ones(len(kinds), np.float32)
    shares[: -MARKS - 1] = 1 / np.sqrt(max(len(kinds) - MARKS - 1, 1))
    return kinds, shares


def train(rows: list, posteriors: list[np.ndarray]) -> np.ndarray:
    """Weights of the two scorers, the last one of each its bias: logistic regression with adaptive steps."""
    weights = np.zeros((2, HASHED + 1))
    for k, (question, posterior) in enumerate(zip(QUESTIONS, posteriors, strict=True)):
        w, seen = weights[k], np.full(HASHED + 1, 1e-6)
        told = [r["toxic"] if question == "toxicity" and r["toxic"] is not None else posterior[r[question]] for r in rows]
        data = [(r["kinds"], y) for r, y in zip(rows, told, strict=True) if abs(y - 0.5) > 0.2]
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(data)):
                (kinds, shares), y = inputs_of(data[i][0]), data[i][1]
                slope = (1 / (1 + np.exp(-np.clip(w[kinds] @ shares, -30, 30))) - y) * shares
                seen[kinds] += slope * slope
                w[kinds] -= 0.3 * slope / np.sqrt(seen[kinds])
    return weights


def scored(weights: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in words.slices(batches):
        of, kind, value, _ = features(texts)
        out = []
        for w in weights:
            z = np.bincount(of, weights=w[kind] * value, minlength=len(texts)) + w[HASHED]
            out.append(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, "low_quality", "toxicity"])


def fit(documents: DataFrame, labels: DataFrame | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights of the scorers, and each question's vote probabilities by class, labeller and vote. labels: doc_id, toxic."""
    words.ship(documents.sparkSession)
    words.small_batches(documents.sparkSession)
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    found = slim.select("text").mapInArrow(voted, "quality bigint, toxicity bigint").groupBy(*QUESTIONS).count().collect()
    total, posteriors, chances = sum(r["count"] for r in found), [], []
    for question, labellers in zip(QUESTIONS, (QUALITY_LABELLERS, TOXICITY_LABELLERS), strict=True):
        counts = np.bincount([r[question] for r in found], weights=[r["count"] for r in found], minlength=3**labellers)
        posterior, chance = expectation_maximisation(counts, labellers)
        posteriors.append(posterior)
        chances.append(chance)
    share = int(min(1.0, TRAIN_ROWS / max(total, 1)) * 2**31)
    rows = slim.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)) < share)
    if labels is None:
        rows = rows.withColumn("toxic", F.lit(None).cast("int"))
    else:
        told = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        rows = rows.join(told, "doc_id", "left")
    schema = "kinds binary, quality bigint, toxicity bigint, toxic int"
    return train(rows.select("text", "toxic").mapInArrow(sampled, schema).collect(), posteriors), chances


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents' columns, low_quality and toxicity (0 to 1); text becomes a string."""
    words.small_batches(documents.sparkSession)
    texts = documents.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(partial(scored, weights), f"{schema}, low_quality double, toxicity double")


def classify(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, low_quality, toxicity, kept (neither is over one half): a row per document."""
    weights, _ = fit(documents, labels)
    judged = score(documents.select("doc_id", "text"), weights)
    return judged.select("doc_id", "low_quality", "toxicity", ((F.col("low_quality") <= 0.5) & (F.col("toxicity") <= 0.5)).alias("kept"))
