"""Words of text that is written without spaces, by a lexicon.

Runs of such a script are cut at the fewest unknown characters, then into the fewest pieces, then with the longest last
piece, and so on towards the start. Characters that no word covers stay together as one piece. Everything is a
DataFrame operation: each different run is cut once, the lexicon is a table that is joined with the places of the runs, and a
dynamic programme over the places picks the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = r"\p{IsHan}"
NEVER = 1 << 30


def tokens(text: Column, script: str = HAN) -> Column:
    """Lower-cased runs of letters and digits, in order; where the script begins or ends, so does a run."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{script}+|[\p{{L}}\p{{N}}&&[^{script}]]+"), F.lit(0))


def _spans(runs: DataFrame, longest: int) -> DataFrame:
    """Each place and length within each run, with the text there."""
    n = F.length("run")
    ends = F.explode(F.sequence(F.lit(1), n)).alias("end")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.col("end"), F.lit(longest)))).alias("size")
    placed = runs.select("run", ends).select("run", "end", lengths)
    return placed.select("run", "end", "size", F.substring("run", F.col("end") - F.col("size") + 1, F.col("size")).alias("word"))


def _step(best: Column, at: Column) -> Column:
    """Best segmentations up to a place: one that ends in a word, one that ends in unknown characters.

    ``unknown`` and ``pieces`` are the costs of both; ``size`` is the last word's length; ``opens`` is 1 if the unknown stretch
    begins here.
    """

    def cost(x: Column) -> Column:
        return F.least(
            F.struct(x["unknown"].alias("u"), x["pieces"].alias("p")), F.struct(x["other_unknown"].alias("u"), x["other_pieces"].alias("p"))
        )

    ways = F.transform(
        at["sizes"],
        lambda n: F.struct(cost(best[at["end"] - n])["u"].alias("u"), (cost(best[at["end"] - n])["p"] + 1).alias("p"), (-n).alias("n")),
    )
    word = F.coalesce(F.array_min(ways), F.struct(F.lit(NEVER).alias("u"), F.lit(NEVER).alias("p"), F.lit(0).alias("n")))
    last = best[at["end"] - 1]
    unknown = F.least(
        F.struct((last["other_unknown"] + 1).alias("u"), last["other_pieces"].alias("p"), F.lit(0).alias("o")),
        F.struct((last["unknown"] + 1).alias("u"), (last["pieces"] + 1).alias("p"), F.lit(1).alias("o")),
    )
    return F.struct(
        word["u"].alias("unknown"),
        word["p"].alias("pieces"),
        (-word["n"]).alias("size"),
        unknown["u"].alias("other_unknown"),
        unknown["p"].alias("other_pieces"),
        unknown["o"].alias("opens"),
    )


def _best(places: Column) -> Column:
    start = F.struct(
        F.lit(0).alias("unknown"),
        F.lit(0).alias("pieces"),
        F.lit(0).alias("size"),
        F.lit(NEVER).alias("other_unknown"),
        F.lit(NEVER).alias("other_pieces"),
        F.lit(0).alias("opens"),
    )
    return F.aggregate(places, F.array(start), lambda best, at: F.concat(best, F.array(_step(best, at))))


def _pieces(run: Column, best: Column) -> Column:
    """The pieces of the best segmentation, followed from the end."""

    def in_word(x: Column) -> Column:
        return F.struct(x["unknown"], x["pieces"]) <= F.struct(x["other_unknown"], x["other_pieces"])

    n = F.size(best) - 1
    start = F.struct(
        n.alias("end"),
        in_word(best[n]).alias("word"),
        F.lit(0).alias("held"),
        F.array().cast("array<struct<at:int,size:int>>").alias("out"),
    )

    def back(acc: Column, place: Column) -> Column:
        x = best[place]
        piece = lambda at, size: F.array(F.struct(at.cast("int").alias("at"), size.cast("int").alias("size")))
        before = place - x["size"]
        word = F.struct(
            before.alias("end"),
            in_word(best[before]).alias("word"),
            F.lit(0).alias("held"),
            F.concat(acc["out"], piece(before, x["size"])).alias("out"),
        )
        opened = F.struct(
            (place - 1).alias("end"),
            F.lit(True).alias("word"),
            F.lit(0).alias("held"),
            F.concat(acc["out"], piece(place - 1, acc["held"] + 1)).alias("out"),
        )
        longer = F.struct((place - 1).alias("end"), F.lit(False).alias("word"), (acc["held"] + 1).alias("held"), acc["out"].alias("out"))
        moved = F.when(acc["word"], word).otherwise(F.when(x["opens"] == 1, opened).otherwise(longer))
        return F.when(acc["end"] == place, moved).otherwise(acc)

    found = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), start, back)["out"]
    return F.transform(F.reverse(found), lambda p: F.substring(run, p["at"] + 1, p["size"]))


def segmented(runs: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """``run`` and its ``pieces``, for each different run. ``lexicon`` has a column ``word``; words over ``longest`` are not used."""
    words = lexicon.select(F.lower("word").alias("word")).where(F.length("word").between(1, longest)).distinct()
    spans = _spans(runs.distinct(), longest).join(words.withColumn("known", F.lit(True)), "word", "left")
    by_end = spans.groupBy("run", "end").agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("size")))).alias("sizes"))
    by_run = by_end.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("end", "sizes"))).alias("places"))
    best = by_run.select("run", _best(F.col("places")).alias("best"))
    return best.select("run", _pieces(F.col("run"), F.col("best")).alias("pieces"))


def explode_segments(
    df: DataFrame, text: str, lexicon: DataFrame, keyword: str = "keyword", script: str = HAN, longest: int = 8
) -> DataFrame:
    """One row per word of ``text``, as ``texts.explode_keywords``, with runs of the script cut by a lexicon. Batch only.

    Of the lexicon nothing is collected: it is joined, and broadcast by its size alone. A row of the result is a row of the
    input per piece, repeated words included; rows without a word vanish. Texts are told apart by their content, so each
    different run is cut once.
    """
    exploded = df.select("*", F.explode(tokens(F.col(text), script)).alias("__run"))
    foreign = F.col("__run").rlike(f"^{script}")
    cut = segmented(exploded.where(foreign).select(F.col("__run").alias("run")), lexicon, longest)
    joined = exploded.join(cut.withColumnRenamed("run", "__of"), (F.col("__run") == F.col("__of")) & foreign, "left")
    pieces = F.coalesce(F.col("pieces"), F.array("__run"))
    return joined.select(*df.columns, F.explode(pieces).alias(keyword))
