"""Words of unspaced Han text learned from counts, and texts cut into them by the cheapest path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .joins import lookup_join

LONGEST = 4
# A longer run is read as pieces of this many letters, which bounds a row and its path.
PIECE = 256
PIECES = rf"\p{{IsHan}}{{1,{PIECE}}}"
_NEVER = 1 << 50


def _letters(run: str) -> Column:
    return F.regexp_extract_all(F.col(run), F.lit("(?s)."), F.lit(0))


def _runs(texts: DataFrame, text: str) -> DataFrame:
    """Each distinct run of Han letters with how often it occurs."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))).alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("times"))


def _part(start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice("letters", start, length), "")


def _grams(longest: int) -> Column:
    """All pieces of up to ``longest`` letters of ``letters``, with the letters beside them."""
    size = F.size("letters")

    def at(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)),
            lambda k: F.struct(
                i.alias("start"), k.alias("length"), _part(i, k).alias("word"),
                F.when(i > 1, F.get("letters", i - 2)).otherwise("").alias("before"),
                F.coalesce(F.get("letters", i + k - 1), F.lit("")).alias("after"),
            ),
        )

    return F.flatten(F.transform(F.sequence(F.lit(1), size), at))


def _thousandths(value: Column) -> Column:
    return F.round(value * 1000).cast("long")


def _freedom(counted: DataFrame, side: str) -> DataFrame:
    """Count and branching entropy of each word on one side; the end of a run is one neighbour."""
    each = counted.groupBy("word", side).agg(F.sum("n").alias("c"))
    sums = each.groupBy("word").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return sums.select("word", "n", _thousandths(F.ln("n") - F.col("s") / F.col("n")).alias(f"free_{side}"))


def learn_lexicon(
    texts: DataFrame, text: str, longest: int = LONGEST, least: int = 5, cohesion: int = 1000, freedom: int = 500
) -> DataFrame:
    """``word, n, cohesion, freedom, cost`` from the runs of Han letters of all ``texts``.

    ``n`` counts occurrences, overlapping ones too. ``cohesion`` is the least ln(p(word) / (p(head) p(tail)))
    over all ways to cut the word in two, ``freedom`` the smaller entropy of the letters before and after
    it, ``cost`` is -ln p(word); all in thousandths. Words of two letters and more need the given
    least values; single letters are always in, without a cohesion, as a path needs them. Equal runs are
    counted once and weighted. NULL and empty texts have no runs; no runs, no words.
    """
    runs = _runs(texts, text).select("times", _letters("run").alias("letters"))
    grams = runs.select("times", F.explode(_grams(longest)).alias("g"))
    counted = cut_lineage(grams.groupBy("g.word", "g.before", "g.after").agg(F.sum("times").alias("n")))
    sides = _freedom(counted, "before").join(_freedom(counted, "after").drop("n"), "word")
    words = cut_lineage(sides.select("word", "n", F.least("free_before", "free_after").alias("freedom")))
    letters = words.where(F.char_length("word") == 1).agg(F.sum("n")).scalar().cast("double")

    long = words.where((F.char_length("word") > 1) & (F.col("n") >= least) & (F.col("freedom") >= freedom))
    cuts = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1))
    cut = long.select("word", "n", "freedom", cuts.alias("k")).select(
        "word", "n", "freedom", F.substring(F.col("word"), F.lit(1), F.col("k")).alias("head"),
        F.substring(F.col("word"), F.col("k") + 1, F.lit(longest)).alias("tail"),
    )
    for side in ("head", "tail"):
        cut = lookup_join(cut, words.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}")), side)
    bound = F.ln(F.col("n").cast("double") * letters / (F.col("n_head").cast("double") * F.col("n_tail")))
    held = cut.groupBy("word", "n", "freedom").agg(_thousandths(F.min(bound)).alias("cohesion"))
    single = words.where(F.char_length("word") == 1).withColumn("cohesion", F.lit(None).cast("long"))
    kept = held.where(F.col("cohesion") >= cohesion).unionByName(single)
    return kept.select("word", "n", "cohesion", "freedom", _thousandths(-F.ln(F.col("n") / letters)).alias("cost"))


def _path(longest: int, unknown: Column) -> tuple[Column, Column]:
    """Best steps, to be named ``best``, and from them the words of the cheapest way through ``letters``; ties go to the shorter last word.

    ``costs`` maps 16 * start + length to the cost of a known word. A letter that is
    not known costs ``unknown``.
    """

    def step(best: Column, i: Column) -> Column:
        def ending(k: Column) -> Column:
            known = F.col("costs")[(i - k + 1) * 16 + k]
            price = F.coalesce(known, F.when(k == 1, unknown).otherwise(F.lit(_NEVER)))
            return F.struct((F.get(best, i - k)["cost"] + price).alias("cost"), k.alias("k"))

        ways = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), i)), ending)
        return F.concat(best, F.array(F.array_min(ways)))

    size = F.size("letters")
    start = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("k")))
    best = F.aggregate(F.sequence(F.lit(1), size), start, step)

    def back(state: Column, _: Column) -> Column:
        k = F.get(F.col("best"), state["at"])["k"]
        more = F.concat(F.array(_part(state["at"] - k + 1, k)), state["words"])
        return F.when(state["at"] == 0, state).otherwise(F.struct((state["at"] - k).alias("at"), more.alias("words")))

    end = F.struct(size.alias("at"), F.array().cast("array<string>").alias("words"))
    return best, F.aggregate(F.sequence(F.lit(1), size), end, back)["words"]


def segment(docs: DataFrame, text: str, lexicon: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per run of Han letters of ``docs``: its columns without ``text``, ``run_no`` from 0, and ``words``.

    Every distinct run is cut once, into the words of ``lexicon`` with the least sum of costs. The
    lexicon may have any size: it is met by equality, never copied into a row. A letter that it does not
    have costs as one seen half a time. Texts without Han letters give no rows.
    """
    found = docs.select(
        *[c for c in docs.columns if c != text],
        F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))).alias("run_no", "run"),
    )
    # The checkpoint fixes the numbers.
    runs = cut_lineage(found.select("run").distinct().withColumn("_id", F.monotonically_increasing_id()))
    grams = runs.select("_id", _letters("run").alias("letters")).select("_id", F.explode(_grams(longest)).alias("g"))
    listed = lexicon.select("word", "cost")
    known = lookup_join(grams.select("_id", "g.word", "g.start", "g.length"), listed, "word", spread=F.col("_id"))
    entry = F.struct((F.col("start") * 16 + F.col("length")).alias("place"), "cost")
    costs = known.groupBy("_id").agg(F.map_from_entries(F.collect_list(entry)).alias("costs"))
    total = lexicon.where(F.char_length("word") == 1).agg(F.sum("n")).first()[0] or 1
    unknown = F.lit(round(-1000 * math.log(0.5 / total))).cast("long")
    best, words = _path(longest, unknown)
    cut = runs.join(costs, "_id", "left").withColumn("letters", _letters("run"))
    cut = cut.withColumn("costs", F.coalesce("costs", F.create_map().cast("map<int,bigint>")))
    cut = cut.withColumn("best", best).select("run", words.alias("words"))
    return lookup_join(found, cut, "run").drop("run")
