"""Grouping spelling variants: vocabulary acceptor, one-edit transducer and acceptor composed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import by_key, saved
from pathloom.operators.joins import lookup_join

#: Words of a partition of the composition; a larger one is split by more symbols.
GROUP = 4096
RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, typo_every: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal letter runs of all whole texts, A-Z in lower case, by number of occurrences.

    ``typo_every`` plants errors: where it divides the CRC-32 of ``<key>:<run>``, the run loses the code
    point at that number modulo its length. Words below ``least_length`` code points or ``least``
    occurrences go. Counts combine before the shuffle, so a word that is everywhere is one row per task.
    Null and empty texts have no words, a null key counts as the empty text, repeated rows count again.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), run.alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if typo_every:
        h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % typo_every == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ------------------------------------------------------------------ automata


class Acceptor:
    """Minimal acyclic acceptors that share states: equal right languages are one state.

    ``arcs[state]`` maps symbols to states.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._shared: dict[tuple[int, int], tuple[str, ...]] = {}

    def add(self, words: list[str], depth: int = 0, low: int = 0, high: int | None = None) -> int:
        """The initial state of the acceptor of a sorted list of different words."""
        high = len(words) if high is None else high
        final = low < high and len(words[low]) == depth
        arcs: dict[str, int] = {}
        start = low + final
        while start < high:
            symbol, end = words[start][depth], start + 1
            while end < high and words[end][depth] == symbol:
                end += 1
            arcs[symbol] = self.add(words, depth + 1, start, end)
            start = end
        signature = (final, *arcs.items())
        state = self._known.get(signature)
        if state is None:
            state = self._known[signature] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def shared(self, p: int, q: int) -> tuple[str, ...]:
        """The words that both states accept."""
        key = (p, q) if p <= q else (q, p)
        found = self._shared.get(key)
        if found is None:
            first, second = self.arcs[p], self.arcs[q]
            out = [""] if self.final[p] and self.final[q] else []
            for symbol in first.keys() & second.keys():
                out += [symbol + rest for rest in self.shared(first[symbol], second[symbol])]
            found = self._shared[key] = tuple(out)
        return found

    def replacements(self, p: int, before: str = "") -> Iterator[tuple[str, str]]:
        """Pairs of words of one acceptor that differ in one symbol, each pair once.

        Up to the edit both sides of the composition are in the same state.
        """
        arcs = list(self.arcs[p].items())
        for i, (c, below) in enumerate(arcs):
            for d, other in arcs[i + 1 :]:
                for rest in self.shared(below, other):
                    yield before + c + rest, before + d + rest
            yield from self.replacements(below, before + c)

    def insertions(self, p: int, q: int, before: str = "") -> Iterator[tuple[str, str]]:
        """Pairs (word of p, word of q) where the second has one symbol more, each pair once.

        Of the places where a symbol may be inserted into a run of itself the last one counts.
        """
        shorter, longer = self.arcs[p], self.arcs[q]
        for d, below in longer.items():
            for rest in self.shared(p, below):
                if rest[:1] != d:
                    yield before + rest, before + d + rest
        for c in shorter.keys() & longer.keys():
            yield from self.insertions(shorter[c], longer[c], before + c)


# ------------------------------------------------------------------ partitions


def _split(rows: DataFrame) -> DataFrame:
    """Each row with one more half of its middle fixed: by the first half (P) and by the second (S).

    A pair has ``short`` symbols on its shorter side, of which the middle, all but ``head`` and
    ``tail``, has ``r``. Of two words one edit apart either the first ``r // 2`` symbols of the middle
    are equal, or the edit is there and the last ``r - r // 2`` are.
    """
    free = F.col("short") - F.length("head") - F.length("tail")
    first, second = F.floor(free / 2).cast("int"), (free - F.floor(free / 2)).cast("int")
    at = F.length("head") + 1
    last = F.length("word") - F.length("tail") - second + 1
    ways = F.array(
        F.struct(
            F.concat("path", F.lit("P")).alias("path"),
            F.concat("head", F.substring("word", at, first)).alias("head"), F.col("tail").alias("tail"),
        ),
        F.struct(
            F.concat("path", F.lit("S")).alias("path"),
            F.col("head").alias("head"), F.concat(F.substring("word", last, second), "tail").alias("tail"),
        ),
    )
    return rows.select("word", "n", "short", F.explode(ways).alias("way")).select("word", "n", "short", "way.path", "way.head", "way.tail")


def _told_apart(short: int, path: str) -> list[tuple[int, int]]:
    """(start, end) of first halves in which a pair of this partition has to differ, else another one has it."""
    head = tail = 0
    out = []
    for step in path:
        free = short - head - tail
        if step == "P":
            head += free // 2
        else:
            out.append((head, head + free // 2))
            tail += free - free // 2
    return out


KEY = ["short", "path", "head", "tail"]
PAIRS = "word string, near string, near_n long"


def _compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Both directions of all pairs one edit apart, partition by partition of the composition."""
    for frame in by_key(frames, "part"):
        parts = frame["part"].to_numpy()
        same = parts[1:] == parts[:-1]
        several = np.zeros(len(parts), bool)
        several[1:] |= same
        several[:-1] |= same
        frame = frame[several]
        if not len(frame):
            continue
        machine = Acceptor()
        out: list[tuple[str, str, int]] = []
        bounds = np.flatnonzero(frame["part"].to_numpy()[1:] != frame["part"].to_numpy()[:-1]) + 1
        words, counts = frame["word"].tolist(), frame["n"].tolist()
        shorts, paths, heads, tails = (frame[c].tolist() for c in KEY)
        for low, high in zip([0, *bounds.tolist()], [*bounds.tolist(), len(words)]):
            short, head, tail = shorts[low], heads[low], tails[low]
            n = dict(zip(words[low:high], counts[low:high]))
            a, b = len(head), len(tail)
            of_length: tuple[list[str], list[str]] = ([], [])
            for word in sorted(n):
                of_length[len(word) - short].append(word[a : len(word) - b])
            # Sorted words that share head and length stay sorted without them.
            roots = [machine.add(middle) if middle else None for middle in of_length]
            if roots[0] is None:
                continue
            found = list(machine.replacements(roots[0]))
            if roots[1] is not None:
                found += machine.insertions(roots[0], roots[1])
            apart = _told_apart(short, paths[low])
            for first, second in found:
                first, second = head + first + tail, head + second + tail
                if all(first[x:y] != second[x:y] for x, y in apart):
                    out.append((first, second, n[second]))
                    out.append((second, first, n[first]))
        if out:
            yield pd.DataFrame(out, columns=["word", "near", "near_n"])


def near_pairs(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of (word, n) rows that are one inserted, deleted or replaced code point apart.

    Words are unique, and of two code points at least. The composed machine is partitioned by what leaves
    its initial state: the first half of a word, and for edits within that the last half. A word is in four
    partitions. One of more than ``group`` words is counted before anything is shuffled and split by more
    symbols, down to a single free one; each partition then is an acceptor of its own. No pair is lost and
    none is found twice. An empty vocabulary gives no pairs.
    """
    length = F.length("word")
    shorter = F.filter(F.array(length, length - 1), lambda s: s >= 2)
    empty = F.lit("")
    rows = vocabulary.select("word", "n", F.explode(shorter).alias("short"), empty.alias("path"), empty.alias("head"), empty.alias("tail"))
    found = None
    while True:
        rows = saved(_split(rows), "partitions")
        splits = F.col("short") - F.length("head") - F.length("tail") > 1
        large = saved(rows.where(splits).groupBy(*KEY).count().where(F.col("count") > group).select(*KEY), "large")
        last = large.isEmpty()
        small = rows if last else lookup_join(rows, large, KEY, "left_anti")
        part = F.concat("short", "path", F.length("head"), F.lit(":"), "head", "tail", F.lit(".")).alias("part")
        dealt = small.select(part, "word", "n", *KEY).repartition("part").sortWithinPartitions("part")
        pairs = dealt.mapInPandas(_compose, PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        rows = lookup_join(rows, large, KEY, "left_semi")


def group_variants(vocabulary: DataFrame, ratio: int = 5, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of a vocabulary (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (of equal ones the
    first in code-point order) if it is at least ``ratio`` times as frequent, else null, with ``form_n`` its
    count. ``root`` is where forms lead, the word itself without a form. Counts grow by ``ratio`` along the way, so
    links have no cycle, and the rounds that double the links grow with the logarithm of a logarithm of the highest count.
    """
    vocabulary = saved(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(vocabulary, group).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.less") >= F.col("n") * ratio
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    words = saved(words, "words")
    links = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = saved(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    out = words.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
