"""Benchmark decontamination by a broadcast set of n-gram hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from pathloom.llm.common import free_name, saved, slices, tidy, utf8

#: A-Z to a-z; digits, a-z and bytes above ASCII stay; everything else becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
BASE = np.uint64(0x9E3779B97F4A7C15)
HIT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words: maximal runs of ASCII letters, digits and characters above ASCII."""
    return utf8(text).translate(WORD_BYTES).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * BASE + ids[k : len(ids) - n + 1 + k]
    return out


class GramSet:
    """Distinct word windows, their hashes, and the items each one comes from."""

    def __init__(self, grams: list[tuple[bytes, list[str]]]) -> None:
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], list[str]]]] = {}
        for gram, items in grams:
            words = gram.split(b" ")
            numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            by_length.setdefault(len(words), []).append((numbers, items))
        self.tables = []
        for n, rows in sorted(by_length.items()):
            numbers = np.array([r[0] for r in rows], np.uint64)
            hashes = np.concatenate([rolling(x, n) for x in numbers])
            order = np.argsort(hashes, kind="stable")
            self.tables.append((n, hashes[order], numbers[order], [rows[i][1] for i in order]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence, and the items that occur.

        Windows are looked up by hash; a hit counts only if its word numbers are equal too.
        """
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        covered = np.zeros(len(ids) + 1, np.int64)
        found: set[str] = set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes, numbers, items in self.tables:
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            hashed = rolling(ids, n)[starts]
            place = np.searchsorted(hashes, hashed)
            inside = place < len(hashes)
            starts, hashed, place = starts[inside], hashed[inside], place[inside]
            live = hashes[place] == hashed
            starts, hashed, place = starts[live], hashed[live], place[live]
            while len(starts):  # more than one round only where two windows share a hash
                equal = (ids[starts[:, None] + np.arange(n)] == numbers[place]).all(axis=1)
                np.add.at(covered, starts[equal], 1)
                np.add.at(covered, starts[equal] + n, -1)
                for p in set(place[equal].tolist()):
                    found.update(items[p])
                place = place + 1
                inside = place < len(hashes)
                inside[inside] = hashes[place[inside]] == hashed[inside]
                starts, hashed, place = starts[inside], hashed[inside], place[inside]
        return np.cumsum(covered)[:-1] > 0, found


def runs(mask: np.ndarray) -> list[list[int]]:
    """[start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def benchmark_grams(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: ``gram``, ``items`` (ids as strings, null ids left out)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                words = words_of(text)
                size = min(n, len(words))
                rows += [(item, b" ".join(words[i : i + size])) for i in range(len(words) - size + 1) if size]
            yield pd.DataFrame(rows, columns=["item", "gram"]).astype({"item": object, "gram": object})

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.mapInPandas(cut, "item string, gram binary").groupBy("gram").agg(F.collect_set("item").alias("items"))


def _scanner(held: Broadcast):
    """Hits of the held windows, added to the spans and items that were found before."""

    @F.pandas_udf(HIT)
    @tidy
    def scan(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        grams = held.value
        for texts, spans, items in parts:
            results = []
            for text, before, known in zip(texts, spans, items):
                words = words_of(text)
                mask, found = grams.scan(words)
                for a, b in before if before is not None else ():
                    mask[a:b] = True
                found.update(known if known is not None else ())
                results.append((len(words), int(mask.sum()), sorted(found), runs(mask)))
            yield pd.DataFrame(results, columns=["n_words", "n_hit", "item_ids", "spans"])

    return scan


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    block_grams: int = 1_000_000,
    out_col: str = "contamination",
) -> DataFrame:
    """Add a struct ``out_col`` (n_words, n_hit, item_ids, spans) to each row of ``docs``.

    A window is ``n`` consecutive normalised words of an item, or all of them if it has
    fewer; an item without words has none. A word inside any occurrence of a window is hit;
    ``spans`` are the maximal runs of hit words as [start, end) word numbers, and
    ``item_ids`` the sorted ids (as strings) of all items with an occurring window.

    The windows are broadcast in blocks of about ``block_grams`` by hash, so what is sent is
    bounded whatever the benchmark's size; each further block is one more scan, whose input
    the one before has written to the shared folder. Nothing is shuffled on the document side.

    Nulls: a null text has no words; a null item id marks words but is not listed. Repeated
    documents are judged row by row, repeated items are one set of windows. An empty
    benchmark hits nothing. All columns are kept; a column named ``out_col`` is
    replaced.
    """
    grams = benchmark_grams(benchmark, n, item_col, benchmark_text_col)
    grams = saved(grams, "grams")
    blocks = max(1, -(-grams.count() // block_grams))
    columns = [c for c in docs.columns if c.lower() != out_col.lower()]
    out = docs.select(*columns, F.lit(None).cast(HIT).alias(out_col))
    spark = docs.sparkSession
    for block in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        # At most about block_grams rows by construction: the blocks are cut by hash.
        rows = [(bytes(r.gram), list(r["items"])) for r in part.collect()]
        held = spark.sparkContext.broadcast(GramSet(rows))
        if block:
            out = saved(out, "decontaminate")

        found = _scanner(held)(F.col(text_col).cast("string"), f"{out_col}.spans", f"{out_col}.item_ids")
        out = out.withColumn(out_col, found)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", share: int = 20, text_col: str = "text", **options
) -> DataFrame:
    """Remove contaminated documents, or the hit spans of every document.

    With ``remove="documents"`` a row goes if it has a hit and ``share * n_hit >= n_words``;
    all other rows keep their text. With ``"spans"`` every row stays and its text loses the
    characters from the first to the last word of each span, which become one space.
    Columns are those of ``docs``. Null texts stay null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    mark = free_name(docs, "contamination")
    found = find_contamination(docs, benchmark, text_col=text_col, out_col=mark, **options)
    hit = F.col(f"{mark}.n_hit")
    if remove == "documents":
        return found.where(~((hit > 0) & (hit * share >= F.col(f"{mark}.n_words")))).select(*docs.columns)
    word = re.compile(rb"[^ ]+")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, drop in zip(text, spans):
            if value is None or drop is None or not len(drop):
                out.append(value)
                continue
            raw = utf8(value)
            at = [m.span() for m in word.finditer(raw.translate(WORD_BYTES))]
            kept, last = [], 0
            for a, b in drop:
                kept.append(raw[last : at[a][0]])
                last = at[b - 1][1]
            out.append(b" ".join([x.strip() for x in kept] + [raw[last:].strip()]).strip().decode())
        return pd.Series(out, dtype=object)

    cleaned = F.when(hit > 0, cut(F.col(text_col), F.col(f"{mark}.spans"))).otherwise(F.col(text_col))
    return found.withColumn(text_col, cleaned).select(*docs.columns)
