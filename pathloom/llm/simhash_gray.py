"""SimHash near-duplicates found through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import LOWER, saved, tidy, utf8
from pathloom.llm.components import Forest, connected_components

BITS = 64
SPREAD = 2  # blocks beyond the largest number of differing bits that a table's key holds
LEAF = 16  # fingerprints below a lowest node
FAN = 8  # nodes below an upper node
GROUP = 4096  # fingerprints that share a key before the key is refined


def simhash(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of all word shingles, repeats included; 0 for a text without words."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words_per_shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([hash_of(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words_per_shingle: int = 3) -> Column:
    """``simhash`` of a text column as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words_per_shingle) for t in texts], np.uint64).view(np.int64))

    return run(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence: neighbours there differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_masks(bits: list[int], parts: int) -> list[list[int]]:
    """Bit positions cut into ``parts`` runs of nearly equal length."""
    return [list(x) for x in np.array_split(np.array(bits), parts)]


def move_up(codes: np.ndarray, order: list[int]) -> np.ndarray:
    """Codes whose highest bits are the bits ``order`` of the given ones, in that order."""
    out = np.zeros_like(codes)
    for to, bit in enumerate(order):
        out |= ((codes >> np.uint64(63 - bit)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def tables(most: int) -> list[tuple[list[int], int]]:
    """Bit orders and key widths: with ``most + SPREAD`` blocks, some ``SPREAD`` of them are equal in any link."""
    blocks = block_masks(list(range(BITS)), most + SPREAD)
    out = []
    for chosen in combinations(range(len(blocks)), SPREAD):
        key = [b for i in chosen for b in blocks[i]]
        rest = [b for i in range(len(blocks)) if i not in chosen for b in blocks[i]]
        out.append((key + rest, len(key)))
    return out


def refined(order: list[int], width: int, most: int) -> list[tuple[list[int], int]]:
    """The orders below a key that is too common: one of ``most + 1`` blocks of the other bits is equal as well."""
    key, rest = order[:width], order[width:]
    blocks = block_masks(rest, most + 1)
    out = []
    for i, block in enumerate(blocks):
        others = [b for j, other in enumerate(blocks) if j != i for b in other]
        out.append((key + block + others, width + len(block)))
    return out


class GrayIndex:
    """Levels of (pattern, mask) nodes over codes in Gray order.

    A lowest node holds ``LEAF`` neighbours in Gray order, an upper one ``FAN`` nodes. A
    node's mask has the bits on which all codes below agree and that no node above has
    already, its pattern their values: each agreed bit is stored and compared once, at the
    highest node that has it. Going down, the differences of masked bits add up, and a
    whole group is left out as soon as they exceed the limit.
    """

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, zeros = self.codes, ~self.codes
        levels = []
        size = LEAF
        while True:
            cuts = np.arange(0, len(ones), size)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            levels.append((ones, ones | zeros))
            if len(ones) == 1:
                break
            size = FAN
        self.levels = []
        above = np.zeros(1, np.uint64)
        for pattern, mask in reversed(levels):
            parent = np.repeat(above, FAN)[: len(mask)] if self.levels else np.zeros(1, np.uint64)
            self.levels.append((pattern, mask & ~parent))
            above = mask

    def links(self, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), first <= i < last, i < j, of codes with at most ``most`` different bits."""
        queries = self.codes[first:last]
        who = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        apart = np.zeros(len(queries), np.int64)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                who, node, apart = np.repeat(who, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel(), np.repeat(apart, FAN)
                live = node < len(pattern)
                who, node, apart = who[live], node[live], apart[live]
            apart = apart + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node])
            span = LEAF * FAN ** (len(self.levels) - 1 - depth)
            live = (apart <= most) & ((node + 1) * span > who + first)
            who, node, apart = who[live], node[live], apart[live]
        who, other = np.repeat(who, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        live = (other < len(self.codes)) & (other > who + first)
        who, other = who[live], other[live]
        near = np.bitwise_count(queries[who] ^ self.codes[other]) <= most
        return who[near] + first, other[near]


def group_links(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct codes."""
    index = GrayIndex(codes)
    forest = Forest(len(codes))
    kept: list[tuple[int, int]] = []
    for at in range(0, len(codes), 256):
        a, b = index.links(at, min(at + 256, len(codes)), most)
        kept += forest.add(zip(a.tolist(), b.tolist()))
    return [(int(index.codes[a]), int(index.codes[b])) for a, b in kept]


def small_links(keys: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys of at most ``LEAF`` rows, compared directly: they are leaves."""
    left, right = [], []
    for step in range(1, LEAF):
        if step >= len(codes):
            break
        near = (keys[step:] == keys[:-step]) & (np.bitwise_count(codes[step:] ^ codes[:-step]) <= most)
        at = np.flatnonzero(near)
        left.append(codes[at])
        right.append(codes[at + step])
    return (np.concatenate(left), np.concatenate(right)) if left else (codes[:0], codes[:0])


ROWS = "level int, path long, top long, code long"


def _keyed(codes: np.ndarray, orders: list[tuple[list[int], int]], level: int, paths: list[int]) -> Iterator[pd.DataFrame]:
    for (order, width), path in zip(orders, paths):
        moved = move_up(codes, order)
        yield pd.DataFrame(
            {
                "level": np.int32(level), "path": np.int64(path),
                "top": (moved >> np.uint64(64 - width)).view(np.int64), "code": codes.view(np.int64),
            }
        )


def order_of(path: int, level: int, most: int) -> tuple[list[int], int]:
    """The bit order of a table: the first table number, then one block number per refinement."""
    digits = []
    for _ in range(level):
        path, digit = divmod(path, most + 1)
        digits.append(digit)
    order, width = tables(most)[path]
    for digit in reversed(digits):
        order, width = refined(order, width, most)[digit]
    return order, width


def links(codes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) among the distinct longs of column ``code`` that connect what is within ``most`` bits.

    Every pair within ``most`` bits is compared in some table, and a table's group returns a
    spanning forest of its links, never all pairs. Tables order the bits so that a link
    agrees on the first ones, its key, in at least one of them; rows meet by that key. A key
    shared by more than ``GROUP`` codes passes its rows on, to be keyed by more bits, until the
    codes of one key are few or differ only in so few bits that there cannot be many.
    """
    chosen = tables(most)

    @tidy
    def start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _keyed(frame["code"].to_numpy(np.int64).view(np.uint64), chosen, 0, list(range(len(chosen))))

    @tidy
    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links as (-1, 0, a, b); rows of common keys come back keyed by more bits."""

        def flush(held: list[tuple[tuple, np.ndarray]]) -> Iterator[pd.DataFrame]:
            few = [(i, c) for i, (_, c) in enumerate(held) if 1 < len(c) <= LEAF]
            a, b = [], []
            if few:
                keys = np.repeat([i for i, _ in few], [len(c) for _, c in few])
                x, y = small_links(keys, np.concatenate([c for _, c in few]), most)
                a, b = [x.view(np.int64)], [y.view(np.int64)]
            for _, c in held:
                if len(c) > LEAF:
                    pairs = np.array(group_links(c, most), np.uint64).reshape(-1, 2)
                    a.append(pairs[:, 0].view(np.int64))
                    b.append(pairs[:, 1].view(np.int64))
            if a:
                yield pd.DataFrame({"level": np.int32(-1), "path": np.int64(0), "top": np.concatenate(a), "code": np.concatenate(b)})

        def deeper(key: tuple, codes: np.ndarray) -> Iterator[pd.DataFrame]:
            level, path, _ = key
            orders = refined(*order_of(path, level, most), most)
            yield from _keyed(codes, orders, level + 1, [path * (most + 1) + i for i in range(len(orders))])

        open_key, parts, size, common = None, [], 0, False
        held: list[tuple[tuple, np.ndarray]] = []
        waiting = 0
        for frame in frames:
            level, path, top = (frame[c].to_numpy() for c in ("level", "path", "top"))
            codes = frame["code"].to_numpy(np.int64).view(np.uint64)
            if not len(codes):
                continue
            change = np.flatnonzero((level[1:] != level[:-1]) | (path[1:] != path[:-1]) | (top[1:] != top[:-1])) + 1
            cuts = np.concatenate(([0], change, [len(codes)])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                key = (int(level[a]), int(path[a]), int(top[a]))
                if key != open_key:
                    if parts and not common:
                        held.append((open_key, np.concatenate(parts)))
                        waiting += size
                    if waiting > 1 << 18:
                        yield from flush(held)
                        held, waiting = [], 0
                    open_key, parts, size, common = key, [], 0, False
                if common:
                    yield from deeper(key, codes[a:b])
                    continue
                parts.append(codes[a:b])
                size += b - a
                if size > GROUP and order_of(key[1], key[0], most)[1] < BITS - 12:
                    common = True
                    yield from deeper(key, np.concatenate(parts))
                    parts = []
        if parts and not common:
            held.append((open_key, np.concatenate(parts)))
        yield from flush(held)

    rows = codes.select("code").mapInPandas(start, ROWS)
    found = None
    while True:
        sorted_rows = rows.repartition("level", "path", "top").sortWithinPartitions("level", "path", "top")
        met = saved(sorted_rows.mapInPandas(meet, ROWS), "gray-links")
        own = met.where("level = -1").select(F.col("top").alias("a"), F.col("code").alias("b"))
        found = own if found is None else found.unionByName(own)
        rows = met.where("level >= 0")
        if rows.isEmpty():
            return found.distinct()


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, most: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, code, component_id) of each row: its SimHash, and the smallest id it is linked to.

    Rows whose fingerprints differ in at most ``most`` bits are linked, and links chain.
    Equal fingerprints are one node of the graph from the start, with the smallest id, so a
    group of copies costs one row however large it is. A text without words (null, empty,
    blanks) has fingerprint 0 and is linked like any other. Rows with a null id keep their
    fingerprint and take part as links; their component is null only if all rows of it
    have no id. Repeated ids are reported each. An empty table gives no rows.
    """
    prints = saved(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col).cast("string"), words_per_shingle).alias("code")),
        "simhash",
    )
    nodes = saved(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts = connected_components(links(nodes, most)).withColumnsRenamed({"node": "code", "component": "part"})
    parts = saved(nodes.join(parts, "code", "left").withColumn("part", F.coalesce("part", "code")), "simhash-parts")
    least = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    named = parts.join(least, "part").select("code", "component_id")
    return prints.join(named, "code").select("doc_id", "code", "component_id")


def keep_first(docs: DataFrame, shingles: tuple[int, ...] = (3,), **options) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    Documents are linked if their fingerprints of shingles of any of the given lengths are;
    links chain across lengths. Rows without an id, which cannot be told apart, all stay. Of
    rows that repeat the kept id, all stay: they are one document to every later join. An id
    goes with all its rows if one of them is in a group that has a smaller id.
    """
    edges = None
    for words in shingles:
        found = near_duplicates(docs, words_per_shingle=words, **options)
        own = found.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    if len(shingles) == 1:  # every id is linked to the smallest one of its group already
        gone = edges.select(F.col("a").alias("doc_id")).distinct()
    else:
        gone = connected_components(edges).where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")
