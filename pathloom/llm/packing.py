"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import saved, tidy

LONG_BLANKS = 100_000  # blanks in a row beyond which tiktoken's pattern may run out of stack
PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by ``tiktoken`` on the same ranks.

    Ids are equal (tests compare them); it is about four times as fast. Special tokens'
    strings inside a text are ordinary text.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {token["content"] for token in content["added_tokens"]}
    # The byte-to-character table of byte-level BPE: printable bytes stand for themselves.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in content["model"]["vocab"].items()
        if token not in special
    }
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class WholeEncoder:
    """Ids as ``tokenizers`` gives them, by ``tiktoken`` where the two are sure to agree.

    Texts with very long runs of blanks go to ``tokenizers`` itself, and with ``added_tokens``
    those that hold the string of an added token, which has its own id there; else such strings
    are ordinary text. ``tokenizers`` is loaded when the first such text comes.
    """

    def __init__(self, path: str, added_tokens: bool) -> None:
        import json

        self.path, self.added, self.whole = path, added_tokens, None
        self.fast = encoder(path).encode_ordinary
        self.blanks = re.compile(r"\s{%d}" % LONG_BLANKS)
        with open(path, encoding="utf-8") as file:
            tokens = [re.escape(t["content"]) for t in json.load(file)["added_tokens"]]
        self.tokens = re.compile("|".join(tokens)) if tokens and added_tokens else None

    def __call__(self, text: str) -> list[int]:
        if (self.tokens is None or not self.tokens.search(text)) and (len(text) < LONG_BLANKS or not self.blanks.search(text)):
            return self.fast(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = not self.added
        return self.whole.encode(text, add_special_tokens=False).ids


def tokenize_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, added_tokens: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids; ``nth`` numbers those of one length within a task ``part``.

    A document is its ids, then ``end_id``. Only longer ones are cut: all pieces have
    ``size`` ids but the first, which has the rest.
    """

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WholeEncoder(tokenizer, added_tokens)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]

        def batch(rows: list[tuple], values: list[np.ndarray]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            offsets = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
            columns.insert(4, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types)], names=names)

        for source in batches:
            rows, values, held = [], [], 0
            for doc, text in zip(source.column(0).to_pylist(), source.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                ids = np.array(ids, np.int32)
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[a:b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(own.astype("<u4").tobytes()), part, int(seen[b - a])))
                    values.append(own)
                    seen[b - a] += 1
                held += len(ids)
                if held > 1 << 20:
                    yield batch(rows, values)
                    rows, values, held = [], [], 0
            if rows:
                yield batch(rows, values)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, last rank, bin, per bin, offset).

    Pieces of ``length`` with rank ``first + j`` go to bin ``bin + j // per_bin`` at
    ``offset + (j % per_bin) * length``. Bins alike (same room left, consecutive numbers)
    are one group, so the work follows the number of lengths, not of pieces.
    """
    rows, bins = [], 0
    rooms: list[int] = []  # sorted rooms left, with their groups [first bin, count]
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # nothing fits: as many new bins as are needed
                count = -(-left // (size // length))
                put(size, bins, count)
                bins += count
                continue
            room = rooms[at]
            first, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            used = min(count, -(-left // each))
            taken = min(left, used * each)
            rows.append((length, rank, rank + taken, first, each, size - room))
            full, rest = divmod(taken, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + used, count - used)
            left -= taken
            rank += taken
    return rows


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, added_tokens: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids, one row per piece.

    Columns: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    With ``added_tokens`` the string of an added token in a text has that token's id, as
    ``tokenizers`` encodes it by default; else it is ordinary text.

    1. Tokenise once and write the pieces; each task numbers its pieces per length.
    2. The histogram has at most ``size`` lengths, so planning is small whatever the corpus.
    3. The rank of a piece within its length is its number in its task plus the counts of
       the tasks before; that table has a row per task and length. Pieces take the slot
       the plan has for their rank, by a join on the length.

    The plan is broadcast: its size depends on ``size``, not on the number of documents, and
    is checked. Nulls: a null text is empty and has one piece, the end id; a null doc_id stays
    null. Repeated rows are packed each; an empty table gives no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    pieces = saved(tokenize_pieces(docs, tokenizer, size, end_id, added_tokens), "pieces")
    per_task = saved(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, size)
    slots = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, first long, last long, bin long, each long, room long")
    before = per_task.selectExpr(
        "length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before"
    )
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    if len(rows) <= 200 * size:
        slots = F.broadcast(slots)
    fits = (F.col("slot.length") == ranked["length"]) & (F.col("rank") >= F.col("slot.first")) & (F.col("rank") < F.col("slot.last"))
    step = F.col("rank") - F.col("slot.first")
    return ranked.join(slots.alias("slot"), fits).select(
        "doc_id", "piece", "start", ranked["length"], "ids", "ids_crc32",
        (F.col("slot.bin") + F.floor(step / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.room") + F.pmod(step, F.col("slot.each")) * ranked["length"]).cast("long").alias("offset"),
    )
