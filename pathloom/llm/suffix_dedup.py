"""Exact substring dedup over a collection's Burrows-Wheeler transform and common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import free_name, saved, slices, tidy, utf8
from pathloom.operators.joins import lookup_join

LEVELS = (20, 36, None)  # bytes of an anchor: first, where an anchor is too common, and the whole window
COLLECTION = 1024  # strings of one collection, as far as whole anchors allow
COMMON = 65_536  # strings of one anchor before it is cut finer
PASSED_ON = 4096  # strings of a common anchor that go to the finer level at a time
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ anchors

def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes, from the words in it; the last word may overlap the one before."""
    n = len(data) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    width = next(w for w in (8, 4, 2, 1) if w <= size)
    words = np.ndarray(len(data) - width + 1, f"<u{width}", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    whole = words[:n].copy()
    for at in [*range(width, size - width, width), size - width] if size > width else ():
        whole *= MULTIPLIER
        whole += words[at : at + n]
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return whole


def anchors(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a text.

    The anchor of a window of ``length`` bytes is the smallest hash of its runs of ``size``
    bytes. It depends on the window's bytes alone, so equal windows of any two texts have
    equal anchors, and neighbouring windows mostly share one. Where a text repeats itself and
    an anchor goes on for longer, it is cut, so that the bytes of one stay few.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = gram_hashes(data, size)
    span, reach = length - size + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: -(span - reach)], least[span - reach :])
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    sizes = np.diff(np.append(starts, len(least)))
    if sizes.max() > span:
        pieces = -(-sizes // span)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + nth * span
    return least[starts], starts, np.append(starts[1:], len(least)) - 1


# ------------------------------------------------------------------ the collection

def column_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: (string, suffix length, common prefix with the one before, symbol before).

    Round t puts the suffix of length t of every string in its place among the suffixes of
    length below t: one symbol per string is added to the collection's Burrows-Wheeler
    transform. A suffix c.v stands after all suffixes that begin with less than c, and among
    those with c in the order of the c's in the transform before it. ``order`` is the stable
    order of the transform's symbols, so that a symbol's place in it is its place among the longer
    suffixes. The common prefix of a new row is one more than the least common prefix between
    v and the last row above with the same symbol; the row after it is updated likewise.
    A row is one cell, symbol and common prefix, and the column of cells is read and rewritten
    front to back in each round. Every string has an end of its own, smaller than any byte; ends
    never match. The symbols are the finished transform; which suffix a row is follows from them.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    m, longest = len(strings), int(lengths.max())
    # Row t - 1 has the symbols of round t: the t-th byte from the end plus one. 0 is the end of a string.
    symbols = np.zeros((longest + 1, m), np.uint8)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(lengths)
    for t in range(1, longest + 1):
        has = lengths >= t
        symbols[t - 1, has] = joined[ends[has] - t] + np.uint8(1)  # no UTF-8 byte is 255
    cell = np.dtype(np.uint16 if longest < 256 else np.uint32)  # the symbol in the low byte, the prefix above it
    eight = cell.type(8)
    bwt, cells = symbols[0], symbols[0].astype(cell)
    order = np.argsort(bwt, kind="stable")
    finished = int(np.count_nonzero(bwt == 0))  # ends of strings, which come first in the order
    at = np.arange(finished, m)
    who = order[finished:]
    for t in range(1, longest + 1):
        place, row = order[at], at + (m - finished)
        least = np.append(cells, cell.type(np.iinfo(cell).max))

        def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            # Backwards, as a step down from one range's end to the next range's start costs nothing.
            edges = np.empty(2 * len(low), np.int64)
            edges[::2], edges[1::2] = low[::-1] + 1, high[::-1] + 1
            return np.minimum.reduceat(least, edges)[::2][::-1] >> eight

        symbol = bwt[place]
        before = order[np.maximum(at - 1, 0)]
        same = (at > 0) & (bwt[before] == symbol)
        own = np.zeros(len(at), cell)
        if same.any():
            own[same] = between(before[same], place[same]) + cell.type(1)
        after = order[np.minimum(at + 1, len(order) - 1)]
        follows = (at + 1 < len(order)) & (bwt[after] == symbol)
        following = symbols[t, who]
        fresh = np.zeros(m - finished + len(order), bool)
        fresh[row] = True
        merged = np.empty(len(fresh), cell)
        merged[~fresh] = cells
        merged[row] = (own << eight) | following
        if follows.any():
            shared = between(place[follows], after[follows]) + cell.type(1)
            below = row[follows] + 1
            still = ~fresh[below]
            below = below[still]
            merged[below] = (shared[still] << eight) | (merged[below] & cell.type(255))
        cells, bwt = merged, merged.astype(np.uint8)
        # The next symbols take their places among the rows of the same symbol.
        order = np.argsort(bwt, kind="stable")
        over = int(np.count_nonzero(following == 0))
        finished += over
        at = np.flatnonzero(fresh[order])[over:]
        who = who[np.argsort(following, kind="stable")[over:]]
    # From each end of a string along its symbols: a row's symbol before it leads to the row of the longer suffix.
    longer = np.zeros(len(order), np.int64)
    longer[order[finished:]] = np.arange(m, m + len(order) - finished)
    owner, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    who, row = np.arange(m), np.arange(m)
    for t in range(longest + 1):
        owner[row], size[row] = who, t
        live = lengths[who] > t
        who, row = who[live], longer[row[live]]
    return owner, size, cells >> eight, bwt


def first_owners(strings: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, the smallest document id of each of its windows of ``length`` bytes.

    Suffixes of at least ``length`` bytes whose common prefixes reach ``length`` are runs in
    the order; the run's smallest id is the first owner of the window they begin with.
    """
    owner, size, lcp, _ = column_order(strings)
    keep = size >= length
    owner, size, lcp = owner[keep], size[keep], lcp[keep]
    lengths = np.array([len(s) for s in strings], np.int64)
    run = np.flatnonzero(np.concatenate(([True], lcp[1:] < length)))
    least = np.repeat(np.minimum.reduceat(docs[owner], run), np.diff(np.append(run, len(owner))))
    offsets = np.concatenate(([0], np.cumsum(lengths - length + 1)))
    out = np.empty(offsets[-1], np.int64)
    out[offsets[owner] + lengths[owner] - size] = least
    return np.split(out, offsets[1:-1])


# ------------------------------------------------------------------ jobs

PACKED = "part int, ids binary, marks binary, keys binary"


def part_of(parts: int) -> Column:
    """The group of documents that a document belongs to; ``mark`` is a hash."""
    return F.pmod(F.col("doc_id").bitwiseXOR(F.col("mark")), F.lit(parts)).cast("int")


def packed(ids: np.ndarray, marks: np.ndarray, hashes: np.ndarray, parts: int) -> pd.DataFrame:
    """(document, anchor) pairs as one row per group of documents."""
    part = (ids ^ marks) % parts
    order = np.lexsort((ids, part))
    part, ids, marks, hashes = part[order], ids[order], marks[order], hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    rows = [
        (int(part[a]), ids[a:b].tobytes(), marks[a:b].tobytes(), hashes[a:b].tobytes())
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)])
    ]
    return pd.DataFrame(rows, columns=["part", "ids", "marks", "keys"]).astype({"part": np.int32})


def repeated_anchors(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """Pairs of a document and an anchor of it that another document has too, packed (``PACKED``).

    A batch of documents settles by itself what repeats within it and sends each of its
    anchors once, packed, to one of the shuffle's buckets by hash: an anchor that is in a third
    of all documents arrives once per batch, not once per document.
    """

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text", 8 << 20):
            ids, marks = frame["doc_id"].to_numpy(np.int64), frame["mark"].to_numpy(np.int64)
            hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            taken: set[tuple[int, int]] = set()
            for i, (key, text) in enumerate(zip(zip(ids.tolist(), marks.tolist()), frame["text"])):
                if key in taken:  # the same text with the same id: told with the first one
                    continue
                taken.add(key)
                own = np.sort(anchors(np.frombuffer(utf8(text), np.uint8), length, LEVELS[0])[0])
                own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
                hashes.append(own)
                rows.append(np.full(len(own), i))
            hashed, row = np.concatenate(hashes), np.concatenate(rows)
            if not len(hashed):
                continue
            order = np.argsort(hashed)
            hashed, row = hashed[order], row[order]
            # Repeated here: the least and the greatest document of a hash differ.
            head = np.concatenate(([True], hashed[1:] != hashed[:-1]))
            first, docs = np.flatnonzero(head), ids[row]
            twice = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            here = np.repeat(twice, np.diff(np.append(first, len(hashed))))
            settled = packed(ids[row[here]], marks[row[here]], hashed[here], parts)
            yield settled.assign(bucket=settled["part"], settled=True, local=None)[columns]
            # One of each to its bucket: hash, its document within the piece, whether it is settled.
            # Of a hash that one id has in several texts, each text: all of them may be told.
            told = head | ~here
            sent, keys, known = row[told], hashed[told], here[told]
            bucket = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket * len(frame) + sent)
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            out = []
            for b in range(parts):
                own = order[edges[b] : edges[b + 1]]
                if len(own):
                    present = np.zeros(len(ids), bool)
                    present[sent[own]] = True
                    used, local = np.flatnonzero(present), (np.cumsum(present) - 1)[sent[own]]
                    local = (local.astype(np.uint32) << np.uint32(1)) | known[own].astype(np.uint32)
                    out.append((b, False, 0, ids[used].tobytes(), marks[used].tobytes(), keys[own].tobytes(), local.tobytes()))
            yield pd.DataFrame(out, columns=columns)

    columns = ["bucket", "settled", "part", "ids", "marks", "keys", "local"]
    kinds = f"bucket int, settled boolean, {PACKED}, local binary"

    @tidy
    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(held: list[tuple]) -> Iterator[pd.DataFrame]:
            if not held:
                return
            hashes = np.frombuffer(b"".join(x[2] for x in held), np.uint64)
            local = np.frombuffer(b"".join(x[3] for x in held), np.uint32)
            ids, marks = (np.frombuffer(b"".join(x[k] for x in held), np.int64) for k in (0, 1))
            shift = np.cumsum([0, *[len(x[0]) // 8 for x in held[:-1]]])
            who = np.repeat(shift, [len(x[2]) // 8 for x in held]) + (local >> 1)
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            met = np.zeros(len(hashes), bool)
            met[order[1:][same]] = met[order[:-1][same]] = True
            want = met & ((local & 1) == 0)
            if want.any():
                yield packed(ids[who[want]], marks[who[want]], hashes[want], parts)

        bucket, held = None, []
        for frame in frames:
            done = frame[frame["settled"]]
            if len(done):
                yield done[["part", "ids", "marks", "keys"]]
            sent = frame[~frame["settled"]]
            for b, *row in zip(sent["bucket"], sent["ids"], sent["marks"], sent["keys"], sent["local"]):
                if b != bucket:
                    yield from close(held)
                    bucket, held = b, []
                held.append(row)
        yield from close(held)

    sent = texts.mapInPandas(cut, kinds).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInPandas(meet, PACKED)


def occurrences(texts: DataFrame, wanted: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc_id, mark, at, anchor, piece): the bytes around each repeated anchor and where they start.

    Packed anchors and texts of a group of documents meet in one task, anchors first; only
    the anchors of a group are held, texts stream by.
    """

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, table, keys = None, [], {}, np.zeros(0, np.uint64)
        for frame in slices(frames, "text"):
            ids, marks = [], []
            rows: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
            pieces: list[bytes] = []
            for group, own_ids, own_marks, own_keys, doc, mark, text in zip(*[frame[c] for c in both_columns]):
                if group != part:
                    part, held, table = group, [], {}
                if own_ids is not None:
                    held.append((own_ids, own_marks, own_keys))
                    continue
                if held:
                    docs, tags = (np.frombuffer(b"".join(h[k] for h in held), np.int64) for k in (0, 1))
                    keys = np.frombuffer(b"".join(h[2] for h in held), np.uint64)
                    order = np.lexsort((keys, tags, docs))
                    docs, tags, keys = docs[order], tags[order], keys[order]
                    cuts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]))))
                    table = {(int(docs[a]), int(tags[a])): (a, b) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(docs)])}
                    held = []
                place = table.get((int(doc), int(mark)))
                if place is None:
                    continue
                raw = utf8(text)
                hashes, first, last = anchors(np.frombuffer(raw, np.uint8), length, LEVELS[0])
                repeated = keys[place[0] : place[1]]
                own = repeated[np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)] == hashes
                hashes, first, last = hashes[own], first[own], last[own]
                rows.append(np.stack((np.full(len(first), len(ids)), first, hashes.view(np.int64))))
                pieces += [raw[a:b] for a, b in zip(first.tolist(), (last + length).tolist())]
                ids.append(int(doc))
                marks.append(int(mark))
            row, at, anchor = np.concatenate(rows, axis=1)
            yield pd.DataFrame(
                {"doc_id": np.array(ids, np.int64)[row], "mark": np.array(marks, np.int64)[row], "at": at, "anchor": anchor, "piece": pieces}
            )

    both_columns = ["part", "ids", "marks", "keys", "doc_id", "mark", "text"]
    keyed = texts.select(part_of(parts).alias("part"), "doc_id", "mark", "text")
    nobody = F.lit(0).cast("long")  # no nulls, which would make numbers of them that are not exact
    listed = wanted.withColumns({"doc_id": nobody, "mark": nobody})
    both = listed.unionByName(keyed, allowMissingColumns=True).select(*both_columns)
    both = both.repartition(parts, "part").sortWithinPartitions("part", F.col("ids").isNull())
    return both.mapInPandas(cut, "doc_id long, mark long, at long, anchor long, piece binary")


def sharing(strings: list[bytes], size: int) -> np.ndarray:
    """Which strings share ``size`` bytes with another one, by hash: the rest share no longer string either."""
    lengths = np.array([len(x) for x in strings])
    owner = np.repeat(np.arange(len(strings)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.flatnonzero(place <= lengths[owner] - size)
    if not len(inside):
        return np.zeros(len(strings), bool)
    hashes, owner = gram_hashes(np.frombuffer(b"".join(strings), np.uint8), size)[inside], owner[inside]
    order = np.argsort(hashes, kind="stable")  # owners stay in order within a hash
    hashes, owner = hashes[order], owner[order]
    meets = (hashes[1:] == hashes[:-1]) & (owner[1:] != owner[:-1])
    out = np.zeros(len(strings), bool)
    out[owner[1:][meets]] = out[owner[:-1][meets]] = True
    return out


def window_firsts(pieces: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(piece, at, firsts): the first owner of each window of a distinct piece, from window ``at`` on.

    ``pieces``: anchor, piece, doc_id (its smallest). Pieces of one anchor meet in one
    collection, of many anchors at a time, and the collection's order says which windows are
    equal. A piece that is alone with its anchor, or shares too few bytes with any other piece
    of the collection, has no equal and is left out of the order. The pieces of an anchor with more than ``COMMON``
    of them are cut around longer anchors and meet again by those; at the last level the
    anchor is the window, and equal windows are one piece.
    """
    size = LEVELS[level] or length
    last = size >= length

    @tidy
    def order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(strings: list, docs: list) -> Iterator[pd.DataFrame]:
            if not strings:
                return
            shared = sharing(strings, min(LEVELS[1], length))
            own = [(s, d) for s, d, x in zip(strings, docs, shared) if not x]
            if own:
                yield alone(*zip(*own))
            both = [(s, d) for s, d, x in zip(strings, docs, shared) if x]
            if both:
                strings, docs = zip(*both)
                firsts = first_owners(list(strings), np.array(docs, np.int64), length)
                yield pd.DataFrame({"piece": strings, "firsts": firsts, "doc_id": docs})

        def cut(strings: list, docs: list) -> pd.DataFrame:
            return pd.DataFrame({"piece": strings, "firsts": [None] * len(strings), "doc_id": docs})

        def alone(piece: list, docs: list) -> pd.DataFrame:
            """Strings with nothing to compare them with: each is the first owner of its windows."""
            return pd.DataFrame({"piece": list(piece), "firsts": [np.full(len(p) - length + 1, d) for p, d in zip(piece, docs)], "doc_id": list(docs)})

        done: tuple[list, list] = ([], [])
        single: tuple[list, list] = ([], [])
        strings: list[bytes] = []
        docs: list[int] = []
        current, common = None, False
        for frame in frames:
            for anchor, piece, doc in zip(frame["anchor"], frame["piece"], frame["doc_id"]):
                if anchor != current:
                    if common:  # all of its strings meet at the finer level, the last ones too
                        if strings:
                            yield cut(strings, docs)
                    else:
                        into = single if len(strings) == 1 else done
                        into[0].extend(strings)
                        into[1].extend(docs)
                    strings, docs, current, common = [], [], anchor, False
                    if len(done[0]) >= COLLECTION:
                        yield from close(*done)
                        done = ([], [])
                strings.append(piece)
                docs.append(doc)
                if not last and (common or len(strings) > COMMON):
                    common = True
                    if len(strings) > PASSED_ON:
                        yield cut(strings, docs)
                        strings, docs = [], []
            if common and strings:
                yield cut(strings, docs)
                strings, docs = [], []
            if single[0]:
                yield alone(*single)
                single = ([], [])
        done[0].extend(strings)
        done[1].extend(docs)
        yield from close(*done)

    spread = pieces.repartition("anchor").sortWithinPartitions("anchor")
    met = saved(spread.mapInPandas(order, "piece binary, firsts array<long>, doc_id long"), f"suffix-order-{level}")
    settled = met.where("firsts IS NOT NULL").select("piece", F.lit(0).cast("long").alias("at"), "firsts")
    rest = met.where("firsts IS NULL").select("piece", "doc_id")
    if last or rest.isEmpty():
        return settled
    finer = LEVELS[level + 1] or length

    @tidy
    def recut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for piece, doc in zip(frame["piece"], frame["doc_id"]):
                hashes, first, to = anchors(np.frombuffer(piece, np.uint8), length, finer)
                rows += [(piece, a, h, piece[a : b + length], doc) for h, a, b in zip(hashes.view(np.int64).tolist(), first.tolist(), to.tolist())]
            yield pd.DataFrame(rows, columns=["whole", "shift", "anchor", "piece", "doc_id"])

    inner = saved(rest.mapInPandas(recut, "whole binary, shift long, anchor long, piece binary, doc_id long"), "suffix-finer")
    below = window_firsts(inner.groupBy("anchor", "piece").agg(F.min("doc_id").alias("doc_id")), length, level + 1)
    back = inner.select("whole", "shift", "piece").join(below, "piece")
    return settled.unionByName(back.select(F.col("whole").alias("piece"), (F.col("at") + F.col("shift")).alias("at"), "firsts"))


def repeat_spans(docs: DataFrame, length: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, spans): byte runs covered by a window that also starts in a document with a smaller id.

    ``spans`` are maximal [start, end) runs, as a flat list. Only rows with such runs are
    returned; ``mark`` tells rows that share an id apart (a hash of the text). Equal texts are
    one member of the collection, the one with the smallest id; the others are covered whole.
    """
    texts = _texts(docs, text_col, id_col)
    texts = texts.withColumn("digest", F.when(F.octet_length("text") >= length, F.sha2("text", 256)))
    twins = texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    twins = saved(twins.select("digest", "first"), "suffix-twins")
    texts = lookup_join(texts, twins, "digest", "left", spread=F.xxhash64("doc_id"))
    whole = texts.where("first < doc_id").select(
        "doc_id", "mark", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b"))).alias("runs")
    )
    texts = texts.where("first IS NULL OR first = doc_id").select("doc_id", "mark", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = saved(repeated_anchors(texts, length, parts), "suffix-anchors")
    found = saved(occurrences(texts, wanted, length, parts), "suffix-pieces")
    firsts = window_firsts(found.groupBy("anchor", "piece").agg(F.min("doc_id").alias("doc_id")), length)

    @tidy
    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, start, shift = (batch.column(k).to_numpy() for k in range(4))
            firsts = batch.column(4)
            sizes = firsts.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            later = firsts.flatten().to_numpy() < doc[row]
            edge = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)  # last window of a row
            begins = later & ~np.concatenate(([False], later[:-1] & ~edge[:-1]))
            ends = later & ~np.append(later[1:] & ~edge[:-1], False) if len(row) else later
            a, b = np.flatnonzero(begins), np.flatnonzero(ends)
            own = row[a]
            base = start[own] + shift[own]
            columns = [doc[own], mark[own], base + place[a], base + place[b] + length]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["doc_id", "mark", "a", "b"])

    owned = firsts.select("piece", F.col("at").alias("shift"), "firsts")
    runs = found.select("doc_id", "mark", "at", "piece").join(owned, "piece").select("doc_id", "mark", "at", "shift", "firsts")
    runs = runs.mapInArrow(covered, "doc_id long, mark long, a long, b long")
    return runs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("runs")).unionByName(whole)


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0)).alias("mark"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


REPORT = "struct<n_bytes:long,n_removed:long,spans:array<array<long>>,kept:binary>"


def find_repeats(
    docs: DataFrame, length: int = 50, text_col: str = "text", id_col: str = "doc_id", out_col: str = "repeats"
) -> DataFrame:
    """Add a struct ``out_col`` (n_bytes, n_removed, spans, kept) to each row of ``docs``.

    A text is its UTF-8 bytes. Each byte is removed that is covered by a string of ``length``
    bytes which also starts in a document with a smaller id; overlaps count, and strings are
    judged on the input. ``spans`` are the maximal removed runs, ``kept`` the other bytes.

    Three joins: anchors that repeat, told to the documents that have them; the strings around
    those, collected once per distinct string and ordered as a collection; and the runs that
    follow, told to the documents. Text is moved by document id only.

    Nulls: a null text is empty; a row without an id neither removes nor loses anything.
    Rows that share an id do not count as repeats of each other. Texts shorter than ``length``
    have no strings. An empty table gives no rows. All columns are kept; one named
    ``out_col`` is replaced.
    """
    spans = saved(repeat_spans(docs, length, text_col, id_col), "suffix-spans")

    def row_of(text: str | None, runs: list | None) -> tuple:
        raw = utf8(text)
        edge = np.zeros(len(raw) + 1, np.int64)
        for x in runs if runs is not None else ():
            edge[x["a"]] += 1
            edge[x["b"]] -= 1
        gone = (np.cumsum(edge)[:-1] > 0).astype(np.int8)
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2).tolist()
        kept = np.frombuffer(raw, np.uint8)[gone == 0].tobytes()
        return len(raw), int(gone.sum()), cuts, kept

    @F.pandas_udf(REPORT)
    @tidy
    def report(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in parts:
            rows = [row_of(text, own) for text, own in zip(texts, runs)]
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])

    columns = [c for c in docs.columns if c.lower() != out_col.lower()]
    row, own, told_id, told_mark, runs = (free_name(docs, f"_{name}") for name in ("row", "own", "id", "mark", "runs"))
    mark = F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))
    told = spans.withColumnsRenamed({"doc_id": told_id, "mark": told_mark, "runs": runs})
    keyed = docs.select(*columns, F.col(id_col).cast("long").alias(row), mark.alias(own))
    both = keyed.join(told, (F.col(row) == F.col(told_id)) & (F.col(own) == F.col(told_mark)), "left")
    return both.select(*columns, report(F.col(text_col).cast("string"), runs).alias(out_col))


def drop_repeats(docs: DataFrame, length: int = 50, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; columns as before.

    A character of which only some bytes are left goes as well. Texts without repeats, null
    ones included, stay as they are.
    """
    repeats = free_name(docs, "repeats")
    found = find_repeats(docs, length, text_col, id_col, repeats)

    @F.pandas_udf("string")
    @tidy
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for kept in parts:
            yield pd.Series([None if k is None else bytes(k).decode("utf-8", "ignore") for k in kept], dtype=object)

    cut = F.when(F.col(f"{repeats}.n_removed") > 0, decoded(f"{repeats}.kept")).otherwise(F.col(text_col))
    return found.withColumn(text_col, cut).select(*docs.columns)
