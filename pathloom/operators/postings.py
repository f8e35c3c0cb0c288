"""Building the positional inverted index and its statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokenize


def doc_lengths(docs: DataFrame, text: str = "name", tokenizer: str = "mixed") -> DataFrame:
    """Adds ``dl``, the token count of each document."""
    return docs.withColumn("dl", F.size(tokenize(text, tokenizer)))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, tokens and mean length of frames that carry ``dl``."""
    return docs.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens"),
        F.avg("dl").alias("avg_len"),
    )


def build_postings(docs: DataFrame, text: str = "name", tokenizer: str = "mixed") -> DataFrame:
    """``(term, doc_id, tf, dl, positions)``, one row per distinct term of a document.

    All tokens of a document sit in one row, so they are grouped inside that row:
    sort (term, position) pairs, find where the term changes, slice there. Nothing is
    shuffled, and a term that occurs everywhere causes no skew.
    """
    return token_postings(docs.select("doc_id", tokenize(text, tokenizer).alias("tokens")))


def token_postings(tokens: DataFrame) -> DataFrame:
    """:func:`build_postings` of documents that are cut into ``tokens`` already."""
    ordered = tokens.select(
        "doc_id",
        F.size("tokens").alias("dl"),
        F.sort_array(
            F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        ).alias("pairs"),
    )
    pairs, dl = F.col("pairs"), F.col("dl")
    starts = ordered.select(
        "doc_id", "dl", "pairs",
        F.when(
            dl > 0,
            F.filter(
                F.sequence(F.lit(0), dl - 1),
                lambda i: (i == 0) | (pairs[i]["term"] != pairs[i - 1]["term"]),
            ),
        ).alias("starts"),
    )
    begins = F.col("starts")
    groups = starts.select(
        "doc_id", "dl",
        F.explode(
            F.transform(
                begins,
                lambda s, g: F.slice(pairs, s + 1, F.coalesce(F.get(begins, g + 1), dl) - s),
            )
        ).alias("g"),
    )
    return groups.select(
        F.col("g")[0]["term"].alias("term"),
        "doc_id",
        F.size("g").alias("tf"),
        "dl",
        F.col("g")["pos"].alias("positions"),
    )


#: Document ids of a posting block.
BLOCK = 256


def block_of(doc_id: Column | str = "doc_id") -> Column:
    return F.shiftright(doc_id, BLOCK.bit_length() - 1)


def offset_of(doc_id: Column | str = "doc_id") -> Column:
    """The id within its block."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return doc_id.bitwiseAND(F.lit(BLOCK - 1).cast("long")).cast("int")


def id_of(block: str, offset: str) -> Column:
    return F.shiftleft(block, BLOCK.bit_length() - 1) + F.col(offset)


def block_postings(postings: DataFrame) -> DataFrame:
    """One row per term and block of document ids, with the bounds of its weights.

    Lists are as long as a block at most.
    """
    entry = F.struct(offset_of().alias("offset"), "tf", "dl", "positions")
    rows = postings.groupBy("term", block_of().alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    e = F.col("e")
    return rows.select(
        "term", "block", F.size("e").alias("n"), e["offset"].alias("offsets"), e["tf"].alias("tfs"), e["dl"].alias("dls"),
        e["positions"].alias("positions"), F.array_max(e["tf"]).alias("max_tf"), F.array_min(e["dl"]).alias("min_dl"),
    )


#: Tokens and documents that a task groups at once, postings that it packs at once; bytes of packed postings that it opens
#: at once, and of one term at most.
GROUP_TOKENS, GROUP_DOCS, PACK_POSTINGS, OPEN_BYTES, TERM_BYTES = 1 << 21, 1 << 16, 1 << 18, 1 << 20, 4 << 20

#: Postings of a term on their way to its files: ``first`` is the least id, ``span`` four blocks of ids or -1.
PACKED = "term string, span long, first long, packed binary"


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first: (bytes, where each of the ``uint64`` values ends)."""
    size, rest = np.ones(len(values), np.int8), values >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, k = np.arange(len(values)), 0
    while len(at):
        more = size[at] > k + 1
        out[ends[at] - size[at] + k] = ((values[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, k = at[more], k + 1
    return out, ends


def _values(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each ends) of :func:`_varints`."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    values, at, k = np.zeros(len(ends), np.uint64), np.arange(len(ends)), 0
    while len(at):
        values[at] |= (data[starts[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        at = at[ends[at] - starts[at] > k]
    return values, ends


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sums of the sizes before each."""
    return np.cumsum(sizes) - sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - _before(sizes), sizes) + np.arange(sizes.sum())


def _packed(terms: pa.Array, code: np.ndarray, doc_id: np.ndarray, tf: np.ndarray, dl: np.ndarray, places: np.ndarray, frequent: pa.Array) -> Iterator[pa.RecordBatch]:
    """``PACKED`` rows of postings in the order of (code, doc_id); ``places`` are all their positions."""
    listed = pc.is_in(terms, value_set=frequent).to_numpy(zero_copy_only=False)
    first = np.append(_before(tf), len(places))
    # A posting is as large as its positions.
    for a, b in _pieces(tf + 3, 4 * PACK_POSTINGS):
        yield _pack(terms, listed, code[a:b], doc_id[a:b], tf[a:b], dl[a:b], places[first[a] : first[b]])


def _pack(terms: pa.Array, listed: np.ndarray, code: np.ndarray, doc_id: np.ndarray, tf: np.ndarray, dl: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row is a term, or a term and span of a listed one.

    It holds the number of postings, the steps of their ids, their ``2 dl`` or ``2 dl + 1`` where tf is above 1, such tf, and
    the steps of their positions.
    """
    span = np.where(listed[code], doc_id // (4 * BLOCK), -1)
    row = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (span[1:] != span[:-1])]))
    n = np.diff(np.append(row, len(code)))
    m = np.add.reduceat(tf, row)
    step = np.diff(doc_id, prepend=0)
    step[row] = 0
    hop = np.diff(places, prepend=0)
    hop[_before(tf)] = places[_before(tf)]
    many = tf > 1
    k = np.add.reduceat(many.astype(np.int64), row)
    sizes = 1 + 2 * n + k + m
    starts = _before(sizes)
    values = np.empty(int(sizes.sum()), np.uint64)
    values[starts] = n
    at = _runs(starts + 1, n)
    values[at] = step.astype(np.int64).view(np.uint64)
    values[at + np.repeat(n, n)] = 2 * dl + many
    values[_runs(starts + 1 + 2 * n, k)] = tf[many]
    values[_runs(starts + 1 + 2 * n + k, m)] = hop
    data, ends = _varints(values)
    offsets = np.append(0, ends[starts + sizes - 1]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    columns = [terms.take(pa.array(code[row])), pa.array(span[row]), pa.array(doc_id[row]), packed]
    return pa.RecordBatch.from_arrays(columns, names=["term", "span", "first", "packed"])


def _pieces(sizes: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of ``most`` in size and of ``rows`` rows, one row at least."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        end = min(max(end, start + 1), start + rows)
        yield start, end
        start = end


def packed_tokens(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """``PACKED`` rows of documents (doc_id, tokens): the postings of :func:`token_postings`.

    A task groups some millions of tokens at once, by one sort of numbers that hold term, document and position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(frequent, pa.string())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in _pieces(sizes, GROUP_TOKENS, GROUP_DOCS):
                dl, ids = sizes[start:end], batch["doc_id"].slice(start, end - start).to_numpy(zero_copy_only=False)
                words = batch["tokens"].slice(start, end - start).flatten().dictionary_encode()
                order = np.argsort(ids, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                of_doc, of_place = len(order).bit_length(), int(dl.max(initial=0)).bit_length()
                key = (np.repeat(rank, dl) << of_place) | (np.arange(dl.sum()) - np.repeat(_before(dl), dl))
                if words.null_count:
                    key = key[words.indices.is_valid().to_numpy(zero_copy_only=False)]
                code = words.indices.drop_null().to_numpy().astype(np.int64)
                if not len(code):
                    continue
                key = np.sort((code << (of_doc + of_place)) | key)
                posting = key >> of_place
                first = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]]))
                doc = order[posting[first] & ((1 << of_doc) - 1)]
                tf = np.diff(np.append(first, len(key)))
                key &= (1 << of_place) - 1
                yield from _packed(words.dictionary, posting[first] >> of_doc, ids[doc], tf, dl[doc], key, listed)

    return docs.select("doc_id", "tokens").mapInArrow(run, PACKED)


def packed_rows(postings: DataFrame, frequent: list[str]) -> DataFrame:
    """``PACKED`` rows of postings (term, doc_id, tf, dl, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(frequent, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            words, ids = batch["term"].dictionary_encode(), batch["doc_id"].to_numpy()
            code = words.indices.to_numpy().astype(np.int64)
            order = np.lexsort((ids, code))
            places = batch["positions"].take(pa.array(order)).flatten().to_numpy().astype(np.int64)
            tf, dl = (batch[c].to_numpy().astype(np.int64)[order] for c in ("tf", "dl"))
            yield from _packed(words.dictionary, code[order], ids[order], tf, dl, places, listed)

    return postings.select("term", "doc_id", "tf", "dl", "positions").mapInArrow(run, PACKED)


def _blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``GATHERED`` rows of packed rows that are sorted by (bucket, term)."""
    packed, term = rows["packed"], rows["term"]
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    values, ends = _values(np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    starts = np.searchsorted(ends, offsets - offsets[0], "right")
    own, starts = np.diff(starts), starts[:-1]
    n = values[starts].astype(np.int64)
    row, at = _before(n), _runs(starts + 1, n)
    step, dl = values[at].view(np.int64), values[at + np.repeat(n, n)].astype(np.int64)
    many, dl = (dl & 1).astype(bool), dl >> 1
    k, tf = np.add.reduceat(many.astype(np.int64), row), np.ones(len(dl), np.int64)
    tf[many] = values[_runs(starts + 1 + 2 * n, k)]
    hop = values[_runs(starts + 1 + 2 * n + k, own - 1 - 2 * n - k)].astype(np.int64)
    total = np.cumsum(step)
    doc_id = total + np.repeat(rows["first"].to_numpy() - total[row], n)
    total, first = np.cumsum(hop), _before(tf)
    places = total - np.repeat(total[first] - hop[first], tf)
    number = np.cumsum(np.concatenate([[0], pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)]))
    line = np.repeat(np.arange(len(n)), n)
    code = number[line]
    if ((code[1:] == code[:-1]) & (doc_id[1:] < doc_id[:-1])).any():
        order = np.lexsort((doc_id, code))
        line, code, doc_id, tf, dl, first = (x[order] for x in (line, code, doc_id, tf, dl, first))
        places = places[np.repeat(first - _before(tf), tf) + np.arange(tf.sum())]
    block = doc_id // BLOCK
    begins = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))
    bounds = np.append(begins, len(code)).astype(np.int32)
    lists = [pa.array(x.astype(np.int32)) for x in (doc_id - block * BLOCK, tf, dl)]
    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(places.astype(np.int32))))
    at = pa.array(line[begins])
    return pa.RecordBatch.from_arrays(
        [
            rows["bucket"].take(at), term.take(at), pa.array(block[begins]), pa.array(np.diff(bounds)),
            *[pa.ListArray.from_arrays(pa.array(bounds), values) for values in lists],
            pa.array(np.maximum.reduceat(tf, begins).astype(np.int32)), pa.array(np.minimum.reduceat(dl, begins).astype(np.int32)),
        ],
        names=[*"bucket term block n offsets tfs dls positions max_tf min_dl".split()],
    )


def gather_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`block_postings` of rows (bucket, term, first, packed) that a task has sorted by these.

    The rows of a term are opened together, up to ``TERM_BYTES``; a block that goes on beyond that becomes two rows
    with documents of their own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.binary_length(batch["packed"]).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, end in _pieces(sizes, OPEN_BYTES):
            piece, term = batch.slice(start, end - start), batch["term"][end - 1].as_py()
            # The last term of a piece may go on in the next one.
            same = pc.equal(piece["term"], term).to_numpy(zero_copy_only=False)
            last = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
            if held and (last or held[-1]["term"][-1].as_py() != term or size > TERM_BYTES):
                yield _blocks(_joined([*held, piece.slice(0, last)]))
                held, size = [], 0
            elif last:
                yield _blocks(piece.slice(0, last))
            held.append(piece.slice(last))
            size += int(sizes[start + last : end].sum())
    if held:
        yield _blocks(_joined(held))


def _joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([b for b in rows if b.num_rows])


GATHERED = (
    "bucket int, term string, block long, n int, offsets array<int>, tfs array<int>, dls array<int>, "
    "positions array<array<int>>, max_tf int, min_dl int"
)


def block_rows(blocks: DataFrame, positions: bool = True, block: bool = False) -> DataFrame:
    """One row per document again, in the place of the lists. Lists that are not used are not read. ``block`` stays if asked."""
    lists = {"offsets", "tfs", "dls", "positions", "n", "max_tf", "min_dl"} | (set() if block else {"block"})
    rows = blocks.select("*", F.posexplode("offsets").alias("_i", "_offset"))
    columns = [id_of("block", "_offset").alias("doc_id"), F.get("tfs", "_i").alias("tf"), F.get("dls", "_i").alias("dl")]
    columns += [F.get("positions", "_i").alias("positions")] if positions else []
    return rows.select(*[c for c in blocks.columns if c not in lists], *columns)


def doc_frequency(postings: DataFrame) -> DataFrame:
    """``(term, df)``; partial counts combine before the shuffle."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_bounds(blocks: DataFrame) -> DataFrame:
    """``(term, df, max_tf, min_dl)`` from posting blocks."""
    return blocks.groupBy("term").agg(
        F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
    )


def term_bucket(term: Column | str, buckets: int) -> Column:
    term = F.col(term) if isinstance(term, str) else term
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

