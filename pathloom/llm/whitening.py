"""Embedding whitening from exact, bit-sliced cross-products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import saved

#: Units of one, rows per block of bit planes, bits per limb of an exact sum.
SCALE, BLOCK, LIMB, LIMBS = 256, 8192, 40, 5
#: An eigenvalue below this share of the largest one (times the dimensions) is rounding, not variance.
NOISE = 2.0**-48
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What the fit list of one vector length gives. ``axes`` holds a component per row."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None


def levels(vector: str | Column) -> Column:
    """floor(256 * c) of each entry as a long array; null for a vector with a null, NaN or infinite entry.

    Entries whose level does not fit a long get the nearest long.
    """
    vector = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c * SCALE)))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each vector length among the non-null rows of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    for size in np.unique(sizes[rows]):
        of_size = rows[sizes[rows] == size]
        yield of_size, flat[ends[of_size][:, None] + np.arange(size)].astype(np.int64, copy=False)


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lows, words, dimension of each plane, bit of each plane) of a block.

    Each dimension is shifted by its least value, so it has as many planes as its range has bits. Bit
    ``b`` of a dimension over 64 rows is one word.
    """
    n, d = x.shape
    lows = x.min(axis=0)
    shifted = x.view(np.uint64) - lows.view(np.uint64)  # exact modulo 2^64
    bits = [int(v).bit_length() for v in shifted.max(axis=0)]
    owner = np.repeat(np.arange(d), bits)
    bit = np.concatenate([np.arange(b) for b in bits] or [np.empty(0, np.int64)]).astype(np.int64)
    words = np.zeros((len(owner), -(-n // 64)), np.uint64)
    for p, (j, b) in enumerate(zip(owner, bit)):
        packed = np.packbits((shifted[:, j] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
        words.view(np.uint8)[p, : len(packed)] = packed
    return lows, words, owner, bit


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the columns of a block as Python integers, from weighted AND-popcounts."""
    n, d = x.shape
    lows, words, owner, bit = planes(x)
    low = lows.astype(object)
    ones = np.bitwise_count(words).sum(axis=1).astype(np.int64)
    part = np.zeros(d, object)
    np.add.at(part, owner, ones.astype(object) * (1 << bit.astype(object)))
    raw = np.zeros((d, d), object)
    # Counts weighted by one of the two bits fit a long unless ranges are extreme.
    wide = len(bit) > 0 and int(bit.max()) + int(n).bit_length() + 2 > 62
    weight = (1 << bit.astype(object)) if wide else (np.int64(1) << bit)
    for p in range(len(owner)):
        counts = np.bitwise_count(words[p:] & words[p]).sum(axis=1).astype(np.int64)
        terms = (counts.astype(object) if wide else counts) * weight[p:]
        row = np.zeros(d, object if wide else np.int64)
        np.add.at(row, owner[p:], terms)
        own = owner[p]
        # A plane meets later planes only: the missing half of its own dimension is the mirror of this one.
        row[own] = 2 * row[own] - (terms[0] if wide else int(terms[0]))
        raw[own] += row.astype(object) * (1 << int(bit[p]))
    upper = np.triu(raw, 1)
    shifted = upper + upper.T + np.diag(np.diag(raw))
    sums = part + n * low
    cross = shifted + np.outer(low, part) + np.outer(part, low) + n * np.outer(low, low)
    return sums, cross


SCATTER = "size int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _limbs(value: int) -> list[int]:
    """Signed base 2^40 digits; those of many tasks add up in longs without overflow."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, i, j, limbs): counts at (-1, -1), sums at (-1, j), cross-products at i <= j."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            d = x.shape[1]
            for a in range(0, len(x), BLOCK):
                sums, cross = cross_products(x[a : a + BLOCK])
                kept = totals.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                kept[0] += len(x[a : a + BLOCK])
                kept[1] += sums
                kept[2] += cross
    for d, (n, sums, cross) in totals.items():
        keys, values = [(-1, -1)], [n]
        keys += [(-1, j) for j in range(d)]
        values += list(sums)
        for i in range(d):
            keys += [(i, j) for j in range(i, d)]
            values += list(cross[i, i:])
        columns = [pa.array([d] * len(keys), pa.int32())]
        columns += [pa.array([k[c] for k in keys], pa.int32()) for c in (0, 1)]
        limbs = [_limbs(int(v)) for v in values]
        columns += [pa.array([v[k] for v in limbs], pa.int64()) for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "i", "j", *[f"l{k}" for k in range(LIMBS)]])


def decompose(n: int, sums: list[int], cross: np.ndarray, components: int) -> Whitening:
    """Centre exact totals as integers, then find the leading eigenvectors of the covariance."""
    d = len(sums)
    centred = n * cross - np.outer(np.array(sums, object), np.array(sums, object))
    square = n * n
    # Quotients of integers are rounded once, whatever their size.
    covariance = np.array([[int(v) / square for v in row] for row in centred], float).reshape(d, d)
    trace = sum(int(centred[i, i]) for i in range(d)) / square
    top = float(np.abs(covariance).max()) if d else 0.0
    unit = top or 1.0
    values, vectors = np.linalg.eigh(covariance / unit) if d else (np.empty(0), np.empty((0, 0)))
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, axes = values[order], vectors[:, order].T
    values = np.where(values > NOISE * max(d, 1) * max(float(values.max(initial=0.0)), 0.0), values, 0.0)
    # Either sign is right; this one makes repeated fits equal.
    lead = np.argmax(np.abs(axes), axis=1) if len(axes) else np.empty(0, int)
    axes = axes * np.where(axes[np.arange(len(axes)), lead] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, [int(s) for s in sums], axes, values * unit, trace)


def _project(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
    """(whitened values, squared distances from n times the mean) of a matrix of levels.

    A component without variance gives NaN; a distance above the largest long gives None.
    """
    n, d = model.n, x.shape[1]
    reach = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) * n + max(map(abs, model.sums), default=0)
    if reach * reach * max(d, 1) < SAFE:
        away = x * np.int64(n) - np.array(model.sums, np.int64)
        far: list = (away * away).sum(axis=1).tolist()
        away = away.astype(float)
    else:
        exact = x.astype(object) * n - np.array(model.sums, object)
        far = [int(sum(v * v for v in row)) for row in exact]
        far = [v if v < 1 << 63 else None for v in far]
        away = np.array([[int(v) / n for v in row] for row in exact], float).reshape(x.shape) * n
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (away / n) @ model.axes.T / np.sqrt(model.variances)
    return np.where(model.variances > 0, out, np.nan), far


def fit(df: DataFrame, vector: str = "embedding", components: int = 4) -> dict[int, Whitening]:
    """A :class:`Whitening` per vector length, over each distinct vector of levels once.

    Vectors of different lengths have no common covariance and are fitted apart. The distinct
    vectors are grouped before and after a shuffle, so copies cost nothing, and are written once. A
    task turns blocks of them into bit planes and sends one number per pair of dimensions, whatever
    its rows: the driver gets (dimensions squared) / 2 rows a length. ``identity_error`` is measured
    on the whitened fit list, null where no component has variance. Null, empty and unusable vectors
    do not count; no usable vector gives no entry.
    """
    listed = df.select(levels(vector).alias("x")).where("size(x) > 0").distinct()
    listed = saved(listed, "fit-list")
    sums = [F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]
    found: dict[int, dict[tuple[int, int], int]] = {}
    for row in listed.mapInArrow(_scatter, SCATTER).groupBy("size", "i", "j").agg(*sums).collect():
        value = sum(row[f"l{k}"] << (LIMB * k) for k in range(LIMBS))
        found.setdefault(row["size"], {})[row["i"], row["j"]] = value
    models = {}
    for d, values in found.items():
        cross = np.array([[values[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
        models[d] = decompose(values[-1, -1], [values[-1, j] for j in range(d)], cross, components)
    return _with_error(listed, models)


def _with_error(listed: DataFrame, models: dict[int, Whitening]) -> dict[int, Whitening]:
    """Measure how far the covariance of the whitened fit list is from the identity, by length."""
    if not models:
        return models
    width = max(len(m.variances) for m in models.values())
    w = [F.get("w", F.lit(a)) for a in range(width)]
    pairs = [(a, b) for a in range(width) for b in range(a, width)]
    whitened = listed.select(F.size("x").alias("size"), _apply(models)(F.col("x"))["whitened"].alias("w"))
    # covar_pop centres each value before it multiplies.
    spread = whitened.groupBy("size").agg(*[F.covar_pop(w[a], w[b]).alias(f"c{a}_{b}") for a, b in pairs])
    out = dict(models)
    for row in spread.collect():
        model = models[row["size"]]
        used = [a for a in range(len(model.variances)) if model.variances[a] > 0]
        errors = [abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs if a in used and b in used]
        out[row["size"]] = Whitening(model.n, model.sums, model.axes, model.variances, model.trace, max(errors, default=None))
    return out


WHITENED = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def _apply(models: dict[int, Whitening]):
    """A column function from level vectors to ``WHITENED``, with null fields for a length that was not fitted."""

    @F.pandas_udf(WHITENED)
    def whitened(x: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None, None, None, None)] * len(x)
        for rows, matrix in _matrices(pa.array(x, pa.list_(pa.int64()), from_pandas=True)):
            model = models.get(matrix.shape[1])
            if model is None:
                continue
            values, far = _project(model, matrix)
            share = [float(v) / model.trace for v in model.variances] if model.trace else [None] * len(model.variances)
            for k, row in enumerate(rows):
                w = [None if v != v else v for v in values[k].tolist()]
                out[row] = (model.n, far[k], w, share, model.identity_error)
        frame = pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained", "identity_error"], dtype=object)
        for name in ("n", "deviation"):
            frame[name] = frame[name].astype("Int64")
        return frame

    return whitened


def whiten(df: DataFrame, models: dict[int, Whitening], vector: str = "embedding", name: str = "whitening") -> DataFrame:
    """Usable rows of ``df``, all columns, plus the struct ``name`` (``WHITENED``); an own column of that name is replaced.

    Rows whose vector is null or has a null, NaN or infinite entry go. Equal vectors get equal
    values, repeated ids stay as rows of their own. An empty vector, or one of a length that was not
    fitted, stays with null fields. ``whitened`` has a null for a component without variance (one
    distinct vector, or fewer independent directions than components); ``explained`` is null where
    nothing varies. ``deviation`` is null where the exact number exceeds a long.
    """
    kept = df.where(levels(vector).isNotNull())
    if not models:
        return kept.withColumn(name, F.from_json(F.lit(None).cast("string"), WHITENED))
    return kept.withColumn(name, _apply(models)(levels(vector)))


def components(df: DataFrame, vector: str = "embedding", most: int = 4, id_column: str = "vec_id") -> DataFrame:
    """One row per usable vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    rows = whiten(df.select(F.col(id_column).alias("_id"), F.col(vector).alias("_v")), fit(df, vector, most), "_v", "_w")
    pairs = F.arrays_zip(F.col("_w.whitened").alias("whitened"), F.col("_w.explained").alias("explained"))
    each = rows.select("_id", "_w.n", "_w.deviation", "_w.identity_error", F.posexplode(pairs).alias("component", "pair"))
    return each.select(
        F.col("_id").alias(id_column), (F.col("component") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"), "identity_error",
    )
