"""Whitening against plain integer arithmetic, and odd vectors."""

import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import queries, whitening


def brute(vectors):
    """(n, sums, exact covariance) of the distinct level vectors."""
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x), n**3) for j in range(d)] for i in range(d)]
    return n, sums, cov, x


@pytest.mark.parametrize("n, d, low, high", [(1, 1, 0, 0), (63, 3, -5, 5), (64, 2, -1, 0), (130, 5, -300, 9000), (20, 2, -(1 << 63), (1 << 63) - 1), (5, 3, 1 << 40, 1 << 41)])
def test_popcounts_are_the_cross_products(n, d, low, high):
    rng = random.Random(n)
    x = [[rng.randint(low, high) for _ in range(d)] for _ in range(n)]
    sums, cross = whitening.cross_products(np.array(x, np.int64))
    assert list(sums) == [sum(r[j] for r in x) for j in range(d)]
    assert cross.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


def test_limbs_add_up_to_the_number():
    for value in (0, -1, 5, -(1 << 150), (1 << 126) + 12345, -(1 << 40)):
        limbs = whitening._limbs(value)
        assert sum(v << (whitening.LIMB * k) for k, v in enumerate(limbs)) == value


def test_blocks_and_tasks_do_not_change_the_totals(frame, monkeypatch):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 0.2) for _ in range(6)] for _ in range(300)]
    vectors += vectors[:100] + [vectors[0]] * 200  # a third of the rows is one vector
    df = frame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    floats = [r[0] for r in df.select("embedding").collect()]
    n, sums, cov, _ = brute(floats)
    for block in (8192, 64, 7):
        monkeypatch.setattr(whitening, "BLOCK", block)
        model = whitening.fit(df)[6]
        assert (model.n, model.sums) == (n, sums)
        exact = np.array([[float(v) for v in row] for row in cov])
        values, _ = np.linalg.eigh(exact)
        assert np.allclose(model.variances, values[::-1][:4], rtol=1e-12)
        for axis, value in zip(model.axes, model.variances):
            assert abs(np.linalg.norm(axis) - 1) < 1e-12
            assert np.abs(exact @ axis - value * axis).max() < 1e-9 * values[-1]


def test_rows_are_what_brute_force_gives(frame):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, s) for s in (0.5, 0.1, 2.0, 0.3, 0.05)] for _ in range(90)]
    vectors += [vectors[3], None, [0.1, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], []]
    rows = [(i, v, "own") for i, v in enumerate(vectors)] + [(7, vectors[7], None), (None, vectors[8], "x")]
    df = frame(rows, "vec_id long, embedding array<double>, whitening string")
    out = whitening.components(df).collect()
    n, sums, cov, fit = brute(vectors[:90])
    trace = float(sum(cov[i][i] for i in range(5)))
    values = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))[0][::-1]
    assert len(out) == (91 + 2) * 4
    assert {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    assert out[0].identity_error < 1e-9
    signs = {}
    model = whitening.fit(df)[5]
    for r in out:
        v = vectors[8] if r.vec_id is None else vectors[r.vec_id]
        x = [math.floor(256 * c) for c in v]
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        w = sum((a - s / n) * e for a, s, e in zip(x, sums, model.axes[r.component - 1])) / math.sqrt(values[r.component - 1])
        signs.setdefault(r.component, set()).add(round(w - r.whitened, 9) == 0)
    assert all(s == {True} for s in signs.values())
    kept = whitening.whiten(df, {5: model})
    assert kept.columns == df.columns and kept.count() == 94  # the empty vector stays, without values
    assert kept.where("whitening.n is null").select("embedding").first()[0] == []


def test_directions_without_variance_and_vectors_of_other_lengths(frame):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.5, 2.0, 3.0]), (3, [0.5]), (4, [0.5])]
    out = {(r.vec_id, r.component): r for r in whitening.components(frame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(out) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1)}
    assert abs(out[1, 1].whitened) == pytest.approx(1) and out[1, 1].whitened == -out[2, 1].whitened
    assert out[1, 2].whitened is None and out[1, 2].explained == 0
    assert out[1, 1].explained == 1 and out[1, 1].identity_error == pytest.approx(0, abs=1e-12)
    assert (out[3, 1].n, out[3, 1].deviation, out[3, 1].whitened, out[3, 1].explained, out[3, 1].identity_error) == (1, 0, None, None, None)


def test_levels_beyond_a_long(frame):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    out = {(r.vec_id, r.component): r for r in whitening.components(frame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out[1, 1].deviation is None  # exact, but above a long
    assert out[1, 1].identity_error < 1e-4


def test_empty_tables(frame, spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.fit(df) == {}
        out = whitening.components(df)
        assert out.count() == 0 and out.columns[1] == "component"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_query_returns_four_rows_of_each_vector(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").where("embedding IS NOT NULL").count()
    rows = queries.QUERIES["op11_embedding_whitening"](spark, sf).select("vec_id", "component").collect()
    assert vectors and len(rows) == len(set(rows)) == 4 * vectors
    assert {r.component for r in rows} == {1, 2, 3, 4}
