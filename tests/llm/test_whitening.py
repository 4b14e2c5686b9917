"""Whitening against a plain computation on all rows."""

import math

import numpy as np
import pytest

from curbside.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def rows_of(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "clash", "clash") for i, v in zip(ids, vectors)], SCHEMA)


def plain(vectors):
    """n, S, exact deviations, variances and axes by the definition."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    exact = x * n - sums
    a = (exact / n).astype(float)
    _, singular, axes = np.linalg.svd(a, full_matrices=False)
    return n, (exact**2).sum(axis=1), a, singular**2 / n, axes.T


def check(found, vectors, ids):
    n, deviations, a, values, axes = plain(vectors)
    width = max(r.component for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and all(set(c) == set(range(1, width + 1)) for c in by_id.values())
    white = np.array([[by_id[i][c + 1].whitened for c in range(width)] for i in ids])
    wanted = a @ axes[:, :width] / np.sqrt(values[:width])
    for c in range(width):
        sign = np.sign(white[:, c] @ wanted[:, c])
        assert np.allclose(white[:, c], sign * wanted[:, c], atol=1e-6)
    for k, i in enumerate(ids):
        assert by_id[i][1].n == n and by_id[i][1].deviation == (deviations[k] if deviations[k] < 2**63 else None)
    for c in range(width):
        assert by_id[ids[0]][c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    centred = white - white.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(width)).max()
    assert error < 1e-7 and abs(found[0].identity_error - error) < 1e-12
    return width


def test_query_against_plain(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = data.collect()
    found = whitening.op13_whitening(spark, "/root/testdata/sf0.001").collect()
    assert check(found, [r.embedding for r in rows], [r.vec_id for r in rows]) == 32


def test_badly_scaled(spark):
    """Variances over many orders of magnitude, and nearly dependent columns."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 6)) * np.array([3e4, 1e3, 30.0, 5.0, 1.0, 0.5])
    vectors = np.column_stack([base, base[:, 0] + rng.standard_normal(400), base[:, 1] * 2 + base[:, 4]]).astype(np.float32)
    found = whitening.whiten(rows_of(spark, vectors.tolist())).collect()
    assert check(found, vectors.tolist(), list(range(400))) == 8


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    good = rng.standard_normal((50, 4)).astype(np.float32).tolist()
    bad = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0, 0, 0]]
    frame = rows_of(spark, good + bad, list(range(50)) + [100, 101, 102, 103])
    found = whitening.whiten(frame).collect()
    assert check(found, good, list(range(50))) == 4
    repeated = whitening.whiten(frame.unionByName(rows_of(spark, good[:1], [0])).unionByName(rows_of(spark, good[1:2], [None]))).collect()
    assert sum(r.vec_id == 0 for r in repeated) == 8 and sum(r.vec_id is None for r in repeated) == 4 and repeated[0].n == 52


def test_degenerate(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, [None, []])).collect() == []
    assert whitening.whiten(rows_of(spark, [[1, 2]] * 5)).collect() == []
    assert whitening.whiten(rows_of(spark, [[1, 2]])).collect() == []
    # a constant and a doubled column: only the directions in which rows differ are components
    vectors = [[k, 7, 2 * k, (k * 37 % 11)] for k in range(40)]
    found = whitening.whiten(rows_of(spark, vectors)).collect()
    assert {r.component for r in found} == {1, 2}
    white = np.array(sorted((r.vec_id, r.component, r.whitened) for r in found))[:, 2].reshape(40, 2)
    assert np.abs(white.T @ white / 40 - np.eye(2)).max() < 1e-9 and found[0].identity_error < 1e-9
    # a short vector is zero beyond its end
    short = whitening.whiten(rows_of(spark, [[1, 5], [2], [], [3, 1]])).collect()
    full = whitening.whiten(rows_of(spark, [[1, 5], [2, 0], [0, 0], [3, 1]])).collect()
    assert sorted((r.vec_id, r.component, r.deviation, abs(round(r.whitened, 9))) for r in short) == sorted(
        (r.vec_id, r.component, r.deviation, abs(round(r.whitened, 9))) for r in full)


def test_huge_entries(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [0.0, 3.0], [5.0, 4.5]]
    found = whitening.whiten(rows_of(spark, vectors)).collect()
    assert len(found) in (4, 8) and all(r.deviation is None or r.deviation >= 0 for r in found)
