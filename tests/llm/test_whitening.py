import math
from decimal import Decimal

import numpy as np
import pytest
from imgframe.llm import whitening as W
from imgframe.llm.whitening import fit_whitening, triangle, whitened_components
from pyspark.sql import functions as F


def plain(rows, k, scale, offset):
    """{vec_id: (deviation, whitened by component up to sign)}, shares of variance, from the covariance of exact differences."""
    good = [(i, [math.floor(scale * float(c)) + offset for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x) for x in zip(*(v for _, v in good), strict=True)]
    apart = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for _, v in good], object)
    y = apart.astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = y @ vectors[:, :k] / np.sqrt(values[:k])
    return {i: (int((a * a).sum()), z[j]) for j, ((i, _), a) in enumerate(zip(good, apart, strict=True))}, values[:k] / values.sum()


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_against_covariance(spark, monkeypatch, parts):
    monkeypatch.setattr(W, "FAN_IN", 3)
    monkeypatch.setattr(W, "STEP_ENTRIES", 100)
    rng = np.random.default_rng(parts)
    data = rng.normal(size=(300, 12)) * np.arange(1, 13) @ rng.normal(size=(12, 12)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [None, *data[0][1:].tolist()]), (902, [math.nan, *data[0][1:].tolist()]), (903, [math.inf, *data[0][1:].tolist()])]
    want, explained = plain(rows, 8, 1024, 100_000)
    out = whitened_components(frame_of(spark, rows).repartition(parts), F.col("embedding"), 8, 1024, 100_000).collect()
    assert len(out) == 300 * 8 and {r.n for r in out} == {300}
    assert max(r.identity_error for r in out) < 1e-9
    signs = {}
    for r in sorted(out, key=lambda r: r.vec_id):
        deviation, z = want[r.vec_id]
        w = z[r.component - 1]
        assert r.deviation == deviation
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-8
        sign = signs.setdefault(r.component, 1 if r.whitened * w > 0 else -1)
        assert abs(r.whitened - sign * w) < 1e-6


def test_small_variances_beside_a_large_one(spark):
    """Seven orders of magnitude between standard deviations: a covariance in doubles would lose the smallest."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 3)) * [1e9, 1e5, 30.0]
    out = whitened_components(frame_of(spark, [(i, v.tolist()) for i, v in enumerate(data)]), F.col("embedding")).collect()
    assert {r.component for r in out} == {1, 2, 3} and max(r.identity_error for r in out) < 1e-6


def test_cases(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (4, []), (5, [1.0]), (6, [1e300, 0.0]), (7, [5.0, 2.0])]
    out = whitened_components(frame_of(spark, rows), F.col("embedding")).collect()
    assert sorted((str(r.vec_id), r.component) for r in out) == sorted((str(i), c) for i in (1, 1, None, 7) for c in (1, 2))
    assert all((r.whitened is None) == (r.component == 2) for r in out)  # the second entry is the same in all
    assert {r.deviation for r in out} == {Decimal((4 * x - 10) ** 2) for x in (1, 3, 5)}
    for same in ([(1, [2.0, 2.0])], [(1, [2.0, 2.0]), (2, [2.0, 2.0])]):
        assert all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in whitened_components(frame_of(spark, same), F.col("embedding")).collect())
    for none in ([(1, None), (2, [math.nan])], []):
        assert not whitened_components(frame_of(spark, none), F.col("embedding")).collect()
    # past long numbers
    large = whitened_components(frame_of(spark, [(i, [float(x), 0.0]) for i, x in enumerate((4e15, -4e15, 1.0))]), F.col("embedding")).collect()
    total = 4 * 10**15 - 4 * 10**15 + 1
    assert {r.vec_id: int(r.deviation) for r in large} == {i: (3 * x - total) ** 2 for i, x in enumerate((4 * 10**15, -4 * 10**15, 1))}


def test_triangle():
    rows = np.random.default_rng(1).normal(size=(2, 5))
    r = triangle(rows)
    assert r.shape == (5, 5) and np.allclose(r.T @ r, rows.T @ rows)


def test_fit_is_the_same_for_any_partitions(spark):
    rows = frame_of(spark, [(i, [float(i % 7), float(i % 11), float(i % 13)]) for i in range(200)]).select("vec_id", F.col("embedding").alias("vector"))
    a, b = fit_whitening(rows.repartition(1), 3), fit_whitening(rows.repartition(9), 3)
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.variances, b.variances) and np.allclose(np.abs(a.components), np.abs(b.components))
