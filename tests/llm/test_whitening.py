"""Whitening against the covariance's own eigenvectors."""

import math

import numpy as np
import pytest

from corpusledger.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, _id int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 0, "x", 1, 2) for i, v in rows], SCHEMA)


def usable(rows, dim):
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(np.float32(c)) for c in v)]


def check(found, rows, dim, most):
    x = usable(rows, dim)
    fit = np.array(sorted({tuple(v) for _, v in x}))
    n, sums = len(fit), [sum(int(c) for c in fit[:, j]) for j in range(dim)]
    centred = fit - np.array([s / n for s in sums])
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:most], parts[:, ::-1][:, :most]
    trace = (centred**2).sum() / n
    assert len(found) == len(x) * len(values)
    turned = {}
    for i, v in x:
        mine = sorted([r for r in found if r["vec_id"] == i and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))], key=lambda r: r["component"])
        assert mine and {r["component"] for r in mine} == set(range(1, len(values) + 1)) and all(r["n"] == n for r in mine)
        for r in mine:
            k = r["component"] - 1
            if values[k] > 1e-12 * values[0]:
                want = (np.array(v) - [s / n for s in sums]) @ parts[:, k] / math.sqrt(values[k])
                sign = turned.setdefault(k, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-6 else turned.get(k, 1)
                assert abs(sign * want - r["whitened"]) < 1e-7 * max(1, abs(want)) and abs(r["explained"] * trace / values[k] - 1) < 1e-9
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("scale", [1, 1000])
def test_whitening(spark, scale):
    pick = np.random.default_rng(2)
    given = [(i, (pick.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.1] * scale + 7).tolist()) for i in range(80)]
    odd = [(100, None), (101, []), (102, [1.0] * 5 + [float("nan")]), (103, [float("inf")] * 6), (104, [None] + [1.0] * 5), (105, [1.0, 2.0]), (106, given[0][1]), (7, given[7][1]), (None, given[3][1])]
    check(whitening.whiten(vectors(spark, given + odd), 4).collect(), given + odd, 6, 4)


def test_hot_vector_counts_once(spark):
    pick = np.random.default_rng(3)
    given = [(i, pick.standard_normal(3).tolist()) for i in range(30)] + [(100 + i, [1.0, -2.0, 0.5]) for i in range(60)]
    out = whitening.whiten(vectors(spark, given)).collect()
    assert {r["n"] for r in out} == {31} and len(out) == 90 * 3
    check(out, given, 3, 3)


def test_ill_conditioned(spark):
    """Singular values from 1e9 down to 1: one Cholesky factor of the Gram matrix would not have them."""
    pick = np.random.default_rng(4)
    base = np.linalg.qr(pick.standard_normal((5, 5)))[0]
    x = np.rint(pick.standard_normal((400, 5)) * [1e9, 1e7, 1e5, 1e3, 20] @ base).astype(np.int64)
    found = whitening.fit(spark.createDataFrame([(r.tolist(),) for r in x], "_x array<long>"), 5)
    singular = np.linalg.svd((x - x.mean(0)).astype(float), compute_uv=False)
    assert np.allclose(np.sqrt(found.eigenvalues * 400), singular, rtol=1e-6) and found.identity_error < 1e-4


def test_without_full_rank(spark):
    given = [(i, [float(i), 2.0 * i, 5.0, float(i * i)]) for i in range(20)]
    out = whitening.whiten(vectors(spark, given)).collect()
    empty = [r for r in out if r["whitened"] is None]
    assert {r["component"] for r in empty} == {3, 4} and all(r["explained"] == 0 for r in empty) and {r["identity_error"] for r in out}.pop() < 1e-9
    check(out, given, 4, 4)


def test_few_rows(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    for given in ([], [(1, None), (2, [])]):
        assert whitening.whiten(vectors(spark, given), 4).count() == 0
    out = whitening.whiten(vectors(spark, [(1, [-0.001]), (2, [0.001]), (3, [0.0])])).collect()
    assert {r["n"] for r in out} == {2} and {r["deviation"] for r in out} == {1}


def test_deviations_are_exact():
    x = np.array([[3_000_000_001, -5], [7, 9]])
    want = [sum((1000 * int(c) - s) ** 2 for c, s in zip(row, (12345, -6789), strict=True)) for row in x]
    with pytest.raises(OverflowError):
        whitening.deviations(x, 1000, [12345, -6789])
    assert want[0] > 1 << 63
    x = np.array([[30_000_001, -5], [7, 9]])
    assert whitening.deviations(x, 100, [12345, -6789]).tolist() == [sum((100 * int(c) - s) ** 2 for c, s in zip(row, (12345, -6789), strict=True)) for row in x]
