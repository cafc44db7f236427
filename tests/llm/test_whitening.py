import math
import random

import numpy as np
import pytest

from orderweave.llm.whitening import COMPONENTS, squared_deviation, whitened
from tests.llm.conftest import SF


def grid(vector):
    return [math.floor(1024 * float(c)) + 100_000 for c in vector]


def check(rows, got, counts=True):
    """``got`` against plain whole-number sums and one dense decomposition of all rows."""
    kept = [(i, grid(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if counts else [list(x) for x in {tuple(x) for _, x in kept}]
    n, dim = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(dim)]
    xc = np.array(fit, float) - np.array([t / n for t in s])
    e, u = np.linalg.eigh(xc.T @ xc / n)
    e, u = e[::-1][:COMPONENTS], u[:, ::-1][:, :COMPONENTS]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(kept) * min(dim, COMPONENTS) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    signs = None
    for i, x in kept:
        own = [by[i][k + 1] for k in range(min(dim, COMPONENTS))]
        assert {r.deviation for r in own} == {sum((n * a - t) ** 2 for a, t in zip(x, s))}
        want = (np.array(x) - np.array([t / n for t in s])) @ u / np.sqrt(e)
        z = np.array([r.whitened for r in own])
        if signs is None:
            signs = np.sign(z * want)
        assert np.allclose(z, want * signs, rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in own], e / (xc**2).sum() * n, rtol=1e-9)


@pytest.mark.parametrize("counts", [True, False])
def test_against_a_dense_decomposition(spark, counts):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # a third of all rows are copies
    rows += [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    frame = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, weight int")
    check(rows, whitened(frame.repartition(4), counts=counts).collect(), counts)


def test_whole_table(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in frame.collect()], whitened(frame).collect())


def test_hot_vector_is_spread(spark, monkeypatch):
    monkeypatch.setattr("orderweave.operators.scan.HOT_ROWS", 5)
    rows = [(i, [float(i % 7 if i % 3 else 0), float(i % 11 if i % 3 else 0)]) for i in range(120)]
    check(rows, whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())


def test_odd_vectors(spark):
    rows = [(None, [1.0, 2.0]), (7, [1.0, 5.0]), (7, [3.0, 2.0]), (8, [1e300, -1e300]), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert all(r.n == 4 and r.deviation > 0 for r in got)


def test_no_variance_and_no_rows(spark):
    got = whitened(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9
    one = whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 2
    none = whitened(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and none.columns == whitened(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).columns


def test_exact_squares():
    rng = random.Random(5)
    for n, most in ((10, 100), (10**7, 10**6), (10**9, 2**30), (10**12, 2**50)):
        x = [[rng.randrange(-most, most) for _ in range(5)] for _ in range(20)]
        s = [rng.randrange(-most, most) * n // 2 for _ in range(5)]
        assert squared_deviation(np.array(x), n, s) == [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x]
