import math
import random

import numpy as np
import pytest

from flowlens.llm import whitening as op


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    return n, dev, (x - s / n) @ basis / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True).reshape(x.shape[1], -1))


@pytest.mark.parametrize("kind", ["random", "decaying", "repeated", "integers", "one zero"])
def test_eigenvectors(kind):
    """Against numpy: eigenvalues, orthogonality, and each pair; shifts that fall onto eigenvalues, equal eigenvalues."""
    r = np.random.default_rng(3)
    n = 40
    q, _ = np.linalg.qr(r.standard_normal((n, n)))
    values = {"random": r.random(n), "decaying": 0.5 ** np.arange(n), "repeated": np.repeat([5.0, 3.0, 1.0, 0.5], 10), "integers": np.arange(n) - 0.0, "one zero": np.r_[1.0, np.zeros(n - 1)]}[kind]
    a = (q * values) @ q.T
    got, basis = op.leading((a + a.T) / 2, 8)
    assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-13 * n)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-12)
    assert np.allclose(a @ basis, basis * got, atol=1e-12 * n)


def test_polar():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.allclose(op.polar(a), (q * np.sign(w)) @ q.T, atol=1e-11)


def test_against_brute_force(spark):
    r = random.Random(1)
    good = [(i, [r.gauss(0, 1) * 0.7**k + 0.3 for k in range(12)]) for i in range(400)]
    good += [good[3], (None, good[4][1])]
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as w", "2 as v", "3 as n").repartition(7)
    rows = op.whiten(df).collect()
    n, dev, white, explained = brute([v for _, v in good])
    assert len(rows) == 8 * len(good) and {r.component for r in rows} == set(range(1, 9)) and rows[0].identity_error < 1e-9
    at = {}
    for r in rows:
        if r.vec_id is not None and r.vec_id != 3:
            at[r.vec_id, r.component] = r
    for k in range(8):
        mine = np.array([at[i, k + 1].whitened for i in range(400) if i != 3])
        theirs = np.array([white[i, k] for i in range(400) if i != 3])
        assert np.allclose(mine, theirs * np.sign(mine[0] * theirs[0]), atol=1e-7)
        assert all(at[i, k + 1].deviation == dev[i] and at[i, k + 1].n == n and abs(at[i, k + 1].explained - explained[k]) < 1e-9 for i in range(400) if i != 3)
    assert sum(r.vec_id is None for r in rows) == 8 and sum(r.vec_id == 3 for r in rows) == 16


def test_edges(spark):
    """No rows, one row, equal rows, fewer vectors than components, one dimension, huge entries."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert op.whiten(make([])).count() == 0 and op.whiten(make([(1, None)])).count() == 0
    assert op.whiten(make([(1, [1.0, 2.0])])).count() == 0 and op.whiten(make([(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    few = op.whiten(make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 2.0, 1.0])])).collect()
    assert len(few) == 6 and few[0].identity_error < 1e-9
    line = {r.vec_id: r.whitened for r in op.whiten(make([(1, [0.0]), (2, [1.0])])).collect()}
    assert sorted(line.values()) == [-1.0, 1.0]
    huge = op.whiten(make([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 1e6])])).collect()
    assert huge and all(r.deviation is None or r.deviation >= 0 for r in huge) and any(r.deviation is None for r in huge)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    n, dev, _, explained = brute([r.embedding for r in rows])
    out = {(r.vec_id, r.component): r for r in op.whiten(df).collect()}
    assert all(out[r.vec_id, 1].deviation == d and out[r.vec_id, 1].n == n for r, d in zip(rows, dev))
    assert all(abs(out[rows[0].vec_id, k + 1].explained / explained[k] - 1) < 1e-9 for k in range(8)) and out[rows[0].vec_id, 1].identity_error < 1e-9
