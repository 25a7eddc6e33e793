"""Whitening against dense linear algebra on the same whole numbers."""

import math

import numpy as np
import pytest

from signalsieve.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x int, j int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1) for i, v in rows], SCHEMA).repartition(3)


def cloud(rows, length, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((rows, length)) * (1.3 ** -np.arange(length)) + 0.5).astype(np.float32)


def dense(vectors, k):
    """Eigenvalues, trace and whitened rows (up to their signs) of all rows, from the full matrix of the distinct ones."""
    x = np.floor(256 * np.asarray(vectors, float))
    fit = np.unique(x, axis=0)
    centre = fit.mean(0)
    values, axes = np.linalg.eigh((fit - centre).T @ (fit - centre) / len(fit))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    total = ((fit - centre) ** 2).sum() / len(fit)
    deviation = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(r, fit.sum(0))) for r in x]
    return len(fit), values, total, (x - centre) @ axes / np.sqrt(values), deviation


def by_row(df):
    out = {}
    for r in df.collect():
        assert (r.vec_id, r.component) not in out
        out[r.vec_id, r.component] = r
    return out


@pytest.mark.parametrize("length, k", [(24, 4), (70, 4), (3, 4), (12, 2)])
def test_against_dense(spark, length, k):
    vectors = cloud(300, length)
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 150, 0)])  # a third is one vector
    found = by_row(whitening.whitened(table(spark, list(enumerate(vectors.tolist()))), k))
    n, values, total, white, deviation = dense(vectors, k)
    assert len(found) == len(vectors) * min(k, length)
    signs = [np.sign(white[:, c] @ [found[i, c + 1].whitened for i in range(len(vectors))]) for c in range(len(values))]
    for (i, c), r in found.items():
        assert r.n == n and r.deviation == deviation[i]
        assert r.whitened == pytest.approx(signs[c - 1] * white[i, c - 1], abs=1e-7)
        assert r.explained == pytest.approx(values[c - 1] / total, rel=1e-10)
        assert 0 <= r.identity_error < 1e-10


def test_pairs_are_exact_to_double_precision():
    """Also with close, repeated and vanishing eigenvalues, and in spaces of any size."""
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 9, 30, 64, 200):
        axes = np.linalg.qr(rng.standard_normal((length, length)))[0]
        for values in (np.ones(length), 0.5 ** np.arange(length), np.linspace(1, 1.2, length), np.eye(length)[0],
                       np.repeat([5.0, 5.0, 1.0, 0.0], length)[:length]):
            a = (axes * values) @ axes.T
            e, v = whitening.leading_pairs(lambda d: a @ d, length, 4)
            k = min(4, length)
            assert np.abs(e - np.sort(values)[::-1][:k]).max() < 1e-13 * values.max()
            assert np.abs(v.T @ v - np.eye(k)).max() < 1e-13
            assert np.linalg.norm(a @ v - v * e, axis=0).max() < 1e-12 * values.max()


def test_no_more_than_blocks_of_directions(spark):
    """The covariance is only reached through products with a few directions."""
    seen = []
    a = np.diag(np.arange(1.0, 201.0))

    def product(d):
        seen.append(d.shape[1])
        return a @ d

    whitening.leading_pairs(product, 200, 4)
    assert max(seen) <= 4 + whitening.BLOCK


def test_odd_rows(spark):
    good = cloud(40, 6).tolist()
    odd = [(None, good[0]), (7, good[1]), (7, good[1]), (100, None), (101, []), (102, [1.0] * 5), (103, [None] * 6),
           (104, [math.nan, *good[0][1:]]), (105, [math.inf, *good[0][1:]]), (106, [3e38, *good[0][1:]])]
    found = whitening.whitened(table(spark, list(enumerate(good)) + odd)).groupBy("vec_id").count().collect()
    assert {r[0]: r[1] for r in found} == {i: 12 if i == 7 else 4 for i in [*range(40), None]}


def test_nothing_to_whiten(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None)])).count() == 0
    assert whitening.whitened(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]))
    assert {r.component for r in line.collect()} == {1}


def test_deviations_beyond_64_bits():
    moment = whitening.Moments(3, [2**40, 0], [0, 0])
    x = np.array([[2**30, 1], [0, 0]], np.int32)
    exact = [(3 * 2**30 - 2**40) ** 2 + 9, 2**80]
    assert whitening._deviations(x, moment) == [v if v < 2**63 else None for v in exact]
    small = whitening.Moments(2, [3, 5], [9, 17])
    assert whitening._deviations(np.array([[1, 4]], np.int32), small) == [1 + 9]
