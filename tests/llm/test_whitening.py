import numpy as np
import pytest

from wavespan.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(4)


def by_hand(rows):
    x = {}
    for i, v in rows:
        c = np.array(v, dtype=np.float32).astype(float)
        x.setdefault(i, []).append([int(np.floor(64 * e)) + 1_000_000 for e in c])
    fit = np.array(sorted({tuple(v) for vs in x.values() for v in vs}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    values, vectors, trace = values[order], vectors[:, order], values.sum()
    return x, n, sums, values, vectors, trace


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 24)) * np.linspace(2, 0.3, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(300)] + [(None, base[3].tolist()), (5, base[9].tolist())]
    odd = [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23),
           (2003, [float("inf")] + [0.0] * 23), (2004, [])]
    x, n, sums, values, vectors, trace = by_hand(rows)
    out = whitening.whiten(frame(spark, rows + odd)).collect()
    assert len(out) == 16 * len(rows)
    sign = {}
    for r in out:
        k = r.component - 1
        assert r.n == n and r.explained == pytest.approx(values[k] / trace, rel=1e-9)
        assert 0 <= r.identity_error < 1e-8
        match = []
        for v in x[r.vec_id]:
            d = n * np.array(v, dtype=object) - sums
            w = float((d / n).astype(float) @ vectors[:, k] / np.sqrt(values[k]))
            if r.deviation == int((d * d).sum()) and abs(abs(r.whitened) - abs(w)) < 1e-6:
                match.append(w)
        assert match
        if abs(match[0]) > 1e-3:
            assert sign.setdefault(k, np.sign(match[0] * r.whitened)) == np.sign(match[0] * r.whitened)


def test_few_or_odd_vectors(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0])])).collect()
    assert {(r.vec_id, r.component, round(abs(r.whitened), 9)) for r in two} == {(1, 1, 1.0), (2, 1, 1.0)}
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and any(r.deviation is None for r in huge)


@pytest.mark.parametrize("spectrum", [
    np.arange(40, 0, -1.0), np.geomspace(1e6, 1e-6, 40), [5.0] * 6 + [1.0] * 34,
    [3.0, 3.0 - 1e-12, *[0.0] * 38], [7.0] * 40,
    np.random.default_rng(8).chisquare(900, 40), [9.0, 5.0, 5.0 - 1e-7, *np.linspace(4.9999, 4.99, 37)]])
def test_eigenpairs_are_certified(spectrum):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    v = (q * np.array(spectrum)) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading_eigenpairs(v)
    assert len(values) == min(16, int(np.sum(np.array(spectrum) > 0)))
    assert values == pytest.approx(np.sort(spectrum)[::-1][:len(values)], abs=1e-12 * max(spectrum) * 40)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * max(spectrum)


def test_counts_of_pivots():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    diagonal, off = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    for shift in (-20, -3, 0, 0.5, 4, 20):
        assert whitening.inertia(diagonal, off, shift, 1e-30) == (values > shift).sum()
