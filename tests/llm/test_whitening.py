"""Whitening against one matrix in numpy."""

import numpy as np
import pytest

from inkstream.llm.whitening import Moments, Whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, v string, component string"


def table(spark, vectors):
    rows = [(i, v, 0, 5, "k", "k") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_against_one_matrix(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(6, 6))
    v = (r.normal(size=(700, 6)) @ base).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(3, [float(c) for c in v[3]])] * 200
    odd = [(9001, None), (9002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (9003, [float("nan")] * 6), (9004, [float("inf")] * 6), (9005, []), (9006, [1.0, 2.0])]
    got = Whitening(components=4).whitened(table(spark, rows + odd)).toPandas()
    x = np.array([np.floor(64 * np.array(e)) + 1_000_000 for _, e in rows])
    n, sums = len(x), x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for c in range(4):
        mine = got[got.component == c + 1].drop_duplicates("vec_id").set_index("vec_id").sort_index()
        want = (x[:700] - sums / n) @ axes[:, c] / np.sqrt(values[c])
        sign = np.sign((mine.whitened.to_numpy() * want).sum())
        assert np.allclose(mine.whitened, sign * want, atol=1e-8)
        assert np.allclose(mine.explained, values[c] / np.trace(cov), rtol=1e-9)
        exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x[:700]]
        assert mine.deviation.tolist() == exact


def test_merging_equals_one_pass():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(300, 5)) * 50).astype(np.int64)
    parts = [Moments.of(p) for p in np.split(x, [1, 7, 150])]
    left = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    whole = Moments.of(x)
    assert left.n == 300 and left.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(left.covariance(), whole.covariance()) and np.allclose(left.covariance(), np.cov(x.T, bias=True))


@pytest.mark.parametrize(("vectors", "rows"), [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 2), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 4)])
def test_no_variance(spark, vectors, rows):
    got = Whitening().whitened(table(spark, vectors)).collect()
    assert len(got) == rows and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_a_direction_without_variance(spark):
    rows = [(i, [float(i % 5), float(i % 5), float(i % 3)]) for i in range(60)]
    got = Whitening().whitened(table(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component == 3) for r in got) and got[0].identity_error < 1e-9


def test_deviation_beyond_64_bits(spark):
    got = Whitening(scale=2**40).whitened(table(spark, [(1, [1.0, 0.5]), (2, [0.0, 2.0])])).collect()
    want = 2**80 + (2**39 * 3) ** 2
    assert want > 2**63 and all(r.deviation is None for r in got)
