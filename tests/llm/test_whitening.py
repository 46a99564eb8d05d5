"""Whitening against numpy's eigenvectors, and its iteration on matrices with repeated and vanishing eigenvalues."""

import numpy as np
import pytest

from brindle.llm import whitening


def by_numpy(vectors, k=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    v = (d / n).T @ (d / n) / n
    e, y = np.linalg.eigh(v)
    e, y = e[::-1][:k], y[:, ::-1][:, :k]
    return [sum(int(c) ** 2 for c in r) for r in d], (d / n) @ y / np.sqrt(e), e / np.trace(v)


def check(rows, vectors, k):
    deviations, white, shares = by_numpy(vectors, k)
    assert len(rows) == len(vectors) * k
    for r in rows:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == len(vectors) and int(r["deviation"]) == deviations[i] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / shares[c] - 1) < 1e-9 and abs(abs(r["whitened"]) - abs(white[i, c])) < 1e-8
    for c in range(k):  # one sign for all rows
        own = {r["vec_id"]: r["whitened"] for r in rows if r["component"] == c + 1}
        signs = {round(own[i] / white[i, c]) for i in own if abs(white[i, c]) > 1e-3}
        assert signs in ({1}, {-1})


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((150, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32).tolist()
    schema = "vec_id long, embedding array<float>, x string, w0 int, dim string, component int"
    rows = [(i, v, "x", 1, "d", 2) for i, v in enumerate(vectors)]
    bad = [(None, None), (500, [1.0, None] + [0.0] * 18), (501, [float("nan")] * 20), (502, [float("inf")] * 20), (503, [])]
    df = spark.createDataFrame(rows + [(*b, None, None, None, None) for b in bad], schema).repartition(4)
    check(whitening.whiten(df).collect(), vectors, 8)


def test_few_dimensions_repeats_and_lengths(spark):
    short = [[0.1, 0.5, 0.2], [0.3, 0.1, 0.9], [0.3, 0.1, 0.9], [0.7, 0.2, 0.1], [0.0, 0.0, 0.3]]
    other = [[0.2, 0.1], [0.9, 0.4], [0.1, 0.1]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(short)] + [(i, v) for i, v in enumerate(other)], "vec_id int, embedding array<double>")
    out = whitening.whiten(df).collect()
    check([r for r in out if r["n"] == 5], short, 3)
    check([r for r in out if r["n"] == 3], other, 2)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id int, embedding array<double>")).count() == 0
    # a line through space has one component
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame([(i, [i / 2, i / 1.0]) for i in range(9)], "vec_id int, embedding array<double>")).collect()} == {1}


def test_large_values(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e12, 3.0]), (None, [0.0, 4.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    x = [[int(v) for v in whitening.integers(np.array(r[1]))] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    for r in (r for r in out if r["component"] == 1):
        own = x[3 if r["vec_id"] is None else r["vec_id"]]
        exact = sum((4 * a - s) ** 2 for a, s in zip(own, sums))
        assert r["deviation"] is None if exact >= 10**38 else int(r["deviation"]) == exact


@pytest.mark.parametrize(
    "values,block,most",
    [
        (np.linspace(5, 1, 60), 4, 320),
        (np.r_[np.full(20, 3.0), np.ones(20)], 4, 320),
        (np.r_[5.0, 4, 3, np.zeros(37)], 4, 320),
        (np.zeros(12), 16, 320),
        (np.linspace(5, 0, 300) ** 2, 10, 60),
        (np.ones(3), 16, 320),
    ],
)
def test_iteration(values, block, most):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = (q * values) @ q.T
    e, y, said = whitening.leading_components(lambda b: v @ b, len(values), 8, block, most)
    k = min(8, len(values))
    assert np.allclose(e, np.sort(values)[::-1][:k], atol=1e-11)
    assert np.abs(y.T @ y - np.eye(k)).max() < 1e-10 and np.abs(v @ y - y * e).max() < 1e-10
    assert said["passes"] * min(max(block, 8), len(values)) >= k


def test_breakdown_restarts():
    """Three directions hold all variance, so the second block has fewer of its own than it wants."""
    _, _, said = whitening.leading_components(lambda b: np.diag([5.0, 4, 3] + [0] * 37) @ b, 40, 8, 8)
    assert said["restarts"] > 0


def test_squares():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**62), 2**62, (6, 9))
    assert whitening.squares(x) == [sum(int(c) ** 2 for c in r) for r in x]
    assert whitening.squares(x >> 40) == [sum(int(c) ** 2 for c in r) for r in x >> 40]
