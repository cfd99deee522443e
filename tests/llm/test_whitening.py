import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def slow_fit(vectors):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:16]
    return x, n, sums, values[order], directions[:, order], values.sum()


def compare(df, keys, vectors, most=16):
    x, n, sums, values, directions, trace = slow_fit(vectors)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == len(set(keys)) * min(most, len(values))
    place = {k: i for i, k in enumerate(keys)}
    for (key, component), rows in got.items():
        r, k = rows[0], component - 1
        off = n * x[place[key]] - sums
        assert r["n"] == n
        assert r["deviation"] == int((off.astype(object) ** 2).sum())
        want = (off / n) @ directions[:, k] / np.sqrt(values[k])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-7 * max(1, abs(want))
        assert abs(r["explained"] - values[k] / trace) < 1e-10
        assert r["identity_error"] < 1e-8


@pytest.mark.parametrize("fan", [16, 2])
def test_against_dense_eigenvectors(spark, monkeypatch, fan):
    """Many small parts are merged in several rounds."""
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))).astype(np.float32)
    vectors[200:] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    compare(whitening.whitened(df), list(range(300)), vectors)


def test_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    out = whitening.whitened(df)
    compare(out, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def bidiagonals():
    rng = np.random.default_rng(2)
    yield rng.standard_normal(12), rng.standard_normal(11)
    yield 10.0 ** -np.arange(12), 10.0 ** -np.arange(11)
    yield np.ones(10), np.zeros(9)
    yield np.ones(9), np.ones(8)
    yield np.array([1, 0, 2, 0.0]), np.array([1, 1, 0.0])
    yield 10.0 ** np.arange(-6, 6.0), np.ones(11)
    yield np.array([3.0]), np.zeros(0)
    yield np.concatenate([np.full(5, 7.0), np.full(5, 7 * (1 + 1e-13))]), np.full(9, 1e-9)


@pytest.mark.parametrize("case", range(8))
def test_singular_values_and_directions(case):
    diagonal, above = list(bidiagonals())[case]
    dense = np.diag(diagonal) + np.diag(above, 1)
    want = np.linalg.svd(dense, compute_uv=False)
    got = whitening.singular_values(diagonal, above)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-14 * want[0])
    some = got[got > 1e-8 * got[0]]
    found = whitening._directions(diagonal, above, some)
    assert np.allclose(found.T @ found, np.eye(len(some)), atol=1e-9)
    scale = got[0] ** 2
    left = dense.T @ dense @ found - found * some**2
    assert np.abs(left).max() < 1e-10 * scale


def test_small_values_keep_their_digits():
    """A graded matrix whose least values a dense solver of its square would lose."""
    diagonal, above = 10.0 ** -np.arange(0, 18, 2.0), 10.0 ** -np.arange(1, 17, 2.0) / 7
    got = whitening.singular_values(diagonal, above)
    assert abs(np.log(got).sum() - np.log(diagonal).sum()) < 1e-12


def test_bidiagonal_form():
    square = np.random.default_rng(3).standard_normal((9, 9))
    diagonal, above, right = whitening.bidiagonal(square)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(right.T @ right, np.eye(9))
    assert np.allclose(right @ b.T @ b @ right.T, square.T @ square)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = [(k, rng.standard_normal(4).tolist()) for k in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [nan, 1.0, 1.0, 1.0]), (103, [inf, 0.0, 0.0, 0.0])]
    bad += [(104, []), (105, [3e38, 0.0, 0.0, 0.0])]
    lone = [(200, [1.0, 2.0]), (201, [1.0, 2.0])]
    twos = [(300 + k, rng.standard_normal(3).tolist()) for k in range(9)]
    names = {n: F.lit(n) for n in "key x component n deviation whitened".split()}
    df = spark.createDataFrame(good + bad + lone + twos + [(None, [0.5, 0.5, 0.5, 0.5])], SCHEMA)
    df = df.withColumns(names)
    out = whitening.whitened(df)
    seen = {r["vec_id"] for r in out.collect()}
    assert seen == {k for k, _ in good + twos} | {None}
    assert out.filter("vec_id >= 300").count() == 27
    assert {r["n"] for r in out.filter("vec_id < 100").collect()} == {41}
    assert whitening.whitened(df.limit(0)).count() == 0
    assert whitening.whitened(spark.createDataFrame(lone, SCHEMA)).count() == 0
