"""Whitening against eigenvectors of a covariance formed in plain numpy, and exact sums in plain integers."""

import math

import numpy as np
import pyarrow as pa
import pytest

from notefold.llm.queries import op12_whitening
from notefold.llm.vectors import matrix
from notefold.llm.whitening import whitening_rows
from tests.conftest import SMALL


def brute(vectors, most=32):
    """{(row, component): (deviation, whitened up to sign, explained)} of lists of numbers."""
    dim = max(map(len, vectors))
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (dim - len(v))]] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    d = np.array([[(n * c - s) / n for c, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1], u[:, ::-1]
    return dev, d @ u[:, :most] / np.sqrt(e[:most]), e / e.sum()


def same(got, vectors, ids):
    dev, w, share = brute(vectors)
    k = max(r.component for r in got)
    assert len(got) == k * len(vectors)
    place = {i: at for at, i in enumerate(ids)}
    own = np.zeros((len(vectors), k))
    for r in got:
        at = place[r.vec_id]
        assert r.n == len(vectors) and r.deviation == dev[at]
        assert abs(r.explained - share[r.component - 1]) <= 1e-9 * r.explained + 1e-15 and r.identity_error < 1e-8
        own[at, r.component - 1] = r.whitened
    for c in range(k):
        sign = np.sign(own[:, c] @ w[:, c])
        assert np.abs(own[:, c] - sign * w[:, c]).max() < 1e-6
    c = own - own.mean(0)
    assert np.abs(c.T @ c / len(own) - np.eye(k)).max() <= got[0].identity_error + 1e-9
    return k


def test_query_equals_covariance(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    assert same(op12_whitening(spark, SMALL).collect(), [r.embedding for r in rows], [r.vec_id for r in rows]) == 32


@pytest.mark.parametrize("parts", [1, 40])
def test_hard_rows(spark, parts):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).tolist() for _ in range(300)] + [[], [1.5], [2.0, -3.0, 1e-300], *[[0.25] * 6] * 150]
    bad = [(None, None), (900, [1.0, None]), (901, [float("nan")] * 6), (902, [float("inf"), 1.0])]
    rows = [(k, v, 1, "s") for k, v in enumerate(vectors)] + [(*b, 1, "s") for b in bad]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, part int, state string").repartition(parts)
    assert same(whitening_rows(df).collect(), vectors, list(range(len(vectors)))) == 6
    assert len(whitening_rows(df, most=2).collect()) == 2 * len(vectors)


def test_without_variance(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = whitening_rows(none)
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening_rows(equal).count() == 0 and whitening_rows(equal).schema == out.schema
    line = spark.createDataFrame([(k % 2, [k * 1.0, k * 2.0, 5.0]) for k in range(9)] + [(None, [3.0, 6.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening_rows(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and abs(got[0].explained - 1) < 1e-12


def test_numbers_beyond_long(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    got = whitening_rows(df).collect()
    assert all(math.isfinite(r.whitened) for r in got) and {r.deviation for r in got if r.vec_id != 3} == {None}
    whole = [math.floor(64 * x) for x in (0.0, 1.0, 1.0)]
    assert {r.deviation for r in got if r.vec_id == 3} == {(3 * 32 - 32) ** 2 + (3 * whole[2] - sum(whole)) ** 2}


def test_matrix_of_slices():
    a = pa.array([[9.0], [1.0, 2.0], [], [3.0]])
    assert matrix(a[1:]).tolist() == [[1, 2], [0, 0], [3, 0]] and matrix(a[2:3], 2).tolist() == [[0, 0]] and matrix(a[:0]).shape == (0, 0)


def test_plan_has_no_product(spark):
    text = whitening_rows(spark.read.parquet(f"{SMALL}/embeddings.parquet"))._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "Exchange" not in text
