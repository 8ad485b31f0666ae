"""Clusters against plain integer loops, the annulus search against all centroids, the query against SQL."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notefold.llm import queries
from notefold.llm.clustering import cluster, clustered, moved, nearest, packed, whole_vectors
from tests.conftest import SMALL


def plain(rows, k=8, rounds=10, dim=64):
    """{(id, vector): (cluster, distance)} and centroids by the definition, in Python integers."""
    kept = [(i, tuple(v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * c) for c in v] for _, v in kept]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v, w) for (i, v), w in zip(kept, x, strict=True) if i is not None)[:k]
    cents = [w for *_, w in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for v in x]
    for _ in range(rounds):
        groups = [[v for v, (_, j) in zip(x, at, strict=True) if j == c] for at in [assign()] for c in range(len(cents))]
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, cents, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)], cents


def check(df, rows, dim, **how):
    want, cents = plain(rows, dim=dim, **how)
    got = clustered(df, dim=dim, **how).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 30])
def test_hard_rows(spark, parts):
    rng = np.random.default_rng(2)
    points = [rng.integers(-3, 4, 4).astype(float).tolist() for _ in range(250)]  # ties abound
    rows = [(k if k % 17 else None, v) for k, v in enumerate(points)] + [(5, points[9]), (5, points[3])] + [(700 + k, [0.5] * 4) for k in range(120)]
    rows += [(800, None), (801, [1.0, None, 1.0, 1.0]), (802, [1.0] * 3), (803, []), (804, [float("nan")] + [1.0] * 3), (805, [float("-inf")] + [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id int, embedding array<double>, cluster int, distance double").repartition(parts)
    check(df, rows, 4)
    check(df, rows, 4, k=3, rounds=1)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<float>")
    check(df, [tuple(r) for r in df.collect()], 2)
    assert clustered(df.where(F.lit(False)), dim=2).count() == 0 and clustered(df.where("vec_id is null"), dim=2).count() == 0
    big = spark.createDataFrame([(k, [1e30 * (-1) ** k] * 64) for k in range(20)], "vec_id long, embedding array<double>")
    assert {r.distance for r in clustered(big).collect()} == {0}


def test_annulus_finds_what_all_comparisons_find():
    rng = np.random.default_rng(8)
    for spread in (1, 30, 4000):
        c = rng.integers(-spread, spread + 1, (150, 5)) * rng.integers(1, 9, (150, 1))
        x = np.concatenate([rng.integers(-4 * spread, 4 * spread + 1, (2000, 5)), c, np.zeros((3, 5), int)]).astype(np.int64)
        label, d, compared = nearest(x, c)
        full = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (d == full.min(1)).all() and (label == full.argmin(1)).all()
        assert compared < 0.6 * full.size  # far from all centroids
        beside = c[rng.integers(0, 150, 3000)] + rng.integers(-1, 2, (3000, 5))
        assert nearest(beside, c)[2] < 0.25 * 3000 * 150
    assert nearest(np.array([[3, 0], [-3, 0]]), np.array([[0, 3], [0, -3], [0, 3]]))[0].tolist() == [0, 0]


def test_rounds_skip_comparisons(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, (rng.normal(size=4) * (1 + k % 40)).tolist()) for k in range(4000)], "vec_id long, embedding array<double>")
    blocks = packed(whole_vectors(rows, dim=4), dim=4)
    _, cents = cluster(rows, k=40, rounds=3, dim=4)
    assert moved(blocks, cents)[1] < 0.6 * 4000 * 40


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(SMALL, 'embeddings.parquet')}'")
    want = con.execute(queries.ORACLES["op13_clustering"])
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    assert rows == sorted(tuple(r[c] for c in names) for r in queries.op13_clustering(spark, SMALL).collect())
