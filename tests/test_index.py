"""The bucketed index against a plain dictionary over random commits, and what a commit writes."""

import glob
import os
import random

import pytest

from notefold.sources.index import ROWS, VectorIndex

PATHS = "path string"


def content(index):
    return sorted((r.path, r.chunk, tuple(r.v)) for r in index.rows().collect())


def files(folder):
    return set(glob.glob(f"{folder}/data/*/bucket=*/*.parquet"))


def test_random_commits_equal_a_rewritten_index(spark, tmp_path):
    rng, held = random.Random(6), {}
    index = VectorIndex(spark, str(tmp_path / "i"), buckets=5)
    assert content(index) == [] and index.compact() == []
    for step in range(9):
        if step == 5:
            rows = [(f"p{k}", 0, [float(k)]) for k in range(6)]
            index.rebuild(spark.createDataFrame(rows, ROWS))
            held = {p: [(p, c, tuple(v))] for p, c, v in rows}
        elif step % 3 == 2:
            gone = rng.sample(sorted(held), min(3, len(held))) + ["never"]
            index.remove(spark.createDataFrame([(p,) for p in gone], PATHS))
            for p in gone:
                held.pop(p, None)
        else:
            new = {f"p{rng.randrange(14)}": rng.randrange(0, 4) for _ in range(4)}  # some without rows
            rows = [(p, c, [rng.random(), float(step)]) for p, n in new.items() for c in range(n)]
            index.upsert(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(p,) for p in new], PATHS))
            for p in new:
                held[p] = [(q, c, tuple(v)) for q, c, v in rows if q == p]
        want = sorted(r for rows in held.values() for r in rows)
        assert content(index) == want
        if step in (3, 7):
            index.compact(0.2)
            assert content(index) == want
    some = sorted(held)[:2]
    assert sorted((r.path, r.chunk) for r in index.rows(some).collect()) == sorted(r[:2] for p in some for r in held[p])
    index.vacuum(1)
    assert content(VectorIndex(spark, str(tmp_path / "i"), buckets=99)) == want and index.count() == len(want)


def test_one_note_writes_one_bucket(spark, tmp_path):
    folder = str(tmp_path / "i")
    index = VectorIndex(spark, folder, buckets=16)
    index.rebuild(spark.createDataFrame([(f"p{k}", c, [1.0]) for k in range(200) for c in range(2)], ROWS))
    before = files(folder)
    index.upsert(spark.createDataFrame([("p7", 0, [2.0])], ROWS))
    new = files(folder) - before
    assert {os.path.dirname(f).rsplit("=", 1)[1] for f in new} == {str(next(p.bucket for p in index.parts() if not p.base))} and sum(os.path.getsize(f) for f in new) < 10_000
    assert [tuple(r) for r in index.rows(["p7"]).collect()] == [("p7", 0, [2.0])] and index.count() == 399
    read = index.rows(["p7"]).inputFiles()
    assert len({os.path.dirname(f).rsplit("=", 1)[1] for f in read}) == 1
    assert index.compact(0.5) == [] and len(index.compact(0.001)) == 1
    assert index.count() == 399 and all(p.base for p in index.parts())


def test_of_two_commits_one_fails(spark, tmp_path):
    one = VectorIndex(spark, str(tmp_path / "i"))
    one.upsert(spark.createDataFrame([("a", 0, [1.0])], ROWS))
    with pytest.raises(RuntimeError):
        one._publish(one.version, [])
    assert content(one) == [("a", 0, (1.0,))]
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.upsert(spark.createDataFrame([], ROWS), spark.createDataFrame([(None,), ("a",)], PATHS))
    assert content(index) == []
