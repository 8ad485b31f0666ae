"""Nearest chunks against all comparisons: copies, zeros, clusters that are skipped, and lists renewed after changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notefold.operators import similarity
from notefold.operators.similarity import knn_chunks, mean_vectors, nearest_chunks, renewed_neighbours

SCHEMA = "path string, chunk int, v array<double>"


@pytest.fixture(params=["sent", "shuffled"])
def way(request, monkeypatch):
    """Candidates that go to every task, or none that do."""
    if request.param == "shuffled":
        monkeypatch.setattr(similarity, "SENT", -1)


def plain(rows, k, asking=None):
    """{(note, chunk): [(path, chunk, score)]} by all comparisons, for rows (path, chunk, v)."""
    own = [r for r in rows if r[2] is not None]
    d = max((len(r[2]) for r in own), default=0)
    m = np.array([[*r[2], *[0.0] * (d - len(r[2]))] for r in own]).reshape(len(own), d)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    score = np.round(m @ m.T, 9)
    out = {}
    for i, (p, c, _) in enumerate(own):
        if asking is None or p in asking:
            order = sorted(range(len(own)), key=lambda j: (-score[i, j], own[j][0], own[j][1]))[:k]
            out[p, c] = [(own[j][0], own[j][1], round(score[i, j], 6)) for j in order]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.note, r.chunk, r["rank"])):
        out.setdefault((r.note, r.chunk), []).append((r.path, r.path_chunk, round(r.score, 6)))
    return out


def same(got, want):
    """Whether the same chunks stand in the same order, scores but for rounding."""
    return got.keys() == want.keys() and all([x[:2] for x in v] == [x[:2] for x in want[k]] and np.allclose([x[2] for x in v], [x[2] for x in want[k]], atol=2e-6) for k, v in got.items())


def gathered(n, centres=12, dim=16, seed=0):
    """Vectors around a few directions, some of them copies."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim))
    v = at[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, dim))
    v[: n // 6] = v[0]
    return [(f"f{k % 7}/n{k // 3}", k % 3, x.tolist()) for k, x in enumerate(np.round(v, 4))]


@pytest.mark.parametrize("block", [7, 1024])
def test_same_as_all_comparisons(spark, way, block):
    rows = gathered(300) + [("z/zero", 0, [0.0] * 16), ("z/zero", 1, [0.0] * 16), ("z/short", 0, [1.0, 2.0]), ("z/null", 0, None), ("z/against", 0, [-x for x in gathered(300)[0][2]])]
    got = lists(knn_chunks(spark.createDataFrame(rows, SCHEMA), 9, block=block))
    assert same(got, plain(rows, 9))


def test_few_and_no_rows(spark, way):
    rows = [("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("b", 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert same(lists(knn_chunks(df, 40)), plain(rows, 40))
    assert knn_chunks(df.where(F.lit(False))).count() == 0 and knn_chunks(df, asking=df.where(F.lit(False))).count() == 0


def test_ranges_of_angles_are_skipped(spark, way):
    rows = gathered(4000, centres=40)
    df = spark.createDataFrame(rows, SCHEMA)
    found = nearest_chunks(df, 10, block=40)
    assert found.possible == 4000 * 4000 and found.compared < 0.5 * found.possible
    assert same(lists(found.rows), plain(rows, 10))
    plan = found.rows._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_only_those_that_ask(spark, way):
    rows = gathered(900)
    df = spark.createDataFrame(rows, SCHEMA)
    asking = df.where("path like 'f3/%'")
    found = nearest_chunks(df, 8, asking, block=50)
    assert same(lists(found.rows), plain(rows, 8, {p for p, *_ in rows if p.startswith("f3/")}))
    assert found.possible < 0.2 * 900 * 900
    some = lists(nearest_chunks(df, 8, asking.withColumn("floor", F.lit(0.99)), block=50).rows)
    assert some and same(some, {k: [x for x in v if x[2] >= 0.99] for k, v in plain(rows, 8).items() if k in some})


def test_lists_are_renewed(spark, way):
    rows = gathered(1200)
    df = spark.createDataFrame(rows, SCHEMA)
    known = nearest_chunks(df, 20, block=64).rows
    rng = np.random.default_rng(3)
    now = rows
    for step in range(2):
        gone = {now[0][0], now[-1][0]} if step else set()
        moved = {now[int(rng.integers(len(now)))][0] for _ in range(5)} - gone
        after = [r for r in now if r[0] not in gone | moved] + [(p, c, (rng.normal(size=16) + np.array(rows[5][2])).tolist()) for p in sorted(moved) for c in range(3)]
        after += [(f"new/{step}", 0, rows[7][2])]
        changed = spark.createDataFrame([(p,) for p in gone | moved | {f"new/{step}"}], "path string")
        found = renewed_neighbours(known, spark.createDataFrame(after, SCHEMA), changed, k=10, spare=10, block=64)
        got, want = lists(found.rows), plain(after, 20)
        assert all(len(v) >= 10 for v in got.values()) and same(got, {key: v[: len(got[key])] for key, v in want.items()})
        assert found.compared < 0.15 * found.possible
        known, now = spark.createDataFrame(found.rows.collect(), found.rows.schema), after


def test_a_small_index_grows(spark, way):
    rows = gathered(6)
    df = spark.createDataFrame(rows, SCHEMA)
    more = rows + [("x/new", 0, [0.5] * 16)]
    found = renewed_neighbours(knn_chunks(df, 20), spark.createDataFrame(more, SCHEMA), spark.createDataFrame([("x/new",)], "path string"), k=10, spare=10)
    assert same(lists(found.rows), plain(more, 20))


def test_means_take_one_shuffle(spark):
    rows = gathered(500)
    out = mean_vectors(spark.createDataFrame(rows, SCHEMA).repartition(7))
    want = {}
    for p, _, v in rows:
        want.setdefault(p, []).append(v)
    got = {r.path: r.v for r in out.collect()}
    assert set(got) == set(want) and all(np.allclose(got[p], np.mean(v, axis=0)) for p, v in want.items())
    plan = mean_vectors(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "posexplode" not in plan


def test_no_pairs_of_blocks_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SENT", -1)
    rows = gathered(600) + [(f"y/{k}", 0, gathered(1)[0][2]) for k in range(100)]  # a vector with more copies than a list has room for
    df = spark.createDataFrame(rows, SCHEMA)
    found = nearest_chunks(df, 8, block=64)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    assert same(lists(found.rows), plain(rows, 8))


def test_known_lists_are_made_once(spark, way, tmp_path):
    rows = gathered(120)
    df, told = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "told")

    def tell(batches):
        for b in batches:
            with open(told, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    lists_of = knn_chunks(df, 20).localCheckpoint()
    known = lists_of.mapInArrow(tell, lists_of.schema)
    found = renewed_neighbours(known, df.where("path <> 'f0/n0'"), spark.createDataFrame([("f0/n0",)], "path string"), k=10, spare=10, block=64)
    assert same({k: v[:10] for k, v in lists(found.rows).items()}, plain([r for r in rows if r[0] != "f0/n0"], 10))
    assert (tmp_path / "told").stat().st_size == lists_of.count()
