"""Runs merge by their heads, entries are never sorted again, and equal entries become one."""

import random

import numpy as np
import pyarrow as pa

from notefold.llm import exact_dedup as E


def blocks_of(run: bytes, size: int) -> list[tuple[bytes, bytes]]:
    step = size * E.ENTRY
    return [(run[k : k + E.KEY], run[k : k + step]) for k in range(0, len(run), step)]


def test_merge_against_brute_force():
    rng = random.Random(3)
    pool = [(rng.randbytes(32), rng.randrange(1 << 40), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(400)]
    pool += [(pool[0][0], n, c) for n in (1, 2) for c in (-1, 1)]  # equal digests, other lengths and check hashes
    want, blocks, opened, most = {}, [], {}, 0
    for serial in range(30):
        rows = [(*rng.choice(pool), rng.randrange(-50, 10**6)) for _ in range(rng.choice((1, 7, 300)))]
        for *key, doc in rows:
            least, n = want.get(tuple(key), (doc, 0))
            want[tuple(key)] = min(least, doc), n + 1
        sha, length, chk, ids = zip(*rows)
        run = E.sorted_run(pa.array(sha, pa.binary()), *(np.array(x, np.int64) for x in (length, chk, ids)))
        assert len(run) == E.ENTRY * len(set(zip(sha, length, chk)))
        blocks += [(first, serial, block) for first, block in blocks_of(run, 16)]
    blocks.sort()

    def told():
        for first, serial, block in blocks:
            opened[serial] = block[-E.ENTRY :][: E.KEY]  # a block of a run comes once the one before it has gone
            yield first, block

    got = []
    for key, least, n in E.merged_heads(told()):
        got.append((key, least, n))
        most = max(most, sum(last >= key for last in opened.values()))
    assert [k for k, _, _ in got] == sorted({k for k, _, _ in got}) and most <= 30
    assert {(k[:32], *np.frombuffer(k[32:], ">i8").tolist()): (least, n) for k, least, n in got} == want


def test_merge_of_nothing():
    assert list(E.merged_heads([])) == []


def test_runs_over_any_fan(spark):
    rng = random.Random(4)
    texts = [f"text {rng.randrange(300)}" for _ in range(2_000)] + ["hot"] * 1_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = {}
    for k, t in enumerate(texts):
        want[t] = min(want.get(t, k), k)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_groups(docs).collect()}
    assert got == {k: (want[t], texts.count(t)) for k, t in enumerate(texts)}
    for fan in (2, 3):
        groups = E.merged_runs(E._digests(E.texts(docs)), fan).collect()
        assert sorted(r.min_id for r in groups) == sorted(want.values())
