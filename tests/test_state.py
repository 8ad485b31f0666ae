"""Keyed state of streams against the batch functions, after every micro-batch and over restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from notefold.operators.notes import pending_snapshot
from notefold.streaming.pending import debounced, refreshed
from notefold.streaming.state import CHANGES, SIGHTINGS, debounced_by_timers, entry_changes, newest_by_shard, snapshot_of_shards, with_state_store


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """A stream over a folder that gets a file a micro-batch; each call starts the query anew from its checkpoint."""

    def __init__(self, spark, folder, schema, make, mode="update"):
        self.spark, self.folder, self.schema, self.make, self.mode, self.n = spark, folder, schema, make, mode, 0
        (folder / "in").mkdir()

    def __call__(self, rows, known=None):
        """Rows that come out for rows that go in."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(str(self.folder / f"in/{self.n:03d}"))
        self.n += 1
        out = []
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(str(self.folder / "in"))
        q = self.make(stream).writeStream.outputMode(self.mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return out


def test_entries_equal_the_batch_after_each_micro_batch(spark, tmp_path):
    rng = random.Random(4)
    feed = Feed(spark, tmp_path, SIGHTINGS, lambda s: entry_changes(s, least_words=2))
    marks = "relpath string, mtime long, in_current boolean, in_all boolean"
    entries = spark.createDataFrame([], marks + ", hash string")
    files, seq, known = {}, 0, {}
    for step in range(5):
        rows, gone, dirty = [], [], set()
        for k in range(12):
            name, seq = f"n{k}.md", seq + 1
            roll = rng.random()
            if name in files and roll < 0.15:
                del files[name]
                gone.append(name)
                rows.append((name, seq, "gone", None, None, None, None, None))
                known.pop(name, None) if False else None
            elif roll < 0.75:
                old = files.get(name, (0, True, True, None, 0))
                new = (old[0] + rng.choice((0, 0, 1)), rng.random() < 0.8, True, f"h{rng.randrange(4)}" if rng.random() < 0.9 else "", rng.choice((1, 5, 5)))
                files[name] = new
        for name in list(files):
            seq += 1
            mtime, cur, every, own, words = files[name]
            rows.append((name, seq, "listed", mtime, cur, every, own, words))
            if rng.random() < 0.2:
                dirty.add(name)
                rows.append((name, seq, "dirty", None, None, None, None, None))
            if rng.random() < 0.2:
                known[name] = own
                rows.append((name, seq, "known", None, None, None, own, None))
        rng.shuffle(rows)
        got = feed(rows)
        listed = spark.createDataFrame([(n, *f[:3]) for n, f in files.items()], marks)
        content = spark.createDataFrame([(n, *f[3:]) for n, f in files.items()], "relpath string, hash string, words int")
        want = refreshed(entries, listed, spark.createDataFrame([(p,) for p in dirty], "path string"), lambda due: due.join(content, "relpath"), least_words=2).collect()
        as_set = lambda rs: {(r.relpath, r.mtime, r.in_current, r.in_all, r.hash, r.scanned, r.updated) for r in rs}
        assert as_set(r for r in got if not r.gone) == as_set(want)
        assert {r.relpath for r in got if r.gone} == set(gone)
        assert all(r.pending == (r.hash is not None and r.hash != known.get(r.relpath)) for r in got if not r.gone)
        entries = spark.createDataFrame([(r.relpath, r.mtime, r.in_current, r.in_all, r.hash) for r in want], marks + ", hash string")


def test_a_dirty_file_is_read_when_it_is_listed_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, SIGHTINGS, entry_changes)
    listed = ("a", 1, "listed", 7, True, True, "h", 3)
    assert [(r.scanned, r.pending) for r in feed([listed])] == [(True, True)]
    assert feed([("a", 2, "dirty", None, None, None, None, None)]) == []
    assert [(r.scanned, r.hash) for r in feed([("a", 3, *listed[2:6], "new", 3)])] == [(True, "new")]
    assert [(r.scanned, r.hash) for r in feed([("a", 4, *listed[2:6], "unread", 3)])] == [(False, "new")]
    assert [(r.scanned, r.pending) for r in feed([("a", 5, "known", None, None, None, "new", None)])] == [(False, False)]
    assert [r.hash for r in feed([("a", 6, "forced", None, None, None, None, None), ("a", 6, *listed[2:6], "unread", 3)])] == ["unread"]


def test_newest_pending_equal_the_batch_after_each_micro_batch(spark, tmp_path):
    rng = random.Random(9)
    feed = Feed(spark, tmp_path, "scope string, relpath string, mtime long, pending boolean, seq long", lambda s: newest_by_shard(s, most=3, shards=2, spare=2))
    pending, shards, seq = {}, {}, 0
    for step in range(6):
        rows = []
        for _ in range(40):
            scope, path, seq = rng.choice(("current", "all")), f"n{rng.randrange(30)}", seq + 1
            on = rng.random() < (0.9 if step < 3 else 0.25)  # later on, more stop than start
            mtime = rng.randrange(12)
            rows.append((scope, path, mtime, on, seq))
            pending.pop((scope, path), None)
            if on:
                pending[scope, path] = mtime
        rng.shuffle(rows)
        for r in feed(rows):
            shards[r.scope, r.shard] = r
        table = spark.createDataFrame([(s, p, m) for (s, p), m in pending.items()], "scope string, relpath string, mtime long")
        rows_of = lambda df: {r.scope: (r.total, [tuple(x) for x in r["items"]]) for r in df.collect()}
        got = snapshot_of_shards(spark.createDataFrame(list(shards.values()), "scope string, shard int, total long, items array<struct<mtime: long, relpath: string>>"), 3)
        assert rows_of(got) == rows_of(pending_snapshot(table, 3))


@pytest.mark.parametrize("cut", [1, 7, 60])
def test_bursts_are_those_of_the_batch_in_any_cut(spark, tmp_path, cut):
    rng = random.Random(cut)
    times = sorted(rng.randrange(0, 4_000) * 500 for _ in range(60))  # milliseconds; exact gaps and equal times occur
    rows = [(f"v{rng.randrange(2)}", t / 1000) for t in times]
    for k in range(0, len(rows) - 4, 4):  # out of order, within the watermark
        rows[k : k + 4] = rng.sample(rows[k : k + 4], 4)
    rows.append(("v0", 100_000.0))  # moves the watermark past all others
    schema = "vault string, at double"
    as_events = lambda df: df.select("vault", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
    feed = Feed(spark, tmp_path, schema, lambda s: debounced_by_timers(as_events(s), ("vault",), "20 seconds", "10 minutes"), "append")
    out = []
    for k in range(0, len(rows), 31 if cut < 60 else 61):
        part = rows[k : k + (31 if cut < 60 else 61)]
        out += feed(part)
    out += feed([("v1", 100_000.0)])
    want = debounced(as_events(spark.createDataFrame(rows, schema)), "20 seconds", by=("vault",)).where("started < timestamp_seconds(90000)").collect()
    key = lambda rs: sorted((r.vault, r.started, r.fires, r.n_events) for r in rs)
    assert key(out) == key(want) and len(out) > 5
    with pytest.raises(ValueError):
        debounced_by_timers(as_events(spark.createDataFrame(rows, schema)), ())


def test_schemas_name_what_comes_out(spark):
    assert CHANGES.count(",") == 9 and time is not None


def test_a_file_is_one_value_of_state(spark):
    """A key of a micro-batch asks for its state once and puts it back at most once; what does not change is not put back."""
    from types import SimpleNamespace

    from notefold.streaming.state import _Entries

    calls, values = [], {}

    class Value:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*args):
                calls.append(what)
                if what == "update":
                    values[self.name] = args[0]
                elif what == "clear":
                    values.pop(self.name, None)
                return self.name in values if what == "exists" else values.get(self.name)

            return call

    own = _Entries(0)
    own.init(SimpleNamespace(getValueState=lambda name, schema: Value(name)))
    sight = lambda seq, kind, **more: SimpleNamespace(**{"seq": seq, "kind": kind, "mtime": None, "in_current": None, "in_all": None, "hash": None, "words": None} | more)
    listed = {"mtime": 5, "in_current": True, "in_all": True, "hash": "h", "words": 9}
    for rows, most in (([sight(1, "listed", **listed), sight(1, "known", hash="h")], 2), ([sight(2, "listed", **listed)], 1), ([sight(3, "dirty")], 2), ([sight(4, "gone")], 2)):
        calls.clear()
        out = list(own.handleInputRows(("a.md",), iter(rows), None))
        assert len(calls) <= most and all(r.relpath == "a.md" for r in out)
    out = list(own.handleInputRows(("a.md",), iter([sight(5, "listed", **listed)]), None))
    assert [(r.scanned, r.pending) for r in out] == [(True, False)]  # what was known stays known
