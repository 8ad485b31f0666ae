"""From files of a vault and events to a snapshot of what is pending, over a restart."""

import os
import time

import pytest
from pyspark.sql import functions as F

from notefold.functions.text import body_signature
from notefold.streaming.refresh import EVENTS, pending_now, start_refreshes


@pytest.fixture(autouse=True)
def store_provider(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_pending_follows_files_and_events(spark, tmp_path):
    root, store, events = tmp_path / "vault", str(tmp_path / "store"), tmp_path / "events"
    events.mkdir()
    now = int(time.time()) - 1000

    def put(name, text, at):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (now + at, now + at))

    def tell(*rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(events))

    def snapshot():
        return {r.scope: (r.total, [x.relpath for x in r["items"]]) for r in pending_now(spark, store, 2).collect() if r.total}

    def go(*until):
        """Run both queries anew until the snapshot is the wanted one."""
        seen = []
        stream = spark.readStream.schema(EVENTS).json(str(events))
        both = start_refreshes(spark, str(root), store, ["a"], ["."], stream, least_words=2, most=2, shards=3, settle=0, tell=lambda s: seen.append(s.count()), every_ms=100)
        end = time.time() + 90
        while time.time() < end and snapshot() != until[0] and both.entries.isActive and both.pending.isActive:
            time.sleep(0.5)
        errors = both.entries.exception(), both.pending.exception()
        both.stop()
        assert errors == (None, None) and snapshot() == until[0], errors

    put("a/one.md", "one text\n", 1)
    put("a/two.md", "two texts\n", 2)
    put("b/three.md", "---\nsummary: x\n---\nthree texts\n", 3)
    put("b/short.md", "short\n", 4)
    go({"current": (2, ["a/two.md", "a/one.md"]), "all": (3, ["b/three.md", "a/two.md"])})
    hashes = {n: spark.range(1).select(body_signature(F.lit(t))).first()[0] for n, t in (("a/two.md", "two texts\n"), ("b/three.md", "three texts\n"))}
    tell(*((n, (now + 10) * 1000, "known", h) for n, h in hashes.items()))
    go({"current": (1, ["a/one.md"]), "all": (1, ["a/one.md"])})
    put("b/short.md", "no longer short\n", 20)
    put("a/two.md", "two other texts\n", 21)
    tell(("a/one.md", (now + 22) * 1000, "gone", None))
    go({"current": (1, ["a/two.md"]), "all": (2, ["a/two.md", "b/short.md"])})
