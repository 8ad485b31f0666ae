"""Dirty paths reach the refresh through a stream."""

from pyspark.sql import functions as F

from notefold.streaming.pending import dirty_paths, rescan_needed


def test_rename_touches_both_paths(spark):
    e = spark.createDataFrame([("b.md", "rename", "a.md"), ("c.txt", "modify", None), ("d.MD", "create", None), ("e.md", "other", None)], "path string, kind string, old_path string")
    assert {r.path for r in dirty_paths(e).collect()} == {"a.md", "b.md", "d.MD"}


def test_stream_of_events(spark, tmp_path):
    e = spark.createDataFrame([("a.md", "modify"), ("a.md", "modify"), ("b.md", "delete")], "path string, kind string")
    e.write.json(str(tmp_path / "events"))
    seen = []
    s = spark.readStream.schema(e.schema).json(str(tmp_path / "events"))
    q = s.writeStream.foreachBatch(lambda b, _: seen.extend(r.path for r in dirty_paths(b).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(seen) == ["a.md", "b.md"]


def test_rescan(spark):
    listed = spark.createDataFrame([("new", 1), ("same", 1), ("mod", 2), ("dirty", 1)], "relpath string, mtime long")
    known = spark.createDataFrame([("same", 1), ("mod", 1), ("dirty", 1)], "relpath string, mtime long")
    dirty = spark.createDataFrame([("dirty",)], "path string")
    assert {r.relpath for r in rescan_needed(listed, known, dirty).collect()} == {"new", "mod", "dirty"}
    assert rescan_needed(listed, known, dirty.where(F.lit(False)), forced=True).count() == 4


def test_bursts_of_a_stream(spark, tmp_path):
    from notefold.streaming.pending import debounced

    e = spark.sql("select timestamp '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as ts from values (0), (1), (2), (60), (61), (4000) t(s)")
    e.coalesce(1).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).json(str(tmp_path / "in"))
    q = debounced(s, "10 seconds", late="30 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.n_events for r in spark.table("bursts").collect()) == [2, 3]  # the last burst is still open
    assert sorted(r.n_events for r in debounced(e, "10 seconds").collect()) == [1, 2, 3]
