"""Refreshes read what changed and nothing else; files of an installation come back."""

import pytest
from pyspark.sql import functions as F

from notefold.functions.runtime import CONFIG_NAME, CONFIG_TEMPLATE
from notefold.sources.assets import restore_assets
from notefold.streaming.caches import ByTime, modified
from notefold.streaming.pending import refresh_metrics, refreshed

LISTED = "relpath string, mtime long, in_current boolean, in_all boolean"


def test_values_are_read_once_a_time(spark, tmp_path):
    file, reads = tmp_path / "config.json", []

    def read():
        reads.append(file.read_text())
        if reads[-1] == "broken":
            raise ValueError("broken")
        return reads[-1]

    times = iter((None, 1, 1, 2, 3, 3, 4, None))
    held = ByTime(lambda: next(times), read, missing="none")
    assert held.get() == ("none", False)
    file.write_text("a")
    assert [held.get() for _ in range(3)] == [("a", True), ("a", False), ("a", True)]
    file.write_text("broken")
    assert [held.get() for _ in range(2)] == [("none", True)] * 2  # tried again
    file.write_text("b")
    assert [held.get(), held.get()] == [("b", True), ("none", False)]
    file.write_text("broken")
    with pytest.raises(ValueError):
        ByTime(lambda: 1, read, strict=True).get()
    assert modified(spark, str(tmp_path / "no")) is None and modified(spark, str(file)) > 0


def test_refresh(spark):
    entries = spark.createDataFrame([("same", 1, True, True, "h"), ("gone", 1, True, True, "h"), ("moved", 1, False, True, "h"), ("short", 1, True, True, "h"), ("never", 1, True, True, None)], LISTED + ", hash string")
    listed = spark.createDataFrame([("same", 1, True, True), ("moved", 1, True, True), ("short", 2, True, True), ("new", 1, False, True), ("never", 1, True, True), ("blank", 1, True, True)], LISTED)
    dirty = spark.createDataFrame([("gone",), ("gone",)], "path string")
    texts = {"same": ("h", 9), "moved": ("m", 9), "short": ("s", 1), "new": ("n", 9), "never": ("", 9), "blank": (None, 9)}
    contents = spark.createDataFrame([(k, *v) for k, v in texts.items()], "relpath string, hash string, words int")
    read = lambda due: due.join(contents, "relpath")
    got = refreshed(entries, listed, dirty, read, least_words=2)
    assert {r.relpath: (r.hash, r.scanned, r.updated, r.in_current) for r in got.collect()} == {
        "same": ("h", False, False, True), "moved": ("m", True, True, True), "short": (None, True, False, True),
        "new": ("n", True, True, False), "never": (None, True, False, True), "blank": (None, True, False, True),
    }
    assert refresh_metrics(got, listed, dirty).collect() == [(6, 5, 2, 3, 1)]
    assert refreshed(entries, listed, dirty, read, forced=True).where("scanned").count() == 6
    again = refreshed(got, listed, dirty, read, least_words=2)
    assert {r.relpath for r in again.where("scanned").collect()} == {"short", "never", "blank"}
    assert refreshed(entries, listed.where(F.lit(False)), dirty, read).count() == 0


def test_assets_come_back(tmp_path):
    bundled = {"a.py": "A", "b.txt": "B", CONFIG_TEMPLATE: "{}"}
    names = ("a.py", "b.txt", CONFIG_TEMPLATE)
    folder = tmp_path / "x" / "y"
    first = restore_assets(folder, names, bundled)
    assert first.ok and first.code == "ASSETS_RESTORED" and first.recovered == names and first.config_created
    (folder / "a.py").write_text("own")
    (folder / "b.txt").unlink()
    assert restore_assets(folder, names, bundled).recovered == ("b.txt",)
    last = restore_assets(folder, names, bundled)
    assert (last.code, last.recovered, last.config_created) == ("ASSETS_OK", (), False) and (folder / "a.py").read_text() == "own"


def test_assets_that_cannot_come_back(tmp_path):
    (tmp_path / "file").write_text("")
    assert restore_assets(tmp_path / "file", ("a",), {"a": ""}).code == "FOLDER_FAILED"
    got = restore_assets(tmp_path / "one", ("a", "b"), {"a": ""})
    assert (got.ok, got.code, got.recovered, got.concerns) == (False, "ASSET_NOT_BUNDLED", ("a",), "b")
    got = restore_assets(tmp_path / "two", ("sub/a",), {"sub/a": ""})  # no such folder to write to
    assert (got.code, got.concerns, bool(got.why)) == ("ASSET_FAILED", "sub/a", True)
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / CONFIG_NAME).symlink_to(tmp_path / "no" / "where")
    assert restore_assets(tmp_path / "three", (), {CONFIG_TEMPLATE: ""}).code == "CONFIG_FAILED"


def test_a_whole_refresh_reads_its_files_by_their_times(spark, tmp_path):
    """Config and state by ByTime, rescan, pending: a config that changed scans all files, a state that did not is not read again."""
    from notefold.operators.notes import pending_snapshot
    from notefold.sources.config import read_config, read_state, write_state
    from notefold.streaming.caches import ByTime

    clock, reads = {"config": 1, "state": 1}, []
    (tmp_path / "config.json").write_text('{"notes_paths": ["."], "least": 2}')

    def state():
        reads.append("state")
        return read_state(spark, str(tmp_path / "state"))

    def config():
        reads.append("config")
        return read_config((tmp_path / "config.json").read_text())[0]

    write_state(spark.createDataFrame([("a", "h1")], "relpath string, hash string"), str(tmp_path / "state"))
    held = ByTime(lambda: clock["config"], config), ByTime(lambda: clock["state"], state)
    contents = {"a": ("h1", 5), "b": ("h2", 5), "c": ("h3", 1)}
    entries, dirty = spark.createDataFrame([], LISTED + ", hash string"), spark.createDataFrame([], "path string")

    def refresh():
        nonlocal entries
        (own, anew), (known, _) = held[0].get(), held[1].get()
        listed = spark.createDataFrame([(k, 1, True, True) for k in contents], LISTED)
        table = spark.createDataFrame([(k, *v) for k, v in contents.items()], "relpath string, hash string, words int")
        got = refreshed(entries, listed, dirty, lambda due: due.join(table, "relpath"), least_words=own["least"], forced=anew)
        entries = spark.createDataFrame(got.collect(), got.schema)
        pending = entries.where("hash is not null").join(known.withColumnRenamed("hash", "old"), "relpath", "left").where("not (hash <=> old)")
        snapshot = {r.scope: (r.total, [x.relpath for x in r["items"]]) for r in pending_snapshot(pending.selectExpr("'all' as scope", "relpath", "mtime")).collect()}
        return {r.relpath for r in entries.where("scanned").collect()}, snapshot.get("all", (0, []))

    assert refresh() == ({"a", "b", "c"}, (1, ["b"])) and reads == ["config", "state"]
    assert refresh() == ({"c"}, (1, ["b"])) and reads == ["config", "state"]
    write_state(spark.createDataFrame([("a", "h1"), ("b", "h2")], "relpath string, hash string"), str(tmp_path / "state"))
    clock["state"] = 2
    assert refresh() == ({"c"}, (0, [])) and reads == ["config", "state", "state"]
    (tmp_path / "config.json").write_text('{"notes_paths": ["."], "least": 1}')
    clock["config"] = 2
    assert refresh() == ({"a", "b", "c"}, (1, ["c"])) and reads == ["config", "state", "state", "config"]
