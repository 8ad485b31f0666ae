"""The vault as a data source: nothing outside is opened, batch and stream agree, writes happen together."""

import json
import os
import stat
import time

import pytest
from pyspark.sql import functions as F

from notefold.sources.vault import STAGING, Wanted, found, planned, registered, usable_scopes


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for k in range(12):
        path = root / ("a", "b/c", "d", "d/e/f")[k % 4] / f"n{k}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"note {k} é\r\n")
        os.utime(path, (1_000 + k, 1_000 + k))
    (root / "a" / "x.txt").write_text("no note")
    (root / "empty.md").write_bytes(b"")
    os.utime(root / "empty.md", (2_000, 2_000))
    return root


def texts(df):
    return {r.relpath: bytes(r.content) for r in df.collect()}


def files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*.md")}


def test_batch(spark, vault):
    read = registered(spark).read.format("notes")
    assert texts(read.load(str(vault))) == files(vault)
    assert texts(read.load(f"file://{vault}")) == files(vault)
    assert read.load(str(vault)).where("relpath = 'a/n0.md'").select("mtime").first()[0] == 1_000_000
    assert texts(read.load(str(vault / "missing"))) == {}


def test_what_is_outside_is_never_opened(spark, vault):
    for folder in ("b", "d"):
        (vault / folder / "trap.md").mkdir(mode=0)  # neither a note nor to be opened
        os.mkfifo(vault / folder / "pipe.md")  # whoever opens it waits for ever
    read = registered(spark).read.format("notes")
    scopes = lambda *s: read.option("scopes", json.dumps(s)).load(str(vault))
    assert set(texts(scopes("a", "b/c", "/a/"))) == {p for p in files_of(vault) if p.startswith(("a/", "b/c/"))}
    assert texts(scopes()) == {} and texts(scopes("missing", "../x")) == {}
    pushed = registered(spark).read.format("notes").option("pushdown", "true").load(str(vault))
    assert set(texts(pushed.where("relpath like 'd/e/%'"))) == {p for p in files_of(vault) if p.startswith("d/e/")}
    assert set(texts(pushed.where("relpath = 'a/n4.md'"))) == {"a/n4.md"}
    late = pushed.where(F.col("relpath").startswith("a/") & (F.col("mtime") >= 1_004_000) & (F.col("mtime") < 1_008_000))
    assert set(texts(late)) == {"a/n4.md"}


def files_of(root):
    return {str(p.relative_to(root)) for p in root.rglob("*.md") if p.is_file()}


def test_plans(vault):
    assert usable_scopes(["b", "b/c", "a\\x", "..", "b"]) == ["a/x", "b"] and usable_scopes(None) == usable_scopes(["a", "/"]) == ["."]
    parts = planned(Wanted(str(vault), start="d/e/"))
    assert {f for p in parts for f, _ in p.folders} == {".", "d", "d/e", "d/e/f"}
    assert sorted(rel for p in parts for rel, *_ in found(Wanted(str(vault), start="d/e/"), p)) == sorted(p for p in files_of(vault) if p.startswith("d/e/"))


def test_stream_gives_what_the_batch_has_and_then_what_changes(spark, vault, tmp_path):
    registered(spark)
    seen = []

    def go(until):
        stream = spark.readStream.format("notes").option("settle", 0).load(str(vault))
        q = stream.writeStream.foreachBatch(lambda b, _: seen.extend((r.relpath, bytes(r.content)) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        end = time.time() + 60
        while time.time() < end and len(seen) < until and q.isActive:
            time.sleep(0.3)
        q.stop()

    go(13)
    assert dict(seen) == files(vault) and len(seen) == 13
    (vault / "a" / "n0.md").write_text("changed")
    (vault / "new.md").write_text("new")
    go(15)
    assert dict(seen[13:]) == {"a/n0.md": b"changed", "new.md": b"new"} and dict(seen) == files(vault)


def test_writes_happen_together(spark, vault):
    registered(spark)
    os.chmod(vault / "a" / "n0.md", 0o640)
    rows = spark.createDataFrame([("a/n0.md", b"one"), ("fresh/deep/x.md", "é".encode()), ("empty.md", b"")], "relpath string, content binary").repartition(3)
    rows.write.format("notes").mode("append").save(str(vault))
    assert (vault / "a" / "n0.md").read_bytes() == b"one" and (vault / "fresh" / "deep" / "x.md").read_text() == "é"
    assert stat.S_IMODE(os.stat(vault / "a" / "n0.md").st_mode) == 0o640 and not (vault / STAGING).exists()
    before = files(vault)
    bad = rows.withColumn("content", F.when(F.col("relpath") == "empty.md", F.expr("cast(raise_error('broken') as binary)")).otherwise(F.col("content").cast("binary"))).withColumn("relpath", F.concat(F.lit("z/"), "relpath"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("notes").mode("append").save(str(vault))
    with pytest.raises(Exception, match="within the root"):
        rows.withColumn("relpath", F.lit("../x.md")).write.format("notes").mode("append").save(str(vault))
    assert files(vault) == before and not (vault / STAGING).exists()
