"""A vector index in buckets: bases and appended deltas, merged when read, compacted by bucket.

A bucket holds the rows of the paths that hash to it.  A commit appends files of
the buckets that it touches and then a manifest, the list of the files that
count; the newest manifest is the index, so a commit that breaks off changes
nothing.  Of two commits at a time one fails: a manifest's name is taken once.

A delta has a row without a chunk (a tombstone) for each path that it writes or
drops: older rows of that path do not count.  A bucket whose deltas are over a
share of its base is written anew, alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, chunk int, v array<double>"
_STORED = ROWS + ", version long, bucket int"


@dataclass(frozen=True)
class Part:
    """The files of one commit in one bucket: version, bucket, folder, rows, and whether older parts of the bucket are in them."""

    version: int
    bucket: int
    folder: str
    rows: int
    base: bool


class VectorIndex:
    """(path, chunk, v) by path, under a folder that all executors share; any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())
        first = self._manifest()
        self._buckets = first[1] if first else buckets  # fixed when the index is made

    def _path(self, *names: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path("/".join((self._folder, *names)))

    def _names(self, *names: str) -> list[str]:
        at = self._path(*names)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self) -> tuple[int, int, list[Part]] | None:
        """Version, number of buckets and parts of the newest manifest."""
        have = [n for n in self._names("manifest") if n.startswith("v")]
        if not have:
            return None
        stream = self._fs.open(self._path("manifest", have[-1]))
        try:
            own = json.loads(self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return int(have[-1][1:]), own["buckets"], [Part(**p) for p in own["parts"]]

    @property
    def version(self) -> int:
        own = self._manifest()
        return own[0] if own else 0

    def parts(self) -> list[Part]:
        own = self._manifest()
        return own[2] if own else []

    def _publish(self, version: int, parts: Iterable[Part]) -> None:
        text = json.dumps({"buckets": self._buckets, "parts": [asdict(p) for p in parts]})
        spare, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{version:012d}")
        self._fs.mkdirs(self._path("manifest"))
        out = self._fs.create(spare, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(spare, final):
            self._fs.delete(spare, False)
            raise RuntimeError(f"version {version} of the index was written by another run")

    def _bucket(self, path):
        return F.pmod(F.xxhash64(path), F.lit(self._buckets)).cast("int")

    def _written(self, rows: DataFrame, version: int, base: bool) -> list[Part]:
        """Files of rows (path, chunk, v), a folder a bucket, and the parts they are."""
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        own = rows.select("path", "chunk", "v", F.lit(version).cast("long").alias("version"), self._bucket("path").alias("bucket"))
        # a bucket's rows go to several files where they are many: its paths are dealt to tasks
        own.repartition("bucket", F.pmod(F.hash("path"), F.lit(8))).write.partitionBy("bucket").parquet(f"{self._folder}/{folder}")
        counts = self._spark.read.schema(_STORED).parquet(f"{self._folder}/{folder}").groupBy("bucket").count().collect()  # a row a bucket
        return [Part(version, r.bucket, f"{folder}/bucket={r.bucket}", r["count"], base) for r in counts]

    def _read(self, parts: Iterable[Part]) -> DataFrame:
        folders = [f"{self._folder}/{p.folder}" for p in parts]
        schema = ROWS + ", version long"
        return self._spark.read.schema(schema).parquet(*folders) if folders else self._spark.createDataFrame([], schema)

    def _merged(self, parts: list[Part]) -> DataFrame:
        """Rows that count: those that no tombstone of a later or the same commit drops, but for that commit's own."""
        stored, deltas = self._read(parts), self._read(p for p in parts if not p.base)
        last = deltas.where("chunk is null").groupBy("path").agg(F.max("version").alias("last"))
        live = stored.where("chunk is not null").join(last, "path", "left")
        return live.where(F.col("last").isNull() | (F.col("version") >= F.col("last"))).select("path", "chunk", "v")

    def rows(self, paths: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some paths, whose buckets alone are read."""
        parts = self.parts()
        if paths is None:
            return self._merged(parts)
        wanted = self._spark.createDataFrame([(p,) for p in paths], "path string")
        buckets = {r.b for r in wanted.select(self._bucket("path").alias("b")).distinct().collect()}
        return self._merged([p for p in parts if p.bucket in buckets]).join(F.broadcast(wanted.distinct()), "path", "left_semi")

    def count(self) -> int:
        return self.rows().count()

    def upsert(self, new: DataFrame, paths: DataFrame | None = None) -> int:
        """Put new rows (path, chunk, v) in place of all rows of their paths; paths (path) that have no new rows are dropped. The version that it made."""
        named = new.select("path") if paths is None else new.select("path").unionByName(paths.select("path"))
        stones = named.where("path is not null").distinct().select("path", F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("array<double>").alias("v"))
        return self._commit(new.where("chunk is not null").select("path", "chunk", "v").unionByName(stones))

    def remove(self, paths: DataFrame) -> int:
        return self._commit(paths.select("path").distinct().select("path", F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("array<double>").alias("v")))

    def _commit(self, rows: DataFrame) -> int:
        own = self._manifest()
        version, parts = (own[0] if own else 0) + 1, own[2] if own else []
        self._publish(version, [*parts, *self._written(rows, version, False)])
        return version

    def rebuild(self, rows: DataFrame) -> int:
        """The index anew from rows (path, chunk, v); nothing of the old one stays."""
        version = self.version + 1
        self._publish(version, self._written(rows.where("chunk is not null"), version, True))
        return version

    def compact(self, ratio: float = 0.5) -> list[int]:
        """Write anew the buckets whose deltas have over ratio times their base's rows; the buckets."""
        parts = self.parts()
        size = lambda b, base: sum(p.rows for p in parts if p.bucket == b and p.base == base)
        due = sorted(b for b in {p.bucket for p in parts} if size(b, False) > ratio * size(b, True))
        if due:
            version = self.version + 1
            made = self._written(self._merged([p for p in parts if p.bucket in due]), version, True)
            self._publish(version, [*(p for p in parts if p.bucket not in due), *made])
        return due

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the newest `keep`, and files that none of those names."""
        have = [n for n in self._names("manifest") if n.startswith("v")]
        live = set()
        for n in have[-keep:]:
            stream = self._fs.open(self._path("manifest", n))
            try:
                live |= {p["folder"] for p in json.loads(self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]}
            finally:
                stream.close()
        for n in have[:-keep]:
            self._fs.delete(self._path("manifest", n), False)
        newest = int(have[-1][1:]) if have else 0
        for commit in self._names("data"):
            if int(commit.split("-")[0]) <= newest:  # a later one is being written
                for b in self._names("data", commit):
                    if b.startswith("bucket=") and f"data/{commit}/{b}" not in live:
                        self._fs.delete(self._path("data", commit, b), True)
