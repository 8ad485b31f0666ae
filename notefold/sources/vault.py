"""Folders of notes as a data source of Spark: batches, a stream of what changes, and writes that happen together.

    spark.dataSource.register(VaultSource)        (see registered)
    spark.read.format("notes").option("scopes", '["a", "b/c"]').load(root)
    spark.readStream.format("notes").load(root)
    rows.write.format("notes").mode("append").save(root)

Rows are (relpath, mtime, content); mtime in milliseconds.  The folder is of any
file system that pyarrow knows and all executors share.  A batch plans folders,
not files: tasks list theirs and open what the pushed scopes, names and times
let through, so nothing else is ever opened.
"""

from __future__ import annotations

import json
import os
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = "relpath string, mtime long, content binary"
SUFFIX = ".md"
#: Where writes are staged, under the root; no scan looks into it.
STAGING = ".notefold-staging"
#: Folders that a plan names one by one; what lies deeper is listed by tasks.
FOLDERS = 256
_ARROW = pa.schema([("relpath", pa.string()), ("mtime", pa.int64()), ("content", pa.binary())])


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(root))
    return fs, path.rstrip("/") or "/"


def usable_scopes(scopes: Iterable[str] | None) -> list[str]:
    """Folders without those that lie in another; the root alone where all is wanted."""
    own = sorted({posixpath.normpath(s.replace("\\", "/").strip("/") or ".") for s in (["."] if scopes is None else scopes)})
    own = [s for s in own if s.split("/")[0] != ".."]
    return ["."] if "." in own else [s for k, s in enumerate(own) if not any(s.startswith(f"{t}/") for t in own[:k])]


@dataclass(frozen=True)
class Wanted:
    """What a scan lets through: folders, a start of names, one name, and times in (after, upto]."""

    root: str
    scopes: tuple[str, ...] = (".",)
    start: str = ""
    name: str | None = None
    after: int = -1
    upto: int | None = None

    def path_ok(self, rel: str) -> bool:
        return rel.startswith(self.start) and (self.name is None or rel == self.name)

    def time_ok(self, mtime: int) -> bool:
        return mtime > self.after and (self.upto is None or mtime <= self.upto)

    def folder_ok(self, rel: str) -> bool:
        """Whether a folder can hold a path that is let through."""
        own = f"{rel}/"
        return all(own.startswith(x) or x.startswith(own) for x in (self.start, self.name or own))


@dataclass
class Folder(InputPartition):
    """Folders that a task lists: with all below them, or their own files only."""

    folders: list[tuple[str, bool]]

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(folders)
        self.folders = folders


def _entries(fs: pafs.FileSystem, root: str, folder: str, deep: bool = False) -> list[pafs.FileInfo]:
    return fs.get_file_info(pafs.FileSelector(root if folder == "." else f"{root}/{folder}", allow_not_found=True, recursive=deep))


def _rel(root: str, path: str) -> str:
    return posixpath.relpath(path, root)


def _millis(info: pafs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1_000_000


def planned(wanted: Wanted) -> list[Folder]:
    """Partitions: folders opened level by level until there are FOLDERS, each then with all below it."""
    fs, root = opened(wanted.root)
    level, done = [s for s in wanted.scopes if s == "." or wanted.folder_ok(s)], []
    while level and len(level) + len(done) < FOLDERS:
        below = [_rel(root, e.path) for f in level for e in _entries(fs, root, f) if e.type == pafs.FileType.Directory and e.base_name != STAGING]
        done += [(f, False) for f in level]
        level = [f for f in below if wanted.folder_ok(f)]
    own = [*done, *((f, True) for f in level)]
    share = max(1, -(-len(own) // FOLDERS))
    return [Folder(own[k : k + share]) for k in range(0, len(own), share)] or [Folder([])]  # without any, a scan would read one anyway


def found(wanted: Wanted, part: Folder) -> Iterator[tuple[str, int, pafs.FileSystem, str]]:
    """relpath, mtime, file system and path of what a partition lets through; nothing is opened."""
    fs, root = opened(wanted.root)
    for folder, deep in part.folders:
        for e in _entries(fs, root, folder, deep):
            rel = _rel(root, e.path)
            if e.type != pafs.FileType.Directory and rel.endswith(SUFFIX) and STAGING not in rel.split("/") and wanted.path_ok(rel) and wanted.time_ok(_millis(e)):
                yield rel, _millis(e), fs, e.path


def batches(wanted: Wanted, part: Folder, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The files of a partition, in batches of some megabytes."""
    held: list[tuple[str, int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for rel, mtime, fs, path in found(wanted, part):
        with fs.open_input_stream(path) as f:
            data = f.read()
        held.append((rel, mtime, data))
        size += len(data)
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class VaultReader(DataSourceReader):
    def __init__(self, wanted: Wanted):
        self.wanted = wanted

    def partitions(self) -> list[InputPartition]:
        return planned(self.wanted)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return batches(self.wanted, partition)


class PrunedVaultReader(VaultReader):
    """Takes filters on relpath and mtime from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if isinstance(f, StringStartsWith) and column == ("relpath",) and (f.value.startswith(self.wanted.start) or self.wanted.start.startswith(f.value)):
                self.wanted = replace(self.wanted, start=max(self.wanted.start, f.value, key=len))
            elif isinstance(f, EqualTo) and column == ("relpath",) and self.wanted.name is None:
                self.wanted = replace(self.wanted, name=f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and column == ("mtime",):
                self.wanted = replace(self.wanted, after=max(self.wanted.after, f.value - isinstance(f, GreaterThanOrEqual)))
            else:
                yield f


class VaultStream(DataSourceStreamReader):
    """Files by the time of their last change: a micro-batch has those in (start, end]. What changes again comes again.

    The end is the newest time that lies `settle` milliseconds back, so that a
    file that is still being written, or shares its millisecond with one to
    come, waits.  Files put there with an older time than the end are not seen;
    nor are those that go: a scan of the whole folder tells.
    """

    def __init__(self, wanted: Wanted, settle: int):
        self.wanted, self.settle = wanted, settle

    def initialOffset(self) -> dict:
        return {"mtime": self.wanted.after}

    def latestOffset(self) -> dict:
        newest = replace(self.wanted, upto=int(time.time() * 1000) - self.settle)
        return {"mtime": max((m for part in planned(newest) for _, m, *_ in found(newest, part)), default=self.wanted.after)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(p.folders, start["mtime"], end["mtime"]) for p in planned(self.wanted)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(replace(self.wanted, after=partition.after, upto=partition.upto), partition)

    def commit(self, end: dict) -> None:
        pass


class Range(Folder):
    """Folders, and the times that a micro-batch takes of them."""

    def __init__(self, folders: list[tuple[str, bool]], after: int, upto: int):
        super().__init__(folders)
        self.after, self.upto = after, upto


@dataclass
class Staged(WriterCommitMessage):
    """The list of a task's staged files: a path, not the files' names."""

    listed: str
    count: int


class VaultWriter(DataSourceWriter):
    """Writes of (relpath, content): tasks stage files and a list of them; once all tasks are done the driver moves each into its place.

    A task that fails leaves the notes as they were.  A file keeps its mode.
    """

    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        fs, root = opened(self.root)
        stage, names = f"{root}/{STAGING}/{self.run}/{uuid.uuid4().hex}", []
        fs.create_dir(stage, recursive=True)
        for k, row in enumerate(iterator):
            rel = row.relpath
            if posixpath.isabs(rel) or ".." in rel.split("/"):
                raise ValueError(f"not a path within the root: {rel}")
            with fs.open_output_stream(f"{stage}/{k}") as f:
                f.write(bytes(row.content))
            names.append(json.dumps([f"{stage}/{k}", rel]))
        with fs.open_output_stream(f"{stage}/listed") as f:
            f.write("\n".join(names).encode())
        return Staged(f"{stage}/listed", len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = opened(self.root)
        for m in messages:
            if m is None:
                continue
            with fs.open_input_stream(m.listed) as f:
                lines = f.read().decode().splitlines()
            for line in lines:
                staged, rel = json.loads(line)
                target = f"{root}/{rel}"
                if isinstance(fs, pafs.LocalFileSystem):
                    if os.path.exists(target):
                        os.chmod(staged, os.stat(target).st_mode & 0o7777)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    os.replace(staged, target)
                else:
                    fs.move(staged, target)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = opened(self.root)
        for folder, own in ((f"{root}/{STAGING}/{self.run}", True), (f"{root}/{STAGING}", False)):
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (own or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


class VaultSource(DataSource):
    """Options: scopes (a JSON list of folders), after (milliseconds), settle (milliseconds, streams), pushdown (true where the session lets Python sources take filters)."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def _wanted(self) -> Wanted:
        own = self.options.get("scopes")
        return Wanted(self.options["path"], tuple(usable_scopes(json.loads(own) if own else None)), after=int(self.options.get("after", -1)))

    def reader(self, schema) -> VaultReader:
        kind = PrunedVaultReader if self.options.get("pushdown") == "true" else VaultReader
        return kind(self._wanted())

    def streamReader(self, schema) -> VaultStream:
        return VaultStream(self._wanted(), int(self.options.get("settle", 2000)))

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        if overwrite:
            raise ValueError("notes are written in append mode: files that are not written stay")
        return VaultWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format `notes` and pushes filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultSource)
    return spark
