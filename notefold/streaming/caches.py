"""What a refresh reads again only when its file has changed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file changed last (ms), by whatever file system its path names; null where it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(p).getModificationTime() if files.exists(p) else None


class ByTime(Generic[T]):
    """A value read from a file, kept while the file's time stays the same.

    A missing file gives `missing` and is no reload; what cannot be read gives
    it too, is a reload, and is tried again at the next call (with `strict` the
    error goes to the caller).
    """

    def __init__(self, time_of: Callable[[], int | None], read: Callable[[], T], missing: T | None = None, strict: bool = False):
        self._time_of, self._read, self._missing, self._strict = time_of, read, missing, strict
        self._held: tuple[int, T] | None = None

    def get(self) -> tuple[T | None, bool]:
        """The value, and whether it was read anew."""
        now = self._time_of()
        if now is None:
            self._held = None
            return self._missing, False
        if self._held and self._held[0] == now:
            return self._held[1], False
        try:
            self._held = (now, self._read())
        except (OSError, ValueError):
            self._held = None
            if self._strict:
                raise
            return self._missing, True
        return self._held[1], True
