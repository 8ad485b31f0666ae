"""Vectors as numpy matrices inside tasks, and small states of tasks merged in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import lean

STATE = "part int, state binary"
#: States that one task of a tree's level merges.
FAN = 8


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def matrix(vectors: pa.ListArray, dim: int | None = None) -> np.ndarray:
    """One row a vector; a shorter one is padded with zeros. Without dim the longest gives the width."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    dim = (int(sizes.max()) if len(sizes) else 0) if dim is None else dim
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def states(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], bytes]) -> DataFrame:
    """(part, state): what run makes of the batches of each partition."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([run(batches)], pa.binary())], names=["part", "state"])

    return rows.mapInArrow(task, STATE)


def merged(parts: DataFrame, combine: Callable[[list[bytes]], bytes], tasks: int) -> bytes | None:
    """The states of some `tasks` partitions as one: levels of a tree in which a task merges a few states at a time; None without any."""

    def level(rows: pa.Table) -> pa.Table:
        own = rows.sort_by("part")
        return pa.table([pa.array([own["part"][0].as_py()], pa.int32()), pa.array([combine(own["state"].to_pylist())], pa.binary())], names=["part", "state"])

    width = tasks
    while width > 1:
        width = -(-width // FAN)
        parts = parts.groupBy(F.pmod("part", F.lit(width)).alias("to")).applyInArrow(level, STATE)
    found = [r.state for r in parts.collect()]  # one state, or none
    return combine(found) if found else None
