"""Exact centroid clustering in whole numbers, with an annulus search for each vector's nearest centroid.

1. Vectors become whole numbers, and go as blocks of rows to the shared folder
   once; every round reads the blocks.
2. In a round centroids are sorted by length, and binary searches find a
   vector's place among them and the run of those whose length is within u of
   the vector's: no other can be as near, if u is the distance of one already
   compared.  Comparing goes outwards from the place, so u and the run shrink
   early.  It is exact, those on the boundary included, and ties go to the
   smallest number.
3. A task sends a sum and a count for each centroid that it meets; what is
   merged does not grow with the vectors.  The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import cut, lean, parallelism, small_batches
from notefold.llm.vectors import finite, matrix

#: Components are held within this bound: the squared distance of 64 of them is a 64-bit integer.
MOST = 1 << 27
#: Vectors in a block.
BLOCK = 2048
#: Share by which an annulus is widened for rounding; candidates are compared in integers.
SLACK = 1e-9
_BLOCKS = "ids binary, known binary, data binary"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(vec_id, v) of the rows with exactly dim components, none null or non-finite."""
    v = vectors[vector_col].cast("array<double>")
    return vectors.where(finite(v) & (F.size(v) == dim)).select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))


def _integers(v: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * v), -MOST, MOST).astype(np.int32)


def _pack(scale: float, dim: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def row(parts: list) -> pa.RecordBatch:
            ids, known, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (ids, known, x)], names=["ids", "known", "data"])

        for b in batches:
            ids = b["vec_id"]
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), _integers(matrix(b["v"], dim), scale)))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield row(held)
                held = []
        if held:
            yield row(held)

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each row (ties: the smallest), its squared distance, and how many were compared."""
    length = np.sqrt((centroids.astype(float) ** 2).sum(1))
    order = np.lexsort((np.arange(len(centroids)), length))
    c, length = centroids[order].astype(np.int64), length[order]
    own = np.sqrt((x.astype(float) ** 2).sum(1))
    best = np.full(len(x), np.iinfo(np.int64).max)
    label = np.full(len(x), len(centroids))
    low, high = np.zeros(len(x), int), np.full(len(x), len(c))
    compared = 0

    def compare(rows: np.ndarray, k: np.ndarray) -> None:
        """Compare rows with a centroid each, and narrow the annulus of those that come nearer."""
        nonlocal compared
        compared += len(rows)
        d = ((x[rows] - c[k]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (order[k] < label[rows]))
        rows = rows[better]
        best[rows], label[rows] = d[better], order[k[better]]
        u = np.sqrt(best[rows].astype(float)) * (1 + SLACK) + SLACK * own[rows] + SLACK
        low[rows], high[rows] = np.searchsorted(length, own[rows] - u), np.searchsorted(length, own[rows] + u, "right")

    place = np.searchsorted(length, own)
    for step in range(len(c)):  # from a vector's own length outwards
        above, below = place + step, place - 1 - step
        up, down = np.flatnonzero(above < high), np.flatnonzero(below >= low)
        if not len(up) and not len(down):
            break
        compare(up, above[up])
        compare(down[below[down] >= low[down]], below[down[below[down] >= low[down]]])
    return label, best, compared


def _read(b: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for ids, known, data in zip(b["ids"], b["known"], b["data"], strict=True):
        yield np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(known.as_buffer(), bool), np.frombuffer(data.as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)


def _sums(centroids: np.ndarray):
    """A row (cluster, n, compared, sums) for each cluster that a task's vectors are in."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, total, compared = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for b in batches:
            for _, _, x in _read(b, dim):
                label, _, made = nearest(x, centroids)
                compared += made
                order = np.argsort(label, kind="stable")
                first = np.flatnonzero(np.diff(label[order], prepend=-1))
                met = label[order][first]
                total[met] += np.add.reduceat(x[order], first)
                n[met] += np.diff(np.append(first, len(label)))
        met = np.flatnonzero(n)
        spread = np.where(np.arange(len(met)) == 0, compared, 0)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(spread, pa.int64()), pa.array([t.tobytes() for t in total[met]], pa.binary())], names=["cluster", "n", "compared", "sums"])

    return run


_SUMS = "cluster int, n long, compared long, sums binary"


def _together(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(s, np.int64) for s in rows["sums"].to_pylist()], axis=0)
    column = lambda c: sum(rows[c].to_pylist())
    return pa.table([pa.array([rows["cluster"][0].as_py()], pa.int32()), pa.array([column("n")]), pa.array([column("compared")]), pa.array([total.tobytes()], pa.binary())], names=["cluster", "n", "compared", "sums"])


def _assign(centroids: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, known, x in _read(b, centroids.shape[1]):
                label, distance, _ = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(label.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def starts(rows: DataFrame, k: int, label: str = "3") -> list[list[float]]:
    """The vectors of the k ids with the smallest sha256 of `label:id`, in order of the hash; rows without an id never start a cluster, and of rows of one id the smaller vector comes first."""
    hashed = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{label}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [r.v for r in hashed.orderBy("h", "v").limit(k).collect()]  # k rows


def packed(rows: DataFrame, scale: float = 1024, dim: int = 64) -> DataFrame:
    """Blocks of whole vectors of rows (vec_id, v), kept in the shared folder."""
    small_batches(rows.sparkSession)
    return cut(rows.mapInArrow(_pack(scale, dim), _BLOCKS), "vectors")


def moved(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The centroids after a round (whole means, rounded down; those without vectors stay), and how many distances it took."""
    out, compared = centroids.copy(), 0
    tasks = blocks.mapInArrow(_sums(centroids), _SUMS)
    for width in (8 * parallelism(blocks.sparkSession), 1):  # of a centroid that many tasks meet, parts come together first
        tasks = tasks.groupBy("cluster", F.pmod(F.hash("sums"), F.lit(width)).alias("part")).applyInArrow(_together, _SUMS)
    for r in tasks.collect():  # a row a centroid
        out[r.cluster] = [s // r.n for s in np.frombuffer(r.sums, np.int64).tolist()]
        compared += r.compared
    return out, compared


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids (whole numbers, a row each).

    Kept are vectors of exactly dim components, none null or non-finite; each
    becomes floor(scale * x), held within 2^27.  Rows with a null or repeated
    id are vectors each.  With fewer than k ids there are fewer clusters; with
    none, or no vectors, the result is empty.  distance is squared.
    """
    rows = whole_vectors(vectors, id_col, vector_col, dim)
    own = starts(rows, k)
    centroids = _integers(np.array(own, float).reshape(len(own), dim), scale).astype(np.int64)
    none = vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
    if not len(centroids):
        return none, centroids
    blocks = packed(rows, scale, dim)
    for _ in range(rounds):
        after, _ = moved(blocks, centroids)
        if (after == centroids).all():
            break  # nothing moves any more
        centroids = after
    return blocks.mapInArrow(_assign(centroids), none.schema), centroids


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector; see cluster.

    An inertia that is no 64-bit integer is null.
    """
    found, centroids = cluster(vectors, k, rounds, dim, scale)
    labelled = cut(found, "labels")
    per = {r.cluster: r.s for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    fits = lambda s: int(s) if s < 1 << 63 else None
    whole = fits(sum(per.values()))
    rows = [(c, fits(s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    about = labelled.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
