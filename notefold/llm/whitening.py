"""Whitened embeddings by a tall-skinny QR; the covariance is never formed.

1. Components become integers.  Tasks sum them exactly; a tree merges the sums.
2. Tasks centre their rows by the exact sums and keep the R factor of a QR of
   all rows so far; a tree stacks R factors and factors them again.
3. The SVD of the last R gives the right singular vectors (the components) and
   the eigenvalues, from singular values and never from squares of the data.
4. Tasks project the centred rows.  How far the result is from white is
   measured over all rows, centred before multiplying, and merged in a tree.

A state of a task is a matrix of the vector's width, whatever the number of
rows; the driver gets one.  The vectors are read once for each step.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import lean, parallelism, small_batches
from notefold.llm.vectors import finite, matrix, merged, states

#: Components are held within this bound, far beyond what a float can say exactly of them.
MOST = 1 << 52
#: Sums are kept as two halves, so that they stay exact for any number of rows.
HALF = 26
#: Singular values below this share of the largest are rounding, not variance.
NOTHING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n rows, whole sums by dimension, components in columns, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def _unpacked(state: bytes, count: int) -> list[np.ndarray]:
    own = io.BytesIO(state)
    return [np.load(own, allow_pickle=False) for _ in range(count)]


def _whole(vectors: pa.ListArray, scale: float, dim: int | None = None) -> np.ndarray:
    return np.clip(np.floor(scale * matrix(vectors, dim)), -MOST, MOST).astype(np.int64)


def _sums(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        parts = []
        for b in batches:
            x = _whole(b["v"], scale)
            parts.append(_packed(np.array([len(x), 0]), np.stack([(x >> HALF).sum(0), (x & ((1 << HALF) - 1)).sum(0)])))
            if len(parts) == 64:
                parts = [_add(parts)]
        own = _add(parts) if parts else _packed(np.zeros(2, np.int64), np.zeros((2, 0), np.int64))
        n, s = _unpacked(own, 2)
        return _packed(np.array([n[0], 1]), s)  # one task more

    return run


def _add(found: list[bytes]) -> bytes:
    counts, sums = zip(*(_unpacked(x, 2) for x in found), strict=True)
    total = np.zeros((2, max(s.shape[1] for s in sums)), np.int64)
    for s in sums:
        total[:, : s.shape[1]] += s
    total[0] += total[1] >> HALF  # carry
    total[1] &= (1 << HALF) - 1
    return _packed(np.sum(counts, 0), total)


def _centred(vectors: pa.ListArray, scale: float, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts x - q and the rest r of rows less their means q + r / n: exact as (x - q) * n - r."""
    q = np.array([s // n for s in sums], np.int64)
    return _whole(vectors, scale, len(sums)) - q, np.array([s % n for s in sums], np.int64)


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _r_of(scale: float, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        r = np.zeros((0, len(sums)))
        for b in batches:
            whole, rest = _centred(b["v"], scale, n, sums)
            r = _factor(np.concatenate([r, whole - rest / n]))
        return _packed(r)

    return run


def _stack(found: list[bytes]) -> bytes:
    r = _unpacked(found[0], 1)[0]
    for x in found[1:]:
        r = _factor(np.concatenate([r, _unpacked(x, 1)[0]]))
    return _packed(r)


def _spread(fit: Whitening, scale: float):
    """Count, means and centred products of the whitened rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> bytes:
        k = len(fit.eigenvalues)
        held = _packed(np.zeros(1), np.zeros(k), np.zeros((k, k)))
        for b in batches:
            w = _projected(b["v"], fit, scale)[0]
            if len(w):
                mean = w.mean(0)
                held = _pooled([held, _packed(np.array([float(len(w))]), mean, (w - mean).T @ (w - mean))])
        return held

    return run


def _pooled(found: list[bytes]) -> bytes:
    n, mean, m2 = _unpacked(found[0], 3)
    for x in found[1:]:
        own_n, own, own_m2 = _unpacked(x, 3)
        if total := n[0] + own_n[0]:
            gap = own - mean
            m2 = m2 + own_m2 + np.outer(gap, gap) * (n[0] * own_n[0] / total)
            mean = mean + gap * (own_n[0] / total)
            n = np.array([total])
    return _packed(n, mean, m2)


def _projected(vectors: pa.ListArray, fit: Whitening, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole, rest = _centred(vectors, scale, fit.n, fit.sums)
    return (whole - rest / fit.n) @ (fit.components / np.sqrt(fit.eigenvalues)), whole, rest


def _deviations(whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; None where one is no 64-bit integer."""
    most = int(np.abs(whole).max(initial=0)) * n + n
    if most * most * max(1, whole.shape[1]) < 1 << 63:
        return ((whole * n - rest) ** 2).sum(1).tolist()
    own = [sum((x * n - r) ** 2 for x, r in zip(row, rest.tolist(), strict=True)) for row in whole.tolist()]
    return [d if d < 1 << 63 else None for d in own]


def _whiten(fit: Whitening, scale: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, whole, rest = _projected(b["v"], fit, scale)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(_deviations(whole, rest, fit.n), pa.int64()), each], names=["vec_id", "deviation", "whitened"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector is there and has numbers only."""
    v = vectors[vector_col].cast("array<double>")
    return vectors.where(finite(v)).select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"))


def fitted(rows: DataFrame, most: int = 32, scale: float = 64) -> Whitening | None:
    """The whitening of rows (vec_id, v) by at most `most` components; None without a row."""
    small_batches(rows.sparkSession)
    vectors = rows.select("v")
    total = merged(states(vectors, _sums(scale)), _add, parallelism(rows.sparkSession))
    (n, tasks), halves = _unpacked(total, 2) if total else (np.zeros(2, np.int64), None)
    n, tasks = int(n), int(tasks)
    if not n:
        return None
    sums = [(int(hi) << HALF) + int(lo) for hi, lo in halves.T]  # without the shift, which centring takes away again
    r = _unpacked(merged(states(vectors, _r_of(scale, n, sums)), _stack, tasks), 1)[0]
    _, s, right = np.linalg.svd(r, full_matrices=False)
    kept = min(most, int((s > NOTHING * s.max(initial=0) * max(1, len(sums))).sum()) if s.max(initial=0) > 0 else 0)
    return Whitening(n, sums, np.ascontiguousarray(right[:kept].T), s[:kept] ** 2 / n, float((s**2).sum() / n))


def identity_error(rows: DataFrame, fit: Whitening, scale: float = 64) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    if not len(fit.eigenvalues):
        return 0.0
    found = merged(states(rows.select("v"), _spread(fit, scale)), _pooled, parallelism(rows.sparkSession))
    n, _, m2 = _unpacked(found, 3)
    return float(np.abs(m2 / n[0] - np.eye(len(m2))).max())


def whitened(rows: DataFrame, fit: Whitening, scale: float = 64) -> DataFrame:
    """vec_id, deviation, whitened (an array, a number for each component) of rows (vec_id, v)."""
    return rows.select("vec_id", "v").mapInArrow(_whiten(fit, scale), "vec_id long, deviation long, whitened array<double>")


def whitening_rows(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows with a null vector, or a null or non-finite component, are dropped;
    rows with a null or repeated id are rows each.  A shorter vector (an empty
    one too) counts as padded with zeros.  x = floor(64 * c) + 1000000, where
    floor(64 * c) is held within 2^52; deviation is null where it is no 64-bit
    integer.  Components without variance (equal vectors, fewer rows than
    dimensions) cannot be whitened and are left out: one row, or equal rows
    only, give no rows, as an empty table does.  Of components with equal
    eigenvalues any orthogonal choice may come.  Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    fit = fitted(rows, most)
    if fit is None or not len(fit.eigenvalues):
        none = rows.where(F.lit(False))
        return none.select("vec_id", F.lit(1).alias("component"), *(F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    error, share = identity_error(rows, fit), F.array(*map(F.lit, fit.explained))
    each = whitened(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
