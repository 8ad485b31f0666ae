"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds.

1. Vectors become integers, are sorted by descending length across partitions
   and packed in blocks.
2. The Gram matrix (its size depends on the dimension alone) gives a rotation
   that puts most of the length in the first coordinates.
3. Groups of query blocks meet stripes of candidate blocks, every group every
   stripe, so a block is sent once for each group or stripe of some 16,000
   vectors and not for each block.  A stripe takes its blocks by descending
   length.  It stops for a query once length
   times length is under the query's k-th best score.  Within a block, the
   partial sum of the first coordinates plus the product of the residual
   lengths bounds the score; only candidates whose bound reaches the k-th best
   are scored, exactly, in integers.
4. The stripes' best are ranked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.llm.common import cut, lean, parallelism, small_batches

#: Blocks of candidates in a stripe, and of queries in a group, where there are many: 8 MB each at 64 dimensions.
STRIPE, GROUP = 16, 64
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_BLOCKS = "block long, dim int, norm double, ids binary, data binary"


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, norm): components as floor(scale * x); without null ids, null vectors, null or non-finite components."""
    x = vectors[vector_col].cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    ok = vectors.where(vectors[id_col].isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return ok.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).withColumn("norm", norm)


def _pack(most: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal serial
            dim = max(len(v) for _, v, _ in held)
            m = np.zeros((len(held), dim), np.int64)
            for k, (_, v, _) in enumerate(held):
                m[k, : len(v)] = v
            cols = [pa.array([(part << 32) | serial]), pa.array([dim], pa.int32()), pa.array([max(x for *_, x in held)], pa.float64()), pa.array([np.array([i for i, *_ in held]).tobytes()]), pa.array([m.tobytes()])]
            serial += 1
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["block", "dim", "norm", "ids", "data"])

        for b in batches:
            for x in zip(b["vec_id"].to_pylist(), b["v"].to_pylist(), b["norm"].to_pylist(), strict=True):
                held.append(x)
                if len(held) == most:
                    yield row()
        if held:
            yield row()

    return run


def _blocks(rows: DataFrame, most: int, parts: int) -> DataFrame:
    order = [F.col("norm").desc(), F.col("vec_id")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(most), _BLOCKS)


def _gram(dim: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            for d, data in zip(b["dim"].to_pylist(), b["data"].to_pylist(), strict=True):
                if not d:
                    continue  # empty vectors only
                m = np.frombuffer(data, np.int64).reshape(-1, d).astype(float)
                g[:d, :d] += m.T @ m
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g.ravel())], names=["at", "g"])

    return run


def _best(k: int, turn: np.ndarray, head: int):
    dim = len(turn)

    def rotated(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, ...]:
        m = np.zeros((len(ids) // 8, dim), np.int64)
        m[:, :d] = np.frombuffer(data, np.int64).reshape(len(m), d)
        r = m @ turn
        return np.frombuffer(ids, np.int64), m, r[:, :head], np.sqrt((r[:, head:] ** 2).sum(1)), np.sqrt((r**2).sum(1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [rotated(*x) for x in zip(right["ids"].to_pylist(), right["data"].to_pylist(), right["dim"].to_pylist(), strict=True)]
        best: list[dict] = [{} for _ in asked]
        least = [np.full(len(q[0]), -np.inf) for q in asked]
        for x in left.sort_by([("norm", "descending"), ("block", "ascending")]).to_pylist() if asked else ():
            c = None
            for q, top, low in zip(asked, best, least, strict=True):
                live = np.flatnonzero(q[4] * x["norm"] * (1 + 1e-9) + 1e-3 >= low)
                if not len(live):
                    continue
                c = c or rotated(x["ids"], x["data"], x["dim"])
                bound = q[2][live] @ c[2].T + np.outer(q[3][live], c[3])
                slack = 1e-9 * np.outer(q[4][live], c[4]) + 1e-3
                for row, i in enumerate(live):
                    j = np.flatnonzero((bound[row] + slack[row] >= low[i]) & (c[0] != q[0][i]))
                    if len(j):
                        ids, scores = np.r_[top.get(i, ((), ()))[0], c[0][j]].astype(np.int64), np.r_[top.get(i, ((), ()))[1], c[1][j] @ q[1][i]].astype(np.int64)
                        order = np.lexsort((ids, -scores))[:k]
                        top[i] = ids[order], scores[order]
                        if len(order) == k:
                            low[i] = scores[order[-1]]
        parts = [rows(q, top) for q, top in zip(asked, best, strict=True)]
        return pa.Table.from_batches(parts, _FOUND) if parts else _FOUND.empty_table()

    def rows(q, top) -> pa.RecordBatch:
        own = np.concatenate([np.full(len(v[0]), q[0][i]) for i, v in top.items()] or [np.zeros(0, np.int64)])
        ids, scores = (np.concatenate([v[s] for v in top.values()] or [np.zeros(0, np.int64)]) for s in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with the other rows.

    is_query is a condition on vec_id.  Ties go to the smaller vec_id.  Rows
    with a null id, a null vector, or a null or non-finite component take no
    part.  A shorter vector counts as padded with zeros, and an empty one as zeros only.  Rows that repeat an id are
    candidates each (of equal ids any order), and queries as one; a row is never matched
    with its own id.  Scores are 64-bit integers.  Fewer candidates than k give
    all of them; without queries or candidates the result is empty.  Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows, parts = integers(vectors, id_col, vector_col, scale), parallelism(spark)
    candidates = cut(_blocks(rows, block, parts), "vectors")
    asked = cut(_blocks(rows.where(is_query).dropDuplicates(["vec_id"]), block // 4, max(1, parts // 8)), "queries")
    dim = candidates.agg(F.max("dim")).first()[0] or 1
    gram = np.zeros(dim * dim)
    for at, g in candidates.select("dim", "data").mapInArrow(_gram(dim), "at long, g double").groupBy("at").agg(F.sum("g")).collect():  # dim * dim numbers
        gram[at] = g
    _, turn = np.linalg.eigh(gram.reshape(dim, dim))
    turn = np.ascontiguousarray(turn[:, ::-1])
    n_candidates, n_queries = candidates.count(), asked.count()
    stripes, groups = max(1, min(n_candidates, parts), -(-n_candidates // STRIPE)), max(1, -(-n_queries // GROUP))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("*", dealt(stripes).alias("stripe"), every(groups).alias("group")).groupBy("stripe", "group")
    right = asked.select("*", dealt(groups).alias("group"), every(stripes).alias("stripe")).groupBy("stripe", "group")
    best = left.cogroup(right).applyInArrow(_best(k, turn, max(1, dim // 4)), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
