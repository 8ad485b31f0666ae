"""Best-fit packing planned on the histogram of lengths.

1. One pass over the texts makes pieces and counts, in each task, how many
   pieces of a length came before: (part, length, nth).
2. Counts by (part, length) give each part its first rank within a length, and
   the totals by length are the histogram: at most `size` numbers, whatever the
   corpus.
3. The driver runs best-fit decreasing over the histogram.  Sequences in the
   same state are one range, so it handles ranges and counts, never documents,
   and yields intervals of ranks: length, first rank, first sequence, items a
   sequence, offset.
4. A piece finds its interval by its rank within its length.

No step gathers rows by length, so a length that a third of the pieces share is
spread as the input is.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.llm.common import cut, lean, small_batches, texts
from notefold.llm.tokens import fast_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: one piece, or full pieces after a shorter first one."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def _pieces(vocabulary: str, size: int, end_id: int, with_ids: bool, added: bool):
    @lean
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), fast_encoder(vocabulary, added)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids, piece, start, length, crc, nth, data = [], [], [], [], [], [], []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw = encode(text) + end
                for k, (s, n) in enumerate(pieces_of(len(raw) // 4, size)):
                    own = raw[4 * s : 4 * (s + n)]
                    ids.append(doc)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(int(seen[n]))
                    seen[n] += 1
                    if with_ids:
                        data.append(own)
            cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(ids), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(data, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return make


def plan(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, items a sequence, offset), in order of length and rank."""
    open_: list[tuple[int, int, int]] = []  # (room left, first sequence, sequences), by room
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(open_, (length, -1, -1))
            if at < len(open_):
                room, first, n = open_.pop(at)
            else:
                room, n = size, -(-left // (size // length))
                first, sequences = sequences, sequences + n
            each = room // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, first, each, size - room))
                rank, left = rank + full * each, left - full * each
                if room - each * length:
                    insort(open_, (room - each * length, first, full))
            if full < n and left and left < each:
                slots.append((length, rank, first + full, each, size - room))
                if room - left * length:
                    insort(open_, (room - left * length, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                insort(open_, (room, first + full, n - full))
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    key = (slots[:, 0] << 48) | slots[:, 1]

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            s = slots[np.searchsorted(key, (length << 48) | rank, "right") - 1]
            nth = rank - s[:, 1]
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in keep), pa.array(s[:, 2] + nth // s[:, 3]), pa.array(s[:, 4] + nth % s[:, 3] * length)], names=[*keep, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, with_ids: bool = True, added: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document of docs in sequences of at most `size` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with with_ids, the ids as little-endian 32-bit integers.  A null or empty
    text is the end id alone.  Longer documents are cut into full pieces after a
    shorter first one.  Rows that repeat an id, and rows with a null id, are
    documents of their own.  With added, the file's added tokens that a text
    spells out are one id each, as the tokenizers library has them by default.
    Other columns are ignored.  An empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    made = texts(docs, id_col, text_col).mapInArrow(_pieces(vocabulary, size, end_id, with_ids, added), PIECE + ", ids binary" * with_ids)
    made = cut(made, "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = cut(counts.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("first")), "ranks")
    histogram = {int(r[0]): int(r[1]) for r in first.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    ranked = made.join(first.drop("n").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("first") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(_place(plan(histogram, size)), schema)
