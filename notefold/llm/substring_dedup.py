"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of every whole text (A-Z lower-cased, each run
of white space one space); a chunk ends where the hash of the last 16 bytes is
under a bound, 1 position in `average`, or after `longest` bytes.  Boundaries
depend on near bytes only, so what is inserted before a passage does not move
the chunks in it.

1. One pass cuts texts into chunks and writes, per batch of documents, the
   distinct digests (96 bits) and which chunk has which.
2. Each batch sends each of its distinct digests once, with its smallest
   doc_id; sums over batches find the digests that occur more than once, and the
   document (smallest doc_id) that keeps the text, at its first place there.
3. Batches get back those of their digests that repeat, and runs of repeated
   chunks of at least `least` bytes become spans.  Chunks at their keeping
   place stay, and with them what lies between in pieces of under `least` bytes.

A passage that a third of the documents hold is one row a batch: of all digest
rows, its share is at most one in the digests of a batch (some 20,000).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from notefold.llm.common import cut, fresh, lean, small_batches, texts, with_rows
from notefold.llm.exact_dedup import NO_ID
from notefold.llm.setsketch import mix

_WINDOW = 16
#: One 32-bit number a byte value, from a rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
#: Bytes of text that a batch of documents holds at most, unless it is one document.
BATCH_BYTES = 1 << 19
#: Spans are broadcast to their texts up to this many (16 MB), and joined by shuffle beyond.
FEW_NUMBERS = 1_000_000
_CHUNKS = "batch long, docs binary, ids binary, counts binary, digests binary, codes binary, sizes binary"


def boundaries(raw: np.ndarray, average: int, longest: int) -> np.ndarray:
    """Ends of the chunks of some bytes of UTF-8, all between characters; the last is their number."""
    h = GEAR[raw]
    w = 1
    while w < _WINDOW:  # the hash of the last 2w bytes from two of the last w
        older = np.zeros_like(h)
        older[w:] = h[:-w] if len(h) > w else h[:0]
        h = h + (older << np.uint32(w))
        w *= 2
    ends = np.flatnonzero(mix(h.astype(np.uint64)) < np.uint64((1 << 64) // average)) + 1
    ends = np.unique(np.r_[ends, len(raw)])
    size = np.diff(np.r_[0, ends])
    if len(size) and size.max() > longest:
        extra = [np.arange(e - n + longest, e, longest) for e, n in zip(ends[size > longest], size[size > longest], strict=True)]
        ends = np.unique(np.concatenate([ends, *extra]))
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(starts) < len(raw):  # a chunk ends where a character does
        ends = np.unique(np.r_[starts, len(raw)][np.searchsorted(starts, ends)])
    return ends


def normal(text: str) -> tuple[bytes, np.ndarray | None]:
    """The bytes that are cut, and where each lies in the text's own bytes (None: at its own place)."""
    raw = text.encode()
    if not any(len(m) > 1 or m != b" " for m in _SPACES.findall(raw)):
        return raw.lower(), None
    keep = np.ones(len(raw), bool)
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    keep[1:] = ~(space[1:] & space[:-1])
    out = np.where(space, 32, b)[keep].astype(np.uint8)
    return out.tobytes().lower(), np.flatnonzero(keep)


def _cut(average: int, longest: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        ids, rows, counts, codes, sizes, held = [], [], [], [], [], 0
        index: dict[bytes, int] = {}

        def row() -> pa.RecordBatch:
            nonlocal serial, held
            valid = np.array([x is not None for x in ids], np.uint8)
            step = np.diff(np.array(codes, np.int32), prepend=np.int32(0))  # mostly ones: packs well
            named = len(rows)
            cols = [pa.array([(part << 19) | serial], pa.int64())]
            cols += [pa.array([x], pa.binary()) for x in (valid.tobytes(), np.array([x or 0 for x in ids], np.int64).tobytes(), np.array(counts, np.int32).tobytes(), b"".join(index), step.tobytes(), np.array(sizes, np.int32).tobytes(), *([np.array(rows, np.int64).tobytes()] if rows else []))]
            serial, held = serial + 1, 0
            for x in (ids, rows, counts, codes, sizes, index):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _CHUNKS.split(", ")] + ["rows"] * bool(named))

        for b in batches:
            numbers = iter(b["__row"].to_pylist()) if "__row" in b.schema.names else None
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw, place = normal(text)
                ends = boundaries(np.frombuffer(raw, np.uint8), average, longest) if raw else np.zeros(0, np.int64)
                lo = 0
                for hi in ends.tolist():
                    codes.append(index.setdefault(xxhash.xxh3_128_digest(raw[lo:hi]), len(index)))
                    lo = hi
                at = np.r_[0, ends]
                if place is not None:
                    at = np.r_[place, len(text.encode())][at]
                ids.append(doc)
                if numbers:
                    rows.append(next(numbers))
                counts.append(len(ends))
                sizes += np.diff(at).tolist()
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield row()
        if ids:
            yield row()

    return run


def _unpack(r: dict) -> tuple[np.ndarray, ...]:
    """Of a batch: each chunk's document and code; valid ids, ids, chunks of each document."""
    valid, ids, counts = np.frombuffer(r["docs"], np.uint8), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int32)
    own = np.repeat(np.where(valid == 1, ids, NO_ID), counts)
    return own, np.cumsum(np.frombuffer(r["codes"], np.int32)), valid, ids, counts


@lean
def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            doc, code, *_ = _unpack(r)
            dig = np.frombuffer(r["digests"], np.int64).reshape(-1, 2)
            first = np.full(len(dig), NO_ID)
            np.minimum.at(first, code, doc)
            many = np.bincount(code, minlength=len(dig)) > 1
            for s in range(0, len(dig), 50_000):
                k = slice(s, s + 50_000)
                cols = [np.full(len(first[k]), r["batch"]), (np.arange(len(dig))[k] * 2 + many[k]).astype(np.int32), dig[k, 0], dig[k, 1].astype(np.int32), first[k]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["batch", "code", "hi", "lo", "doc"])


def _spans(least: int, by_row: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_chunks": [], "n_repeated": [], "spans": []}
        for r in left.to_pylist():
            doc, code, valid, ids, counts = _unpack(r)
            row_of = np.full(code.max(initial=-1) + 2, -1)
            row_of[right["code"].to_numpy()] = np.arange(len(right))
            at = row_of[code]
            _, first = np.unique(np.repeat(np.arange(len(counts)), counts) * len(row_of) + code, return_index=True)
            keeps = np.zeros(len(code), bool)
            keeps[first] = True  # of a document's equal chunks, the first
            keeps &= (at >= 0) & (np.r_[right["doc"].to_numpy(), -1][at] == doc)
            if by_row:  # of the rows of an id, the first of the first batch
                at_keeper = np.flatnonzero(keeps & np.r_[right["own"].to_numpy(zero_copy_only=False), False][at])
                _, one = np.unique(code[at_keeper], return_index=True)
                keeps[:] = False
                keeps[at_keeper[one]] = True
                named = np.frombuffer(r["rows"], np.int64)
            sizes, begin = np.frombuffer(r["sizes"], np.int32), 0
            for k, n in enumerate(counts.tolist()):
                rep = at[begin : begin + n] >= 0
                spans, repeated = [], 0
                if rep.any():
                    s = np.r_[0, np.cumsum(sizes[begin : begin + n])]
                    edge = np.flatnonzero(np.diff(np.r_[0, rep.astype(np.int8), 0]))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        if s[b] - s[a] >= least:
                            repeated += b - a
                            gone = np.flatnonzero(np.diff(np.r_[0, (~keeps[begin + a : begin + b]).astype(np.int8), 0])) + a
                            spans += [{"start": int(s[x]), "end": int(s[y])} for x, y in zip(gone[::2], gone[1::2], strict=True) if s[y] - s[x] >= least]
                out["doc_id"].append(int(named[k]) if by_row else int(ids[k]) if valid[k] else None)
                out["n_chunks"].append(n)
                out["n_repeated"].append(repeated)
                out["spans"].append(spans)
                begin += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def repeated_spans(docs: DataFrame, average: int = 24, longest: int = 256, least: int = 96, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_chunks, n_repeated, spans for every row of docs.

    n_repeated counts the chunks in runs of at least `least` bytes of chunks
    that occur elsewhere too.  spans are the byte ranges (start, end) of those
    runs in the UTF-8 text, without the chunks that this text keeps (what is left
    of a run must still have `least` bytes): of equal chunks, that in the
    smallest doc_id, then the first there, stays.  So the
    spans of all texts can be cut out together and each passage stays once.

    A null or empty text has no chunks.  Rows that repeat an id each get a row
    and keep each on its own.  Rows without an id keep only what no
    row with an id holds.  With row_col (a number of its own for each row, no
    null), doc_id is that number, and of the rows that repeat an id, or have
    none, only one keeps a chunk.  An empty table gives an empty result.  Other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    packed = cut(texts(docs, id_col, text_col, *([F.col(row_col).alias("__row")] if row_col else [])).mapInArrow(_cut(average, longest), _CHUNKS + ", rows binary" * (row_col is not None)), "chunks")
    same = Window.partitionBy("hi", "lo")
    # code: twice the batch's code, plus one where the batch has the digest more than once
    rows = packed.mapInArrow(_distinct, "batch long, code int, hi long, lo int, doc long")
    first = F.min(F.struct("doc", "batch")).over(same).alias("first") if row_col else F.min("doc").over(same).alias("doc")
    repeats = rows.select("batch", "code", F.count("*").over(same).alias("times"), first).where("times > 1 or code % 2 = 1")
    back = repeats.select("batch", F.shiftright("code", 1).alias("code"), *(["first.doc", (F.col("first.batch") == F.col("batch")).alias("own")] if row_col else ["doc"]))
    packed = packed.drop("digests")
    return packed.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_spans(least, row_col is not None), "doc_id long, n_chunks long, n_repeated long, spans array<struct<start: long, end: long>>")


def cut_repeats_of_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with their repeated spans cut out of the text of every row; rows of which only white space is left go.

    Decides by row, so ids may repeat or be null.  A text that is null or has
    no repeated span stays as it is.  Columns of any names stay as they are; an
    empty table stays empty.
    """
    rows, row = with_rows(docs)
    found = repeated_spans(rows, id_col=id_col, text_col=text_col, row_col=row, **how).where("size(spans) > 0")
    return _without(rows, found.select(F.col("doc_id").alias(row), "spans"), row, text_col).drop(row)


def _without(docs: DataFrame, found: DataFrame, row: str, text_col: str) -> DataFrame:
    own, new = fresh(docs, "__spans"), fresh(docs, "__text")
    found = cut(found, "spans").withColumnRenamed("spans", own)
    if found.agg(F.coalesce(F.sum(F.size(own) + 2), F.lit(0))).first()[0] <= FEW_NUMBERS:
        found = F.broadcast(found)

    @arrow_udf("string")
    def left(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t and own:
                raw, kept, at = t.encode(), [], 0
                for s in own:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                kept.append(raw[at:])
                t = b" ".join(x for x in kept if x).decode()
            out.append(t)
        return pa.array(out, pa.string())

    text, spans = F.col(f"`{text_col}`"), F.col(own)
    shortened = left.asNondeterministic()(F.when(spans.isNotNull(), text), spans)  # once a row, though a filter uses it too; only texts that lose something go to Python
    shorter = docs.join(found, row, "left").withColumn(new, shortened).withColumn(new, F.when(spans.isNull(), text).otherwise(F.col(new)))
    kept = shorter.where(spans.isNull() | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[(F.col(new).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
