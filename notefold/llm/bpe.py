"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a token as a whole is found through a minimal perfect hash:
bucket displacements give every token a slot of its own in a table without
gaps, so one probe and one comparison decide.  Any other pre-token starts as a
list of its bytes, linked in order, and a heap of adjacent pairs by (rank,
place) merges the lowest rank first, the leftmost of equals.  Both tiers sit
behind a bounded table of pre-tokens already seen by the worker.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from notefold.llm.common import lean, small_batches, texts
from notefold.llm.setsketch import mix
from notefold.llm.tokens import PATTERN, ranks

_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Slots 0..n-1 of n keys, one each; other keys get some slot, so compare what is there."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = max(1, len(keys))
        self.buckets = -(-n // per_bucket)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        start = np.cumsum(size) - size
        free, self.shift = np.ones(n, bool), np.zeros(self.buckets, np.int64)
        for b in np.argsort(-size, kind="stable"):
            own = h[order[start[b] : start[b] + size[b]]]
            if len(own) < 2:
                break
            first = 0
            while True:
                d = np.arange(first, first + 64, dtype=np.uint64)
                slots = (mix(own[:, None] + d * _STEP) % np.uint64(n)).astype(np.int64)
                distinct = np.sort(slots, 0)
                ok = free[slots].all(0) & (np.diff(distinct, axis=0) != 0).all(0)
                if ok.any():
                    k = int(ok.argmax())
                    free[slots[:, k]] = False
                    self.shift[b] = first + k
                    break
                first += 64
        left = np.flatnonzero(free)
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - left[: len(single)]  # a lone key's slot is kept itself
        self.key: list[bytes] = [b""] * n
        for k, s in zip(keys, map(self.slot, keys), strict=True):
            self.key[s] = k

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.shift[h % self.buckets])
        if d < 0:
            return -1 - d
        x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 31)) % self.n


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merges over its linked bytes."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (r := rank.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has been merged since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := rank.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token to packed ids; filled on demand, and emptied at a bound."""

    def __init__(self, path: str, most: int = 300_000):
        self.rank, self.most = ranks(path), most
        self.whole = PerfectHash(list(self.rank))
        self.ids_of_slot = [self.rank[k] for k in self.whole.key]
        self.token = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        s = self.whole.slot(raw)
        ids = [self.ids_of_slot[s]] if self.whole.key[s] == raw else merged(raw, self.rank)
        if len(self) >= self.most:
            self.clear()
        out = self[piece] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian 32-bit."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            ids = [own.encode(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _digests(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b["text"].to_pylist():
                ids = own.encode(t)
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of every whole text; a null or empty text has none.

    Rows that repeat an id, or have none, get a row each; other columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_encode(vocabulary), "doc_id long, ids binary")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text (bytes) of rows that encode() returns."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([own.decode(x or b"") for x in b["ids"].to_pylist()], pa.binary())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for every row, as encode() has them."""
    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
