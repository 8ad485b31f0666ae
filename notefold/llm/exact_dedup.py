"""Exact dedup by a tree-merge of sorted digest runs.

Each input task sorts its digests into runs of entries (digest, length, check
hash, smallest id, count), equal texts already merged.  The runs then meet in
rounds of a k-ary hypercube exchange (binomial for k = 2): in round r a node
hands every partner along axis r the part of its run whose digest has that
partner's r-th digit, and merges the runs it gets.  After the last round node d
holds the one run of digest range d.

Runs travel as blocks of at most BLOCK entries.  A node takes its blocks in the
order of their first entries and merges by a heap of the heads of the runs: a
block is opened once every smaller entry has gone, so no more than one block of
a run is open.  Entries are never sorted again after their first run.

Entries of equal digest, length and check hash merge at every level into the
smallest identifier, so a text that a third of the rows share is one entry a
run before anything is exchanged.  Digests are SHA-256; an entry only merges
where the length in bytes and an independent 64-bit hash agree as well (the
verification at each level).
"""

from __future__ import annotations

import heapq
import itertools
import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import SPACE, cut, lean, parallelism, texts, with_rows

#: Stands for a null id inside runs. It may be an id too: an entry says beside it whether any of its rows has one.
NO_ID = (1 << 63) - 1
#: An entry: digest, length and check hash (its key), then smallest id, whether that is an id, and count, all big-endian.
KEY, TAIL = 48, ">qqq"
ENTRY = KEY + struct.calcsize(TAIL)
#: Entries of a run at most (32 MB), and of a block of one (128 KB).
RUN, BLOCK = 1 << 19, 1 << 11
_BLOCKS = "node int, head binary, entries binary"
_SCHEMA = pa.schema([("node", pa.int32()), ("head", pa.binary()), ("entries", pa.binary())])
_GROUPS = "sha binary, len long, chk long, min_id long, n long"


def sorted_run(sha: pa.Array, length: np.ndarray, chk: np.ndarray, ids: np.ndarray, named: np.ndarray | None = None) -> bytes:
    """The entries of some rows in the order of their keys, equal keys merged; rows that are not named have NO_ID for an id."""
    own = np.empty((len(ids), 6), np.uint64)
    own[:, :4] = np.frombuffer(b"".join(sha.to_pylist()), ">u8").reshape(-1, 4)
    own[:, 4], own[:, 5] = length.astype(np.uint64), chk.view(np.uint64)
    order = np.lexsort(own.T[::-1])
    own, ids, named = own[order], ids[order], (np.ones(len(ids), bool) if named is None else named)[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)])
    least = np.minimum.reduceat(ids, new).view(np.uint64)
    return np.column_stack([own[new], least, np.maximum.reduceat(named.astype(np.uint64), new), np.diff(np.r_[new, len(ids)]).astype(np.uint64)]).astype(">u8").tobytes()


def merged_heads(blocks: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, int | None, int]]:
    """(key, smallest id or None without any, count) in the order of keys, from the blocks (first key, entries) of any number of runs in the order of first keys."""
    heads, held, least, named, n = [], None, 0, 0, 0
    for serial, (first, block) in enumerate(itertools.chain(blocks, [(None, b"")])):
        while heads and (first is None or heads[0][0] < first):
            key, of, own, at = heads[0]
            own_id, own_named, own_n = struct.unpack_from(TAIL, own, at + KEY)
            if key == held:
                least, named, n = min(least, own_id), named | own_named, n + own_n
            else:
                if held is not None:
                    yield held, least if named else None, n
                held, least, named, n = key, own_id, own_named, own_n
            at += ENTRY
            if at < len(own):
                heapq.heapreplace(heads, (own[at : at + KEY], of, own, at))
            else:
                heapq.heappop(heads)
        if first is not None:
            heapq.heappush(heads, (first, serial, block, 0))
    if held is not None:
        yield held, least if named else None, n


def _blocks(entries: Iterable[bytes], node: int, fan: int, rounds: int, r: int) -> Iterator[pa.RecordBatch]:
    """The entries of node's run as blocks for its partners of round r: those with the r-th digit, base fan, of the digest's place among fan ** rounds ranges."""
    unit, nodes = fan ** (rounds - 1 - r), fan**rounds
    held, to = [], None

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([held[0][:KEY]], pa.binary()), pa.array([b"".join(held)], pa.binary())], schema=_SCHEMA)

    for e in entries:
        digit = (int.from_bytes(e[:4], "big") * nodes >> 32) // unit % fan
        own = node + (digit - node // unit % fan) * unit
        if held and (own != to or len(held) == BLOCK):
            yield block()
            held.clear()
        to = own
        held.append(e)
    if held:
        yield block()


def _runs(fan: int, rounds: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId() % fan**rounds

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            entries = sorted_run(t["sha"], t["len"].to_numpy(), t["chk"].to_numpy(), t["doc_id"].fill_null(NO_ID).to_numpy(), t["doc_id"].is_valid().to_numpy())
            return _blocks((entries[k : k + ENTRY] for k in range(0, len(entries), ENTRY)), me, fan, rounds, 0)

        held, rows = [], 0
        for b in batches:
            if rows and rows + len(b) > RUN:
                yield from out(held)
                held, rows = [], 0
            if len(b):
                held.append(b)
                rows += len(b)
        if held:
            yield from out(held)

    return run


def _merge(fan: int, rounds: int, r: int):
    """Merge the runs that a node has got; their entries as blocks for round r, or as rows after the last."""

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b["node"].to_pylist(), b["head"].to_pylist(), b["entries"].to_pylist(), strict=True))
        for node, own in itertools.groupby(rows, lambda x: x[0]):
            merged = merged_heads(x[1:] for x in own)
            if r < rounds:
                yield from _blocks((key + struct.pack(TAIL, NO_ID if least is None else least, least is not None, n) for key, least, n in merged), node, fan, rounds, r)
            else:
                yield from map(_groups, itertools.batched(merged, 4 * BLOCK))

    return merge


def _groups(part: tuple[tuple[bytes, int | None, int], ...]) -> pa.RecordBatch:
    keys, least, n = zip(*part, strict=True)
    more = np.frombuffer(b"".join(k[32:] for k in keys), ">i8").reshape(-1, 2).astype(np.int64)
    cols = [pa.array([k[:32] for k in keys], pa.binary()), *(pa.array(x, pa.int64()) for x in (more[:, 0], more[:, 1], least, n))]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _GROUPS.split(", ")])


def merged_runs(slim: DataFrame, most_fan: int = 16) -> DataFrame:
    """(sha, len, chk, min_id, n) of every distinct text of slim (doc_id, sha, len, chk)."""
    want = parallelism(slim.sparkSession)
    rounds = max(2, math.ceil(math.log(want, most_fan)))
    fan = max(2, math.ceil(want ** (1 / rounds)))
    runs = slim.mapInArrow(_runs(fan, rounds), _BLOCKS)
    for r in range(1, rounds + 1):
        met = runs.repartitionById(fan**rounds, F.col("node")).sortWithinPartitions("node", "head")
        runs = met.mapInArrow(_merge(fan, rounds, r), _BLOCKS if r < rounds else _GROUPS)
    return runs


def _digests(own: DataFrame) -> DataFrame:
    """sha, len and chk of the texts of own, beside its other columns."""
    more = [c for c in own.columns if c != "text"]
    norm = F.regexp_replace("text", SPACE, " ")
    return own.select(*more, norm.alias("norm")).select(*more, F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("len"), F.xxhash64("norm").alias("chk"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after each run of white space becomes one
    space; a null text is the empty one.  Null ids never win over others: they
    keep only where the group has no id at all.  Rows that repeat an id each
    get a row, and all rows of the kept id are kept.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    slim = cut(_digests(texts(docs, id_col, text_col)), "digests")
    groups = merged_runs(slim).where("n > 1")
    out = slim.join(groups, ["sha", "len", "chk"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("min_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: that of the smallest id (none comes last), then the first as stored.

    Decides by row, so ids may repeat or be null.  A null text is the empty
    one, and one such row stays.  Columns of any names stay as they are; an
    empty table stays empty.
    """
    rows, row = with_rows(docs)
    slim = cut(_digests(texts(rows, id_col, text_col, F.col(row).alias("__row"))), "digests")
    groups = merged_runs(slim.drop("__row")).where("n > 1").drop("n")
    held = cut(slim.join(groups, ["sha", "len", "chk"]).select("__row", "sha", "len", "chk", F.col("doc_id").eqNullSafe(F.col("min_id")).alias("least")), "held")
    stay = held.where("least").groupBy("sha", "len", "chk").agg(F.min("__row").alias("__row"))
    gone = cut(held.select("__row").join(stay.select("__row"), "__row", "left_anti").withColumnRenamed("__row", row), "gone")
    return rows.join(gone, row, "left_anti").drop(row)
