"""Near-duplicate groups by banded SetSketch registers, joint estimates and exact checks.

1. Every whole text becomes its set of shingles, a digest of the set and a
   sketch.  Texts with equal sets are one class from here on, named by its
   smallest doc_id.
2. Bands of four registers are bucket keys.  Two sets at the threshold share no
   bucket with a probability below 1e-7.
3. Round one: a bucket's hub is its smallest class; each class is checked
   against the hub it shares most buckets with.  The links make components,
   which take in nearly all of any large group of copies.
4. Round two: in buckets that still hold more than one component, members of
   different components are compared by the joint estimate of their sketches.
   Pairs at most five deviations under the threshold join their ends to one
   cluster; only a forest of them leaves the task.  Members of a cluster that
   are in different components are then compared on their full sets, and again
   a forest of the links leaves the task.
5. Large buckets and clusters are split in blocks: those outside the largest
   component visit every block.  Pairs inside a component are never compared,
   and no list of all pairs is ever made.

No bucket, group or pair list is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import cut, lean, parallelism, small_batches, texts, with_rows
from notefold.llm.components import components
from notefold.llm.setsketch import REGISTERS, Words, band_keys, jaccard, shingles, sketch

ROWS = 4
#: Members of a bucket that are compared in one go.
BLOCK = 512
#: Ids up to this number are broadcast to pick their texts (16 MB); more are joined by shuffle.
FEW_IDS = 1_000_000


def _sketch(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            n, dig, regs = [], [], []
            for text in b["text"].to_pylist():
                own = shingles(text, width, words)
                n.append(len(own))
                dig.append(xxhash.xxh3_128_digest(own.tobytes()))
                regs.append(sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n", "dig", "regs"])

    return run


def _sets(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            own = [shingles(t, width, words).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(own, pa.large_binary()).cast(pa.binary())], names=["doc_id", "own"])

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


@lean
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = band_keys(_matrix(b["regs"]), ROWS)
        each = keys.shape[1]
        cid, n = (np.repeat(b[c].to_numpy(), each) for c in ("cid", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), cid, n)], names=["bucket", "cid", "n"])


def _estimates(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    more, equal = (a > b).sum(1), (a == b).sum(1)
    return jaccard(more, REGISTERS - more - equal, equal, n1, n2)


def _likely(least: float):
    """Keep pairs whose estimate is at least `least`."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ok = _estimates(_matrix(b["regs_a"]), _matrix(b["regs_b"]), b["n_a"].to_numpy(), b["n_b"].to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([b["a"].filter(pa.array(ok)), b["b"].filter(pa.array(ok))], names=["a", "b"])

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 is joined with by pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(share: int, least: float):
    """A forest (id, root) over the likely pairs of a visitor and a home row of different components."""

    def forest(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        cid, comp, n, home = (t[c].to_numpy() for c in ("cid", "comp", "n", "home"))
        regs = _matrix(t["regs"].combine_chunks())
        found, at = [np.zeros((2, 0), np.int64)], np.arange(len(cid))
        for d in range(1, len(cid)):
            at = at[at + d < len(cid)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            small, large = np.minimum(n[at], n[at + d]), np.maximum(n[at], n[at + d])
            i = at[(home[at] != home[at + d]) & (comp[at] != comp[at + d]) & (100 * small >= share * large)]
            if len(i):
                i = i[_estimates(regs[i], regs[i + d], n[i], n[i + d]) >= least]
                found.append(np.stack([i, i + d]))
        i, j = np.concatenate(found, 1)
        root = _roots(len(cid), i, j)
        own = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(cid[root[own]])], names=["a", "b"])

    return _by_group(("bucket", "home_block", "visit_block"), forest)


def _links(share: int):
    """A forest (a, b) over the links between a visitor and a home row of different components, on whole sets."""

    def of_group(cid, comp, home, sets) -> tuple[np.ndarray, np.ndarray]:
        at, guests = np.flatnonzero(home), np.flatnonzero(~home)
        size = np.array([len(x) for x in sets])
        every = np.concatenate([sets[k] for k in at]) if len(at) else np.zeros(0, np.uint64)
        owner = np.repeat(at, size[at])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in guests:
            lo, hi = np.searchsorted(every, sets[g], "left"), np.searchsorted(every, sets[g], "right")
            n = hi - lo
            hits = owner[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            common = np.bincount(hits, minlength=len(cid))[at]
            to = at[(100 * common >= share * (size[at] + size[g] - common)) & (comp[at] != comp[g])]
            i.append(np.full(len(to), g))
            j.append(to)
        i, j = np.concatenate(i), np.concatenate(j)
        root = _roots(len(cid), i, j)
        own = np.unique(np.concatenate([i, j]))
        return cid[own], cid[root[own]]

    def forest(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        cid, comp, home = (t[c].to_numpy() for c in ("cid", "comp", "home"))
        sets = [np.frombuffer(x, np.uint64) for x in t["own"].to_pylist()]
        edge = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(cid)]
        out = [of_group(cid[x:y], comp[x:y], home[x:y], sets[x:y]) for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return _by_group(("cluster", "home_block", "visit_block"), forest)


def _by_group(keys: tuple[str, ...], work):
    """Apply work(table, group numbers) to whole groups of rows that come in order of keys."""

    def key_of(t: pa.Table) -> np.ndarray:
        return np.stack([t[c].to_numpy() for c in keys], 1)

    def whole(t: pa.Table) -> pa.RecordBatch:
        key = key_of(t)
        return work(t, np.cumsum(np.r_[True, (key[1:] != key[:-1]).any(1)]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = key_of(t)
            last = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1
            held = t.slice(last)
            if last:
                yield whole(t.slice(0, last))
        if held is not None:
            yield whole(held)

    return run


def _confirmed(share: int):
    """Keep pairs with 100 * intersection >= share * union, on whole sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b["set_a"], b["set_b"], strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= share * (len(both) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(ok), b["b"].filter(ok)], names=["a", "b"])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, own) of the documents that ids (doc_id) names: their whole sets."""
    ids = cut(ids, "ids")
    named = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return cut(docs.join(named, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, own binary"), "sets")


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """Those of pairs (a, b) that the full sets confirm, from the whole texts of the documents they name."""
    pairs = cut(pairs, "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, width)
    own = lambda c: sets.select(F.col("doc_id").alias(c), F.col("own").alias(f"set_{c}"))
    joined = pairs.hint("merge").join(own("b").hint("merge"), "b").join(own("a").hint("merge"), "a")
    return cut(joined.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(share), "a long, b long"), "links")


def _blocks(members: DataFrame, key: str) -> DataFrame:
    """Deal members (key, cid, comp, ...) of every key with several components into blocks in which visitors meet home rows.

    Each row is at home in one block; rows outside the key's largest component
    also visit every home block.  Home rows are repeated for each block of
    visitors, so a block holds about BLOCK rows of either kind.
    """
    per = members.groupBy(key, "comp").agg(F.count("*").alias("k")).groupBy(key).agg(F.sum("k").alias("size"), F.count("*").alias("comps"), F.max("k").alias("most"), F.max_by("comp", "k").alias("main"))
    live = members.join(per.where("comps > 1"), key).withColumns({"homes": F.ceil(F.col("size") / BLOCK), "visits": F.ceil((F.col("size") - F.col("most")) / BLOCK)})
    block = lambda n: F.pmod(F.xxhash64("cid", key), n)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at_home = live.select(*members.columns, F.lit(True).alias("home"), block(F.col("homes")).alias("home_block"), upto(F.col("visits")).alias("visit_block"))
    visiting = live.where("comp <> main").select(*members.columns, F.lit(False).alias("home"), upto(F.col("homes")).alias("home_block"), block(F.col("visits")).alias("visit_block"))
    return at_home.union(visiting)


def _together(rows: DataFrame, key: str) -> DataFrame:
    parts = 4 * parallelism(rows.sparkSession)
    return rows.repartition(parts, key, "home_block", "visit_block").sortWithinPartitions(key, "home_block", "visit_block", "cid")


def near_groups(docs: DataFrame, width: int = 3, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts are linked when 100 * intersection >= share * union of their sets of
    `width`-word shingles (A-Z lower-cased; a shorter text is one shingle).
    component_id is the smallest doc_id that links reach, kept that it is the
    row's own.  A text that is null or without words has no shingles and links
    with nothing, not even its copies.  A row without an id takes no part: its
    component_id is null and kept false.  Rows that repeat an id get a row each
    and count as one document.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    deviation = math.sqrt(share * (100 - share) / 1e4 / REGISTERS)
    least = share / 100 - 5.5 * deviation
    own = texts(docs, id_col, text_col)
    rows = cut(own.mapInArrow(_sketch(width), "doc_id long, n long, dig binary, regs binary"), "sketches")
    reps = cut(rows.where("n > 0 and doc_id is not null").groupBy("dig").agg(F.min("doc_id").alias("cid")), "classes")
    named = rows.where("n > 0").join(reps.select(F.col("cid").alias("doc_id"), F.col("dig").alias("__dig")), "doc_id").where("dig = __dig")
    classes = cut(named.select(F.col("doc_id").alias("cid"), "n", "regs"), "class-sketches")

    banded = classes.mapInArrow(_bands, "bucket long, cid long, n long")
    hubs = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cid").alias("hub")).where("size > 1")
    shared = cut(banded.join(hubs.drop("size"), "bucket"), "buckets")
    best = shared.where("cid <> hub").groupBy("cid", "hub").agg(F.count("*").alias("times")).groupBy("cid").agg(F.max_by("hub", "times").alias("hub"))
    sides = lambda a: classes.select(F.col("cid").alias(a), F.col("n").alias(f"n_{a}"), F.col("regs").alias(f"regs_{a}"))
    tried = best.select(F.col("hub").alias("a"), F.col("cid").alias("b")).hint("merge").join(sides("b").hint("merge"), "b").join(sides("a").hint("merge"), "a").where(f"100 * least(n_a, n_b) >= {share} * greatest(n_a, n_b)")
    first = _confirm(tried.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(least), "a long, b long"), own, width, share)
    found = components(first)

    labelled = lambda rows: rows.join(found.select(F.col("node").alias("cid"), F.col("component")), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    met = _blocks(labelled(shared.select("bucket", "cid", "n")), "bucket").join(classes.select("cid", "regs"), "cid")
    clusters = components(_together(met, "bucket").mapInArrow(_near(share, least), "a long, b long"))
    gathered = cut(_blocks(labelled(clusters.select(F.col("component").alias("cluster"), F.col("node").alias("cid"))), "cluster"), "clusters")
    sets = _sets_of(gathered.select(F.col("cid").alias("doc_id")).distinct(), own, width)
    met = gathered.join(sets.withColumnRenamed("doc_id", "cid"), "cid")
    second = _together(met, "cluster").mapInArrow(_links(share), "a long, b long")
    ends = components(first.union(second))
    of_dig = reps.join(ends.withColumnRenamed("node", "cid"), "cid", "left").select("dig", F.coalesce("component", "cid").alias("component_id"))
    out = rows.join(cut(of_dig, "of-class"), "dig", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near_groups: that of the smallest id (none comes last), then the first as stored.

    Decides by row, so ids may repeat or be null.  Rows without words link with
    nothing and all stay.  Columns of any names stay as they are; an empty
    table stays empty.
    """
    rows, row = with_rows(docs)
    groups = near_groups(rows, width, share, row, text_col).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("comp"))
    named = cut(groups.join(rows.select(F.col(row).alias("__row"), rows[f"`{id_col}`"].cast("long").alias("id")), "__row"), "groups")
    stay = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("__row"))).alias("best")).select("best.__row")
    gone = cut(named.select("__row").join(stay, "__row", "left_anti").withColumnRenamed("__row", row), "gone")
    return rows.join(gone, row, "left_anti").drop(row)
