"""Nearest controlled tags by matching-block similarity, which no built-in expression has.

A similarity is at most what two tags' lengths, and the characters that they
share, allow.  A vocabulary lies in order of length with a column of counts for
each character, so the bound of a tag against all of it is a few additions of
columns; only tags whose bound reaches the best so far are compared exactly.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.text import allowed_tags, normalize_tags

#: Tags of a vocabulary that a task holds; a larger one is dealt to slices.
SLICE = 1 << 18
#: Tags that meet a slice in one task.
GROUP = 1 << 12
_FOUND = "tag string, nearest string, ratio double"


class Vocabulary:
    """Tags by length with counts of their characters."""

    def __init__(self, tags: Iterable[str]):
        self._tags = sorted({t for t in tags if t is not None}, key=len)
        self._sizes = np.array([len(t) for t in self._tags], np.int32)
        self._counts: dict[str, np.ndarray] = {}
        for k, t in enumerate(self._tags):
            for c in set(t):
                if c not in self._counts:
                    self._counts[c] = np.zeros(len(self._tags), np.uint16)
                self._counts[c][k] = min(t.count(c), 65_535)

    def nearest(self, tag: str, least: float) -> tuple[str | None, float, int]:
        """The most similar tag with a similarity of at least `least` (ties: the last in order), its similarity, and how many were compared exactly."""
        n = len(tag)
        # 2 * min / (own + other) bounds the similarity of tags by their lengths
        low, high = (int(np.searchsorted(self._sizes, x, side)) for x, side in ((n * least / (2 - least) - 1, "left"), (n * (2 - least) / least + 1 if least else np.inf, "right")))
        shared = np.zeros(high - low, np.int64)
        for c in set(tag):
            if c in self._counts:
                shared += np.minimum(self._counts[c][low:high], min(tag.count(c), 65_535))
        both = self._sizes[low:high] + n
        bound = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)
        able = np.flatnonzero(bound >= least)
        best, top, compared = None, least, 0
        matcher = difflib.SequenceMatcher()
        matcher.set_seq2(tag)
        for k in able[np.argsort(-bound[able], kind="stable")]:
            if bound[k] < top:
                break
            other = self._tags[low + k]
            matcher.set_seq1(other)
            compared += 1
            ratio = matcher.ratio()
            if ratio > top or (ratio == top and (best is None or other > best)):
                best, top = other, ratio
        return best, top if best is not None else 0.0, compared


def normal_vocabulary(spark: SparkSession, controlled: list[str]) -> list[str]:
    """A vocabulary as tags are: normalised, once each, in order."""
    return spark.createDataFrame([(controlled,)], "c array<string>").select(normalize_tags(F.col("c"))).first()[0]


def _found(vocabulary: Vocabulary, tags: pa.Array, least: float) -> pa.RecordBatch:
    best = [vocabulary.nearest(t, least)[:2] for t in tags.to_pylist()]
    return pa.RecordBatch.from_arrays([tags, pa.array([b for b, _ in best], pa.string()), pa.array([r for _, r in best], pa.float64())], names=["tag", "nearest", "ratio"])


def nearest_tags(tags: DataFrame, controlled: list[str] | DataFrame, least: float = 0.75) -> DataFrame:
    """tag, nearest: the controlled tag most similar to each distinct tag, or null under `least`.

    controlled: a list, or a table (tag) of any size, normalised here.  Of
    equally similar ones the last in order wins.  Only distinct tags reach
    Python.  A list goes to every task; a table is dealt to slices that each
    group of tags meets, and the best of the slices is kept.
    """
    own = tags.select("tag").where(F.col("tag").isNotNull()).distinct()
    if not isinstance(controlled, DataFrame):
        listed = normal_vocabulary(tags.sparkSession, controlled)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary(listed)
            for b in batches:
                yield _found(vocabulary, b["tag"], least)

        return own.mapInArrow(run, _FOUND).select("tag", "nearest")

    names = controlled.select(F.explode(normalize_tags(F.array("tag"))).alias("name")).distinct()
    exact = own.join(names, F.col("tag") == F.col("name"), "left_semi").select("tag", F.col("tag").alias("nearest"), F.lit(1.0).alias("ratio"))
    rest = own.join(names, F.col("tag") == F.col("name"), "left_anti")
    slices, groups = (max(1, -(-df.count() // most)) for df, most in ((names, SLICE), (rest, GROUP)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = names.select("name", dealt("name", slices).alias("slice"), every(groups).alias("group")).groupBy("slice", "group")
    right = rest.select("tag", dealt("tag", groups).alias("group"), every(slices).alias("slice")).groupBy("slice", "group")

    def meet(vocabulary: pa.Table, some: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_found(Vocabulary(vocabulary["name"].to_pylist()), some["tag"].combine_chunks(), least)])

    best = left.cogroup(right).applyInArrow(meet, _FOUND).unionByName(exact)
    return best.groupBy("tag").agg(F.max(F.when(F.col("nearest").isNotNull(), F.struct("ratio", "nearest")))["nearest"].alias("nearest"))


def controlled_tags(tagged: DataFrame, controlled: list[str], allow_free: bool = True, min_length: int = 2, max_words: int = 3) -> DataFrame:
    """note, tags: those long and short enough, mapped to a vocabulary; in order, once each.

    The vocabulary counts as normalised.  A tag of it stays, another becomes the nearest one, and one
    without a near one stays only if free tags are allowed.  Without a
    vocabulary all stay.
    """
    own = tagged.select("note", allowed_tags(F.col("tags"), min_length, max_words).alias("tags"))
    controlled = normal_vocabulary(tagged.sparkSession, controlled)
    if not controlled:
        return own
    each = own.select("note", F.posexplode_outer("tags").alias("i", "tag"))
    near = nearest_tags(each, controlled)
    mapped = F.coalesce("nearest", F.col("tag") if allow_free else F.lit(None).cast("string"))
    rows = each.join(near, "tag", "left").select("note", "i", mapped.alias("t"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("i", "t"))))
    return rows.groupBy("note").agg(F.array_distinct(F.transform(ordered, lambda e: e["t"])).alias("tags"))
