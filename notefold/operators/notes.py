"""Set-based steps over notes, state, tags and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.text import body_signature, in_folder


def changed_notes(notes: DataFrame, state: DataFrame) -> DataFrame:
    """Notes whose body hash is not that of the state, or that it lacks."""
    old = state.select("relpath", F.col("hash").alias("old"))
    now = notes.withColumn("hash", body_signature(F.col("body")))
    return now.join(old, "relpath", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).drop("old")


def removed_notes(state: DataFrame, notes: DataFrame) -> DataFrame:
    return state.join(notes.select("relpath"), "relpath", "left_anti")


def only_listed(rows: DataFrame, listed: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key is the relpath of a listed note: those of notes that are gone go."""
    return rows.join(listed.select(F.col("relpath").alias(key)), key, "left_semi")


def first_notes(notes: DataFrame, most: int | None) -> DataFrame:
    """The first notes in order of their paths; all without a number, or with 0."""
    return notes.orderBy("relpath").limit(most) if most else notes


def in_scopes(notes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Notes in any folder of each scope (scope, folder), once a scope; the folders are configuration, a few rows."""
    few = F.broadcast(scopes)
    return notes.join(few, in_folder(notes["relpath"], few["folder"])).select("scope", "relpath").distinct()


def upsert(index: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of index whose key is not in new, and all of new."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def mapped_tags(tagged: DataFrame, aliases: DataFrame) -> DataFrame:
    """note, tags with aliases (alias, canonical) replaced and duplicates dropped, in order; aliases of any number. A note without tags keeps none."""
    # Spark broadcasts aliases where their size allows, and joins by tag with split partitions where not
    each = tagged.select("note", F.posexplode_outer("tags").alias("i", "tag")).join(aliases, F.col("tag") == F.col("alias"), "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("i", F.coalesce("canonical", "tag").alias("t")))))
    return each.groupBy("note").agg(F.array_distinct(F.transform(ordered, lambda e: e["t"])).alias("tags"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def frequent_tags(tagged: DataFrame, least: int = 2, fallback: int = 1) -> DataFrame:
    """note, tags: those that `least` notes have; a note left without any keeps its first `fallback`."""
    if least <= 1:
        return tagged.select("note", "tags")
    often = tag_counts(tagged).where(F.col("n") >= least)  # only these meet the notes
    each = tagged.select("note", "tags", F.posexplode_outer("tags").alias("i", "tag")).join(often, "tag", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("i", "tag"))))
    out = each.groupBy("note", "tags").agg(F.transform(kept, lambda e: e["tag"]).alias("kept"))
    return out.select("note", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice("tags", 1, fallback)).alias("tags"))


def missing_models(required: DataFrame, available: DataFrame) -> DataFrame:
    """Required names that no available name equals, in full or before its colon."""
    base = lambda c: F.substring_index(c, ":", 1)
    full = required.join(available.select(F.col("name").alias("__have")), F.col("name") == F.col("__have"), "left_anti")
    return full.join(available.select(base("name").alias("__base")).distinct(), base(F.col("name")) == F.col("__base"), "left_anti")


def pending_snapshot(pending: DataFrame, most: int = 5) -> DataFrame:
    """scope, total, items (relpath, mtime) newest first of pending notes (scope, relpath, mtime), for a batch or the state of a stream."""
    rows = newest_pending(pending, most).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("pos", "relpath", "mtime"))).alias("items"))
    items = F.transform("items", lambda x: F.struct(x["relpath"].alias("relpath"), x["mtime"].alias("mtime")))
    return pending.groupBy("scope").agg(F.count("*").alias("total")).join(rows.select("scope", items.alias("items")), "scope")


def newest_pending(pending: DataFrame, most: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("mtime").desc(), "relpath"))
    return pending.withColumn("pos", place).where(F.col("pos") <= most)
