"""The refresh as one job on streams: what changes in a vault, through keyed state, to a snapshot of what is pending.

Two queries, each with a checkpoint of its own in the store:

1. `entries`: files that changed, as the vault's stream has them, and events
   (dirty, gone and known hashes) go through the state of each file; what a
   micro-batch changes is appended to the store.
2. `pending`: those changes go through the state of each scope's shards; the
   last row of each shard is kept, and the snapshot is made from them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notefold.functions.text import SECTION_HEADING, body_signature, in_folder, strip_frontmatter, strip_sections, word_count
from notefold.plans.batch import load, save
from notefold.sources.notes import utf8
from notefold.sources.vault import registered
from notefold.streaming.state import CHANGES, TOPS, entry_changes, newest_by_shard, scope_changes, snapshot_of_shards, with_state_store

EVENTS = "relpath string, seq long, kind string, hash string"


def sightings(files: DataFrame, current: list[str], every: list[str], headings: tuple[str, ...] = (SECTION_HEADING,)) -> DataFrame:
    """Files (relpath, mtime, content) as SIGHTINGS: hash and words of their bodies, and the scopes that they are in."""
    body = strip_sections(strip_frontmatter(utf8(F.col("content"))), list(headings))

    def among(folders: list[str]) -> Column:
        out = F.lit(False)
        for f in folders:
            out = out | in_folder(F.col("relpath"), F.lit(f))
        return out

    own = files.select("relpath", "mtime", body.alias("body"))
    words = word_count(F.col("body"))
    return own.select("relpath", F.col("mtime").alias("seq"), F.lit("listed").alias("kind"), "mtime", among(current).alias("in_current"), among(every).alias("in_all"), F.when(words > 0, body_signature(F.col("body"))).alias("hash"), words.alias("words"))


def from_events(events: DataFrame) -> DataFrame:
    """Events (relpath, seq, kind, hash) as SIGHTINGS: kinds dirty, gone, forced and known; seq is a time in milliseconds, as that of files is."""
    none = lambda t: F.lit(None).cast(t)
    return events.select("relpath", "seq", "kind", none("long").alias("mtime"), none("boolean").alias("in_current"), none("boolean").alias("in_all"), "hash", none("int").alias("words"))


@dataclass(frozen=True)
class Refreshes:
    """The two queries of a refresh."""

    entries: StreamingQuery
    pending: StreamingQuery

    def settle(self) -> None:
        """Wait until both have taken what there is."""
        self.entries.processAllAvailable()
        self.pending.processAllAvailable()

    def stop(self) -> None:
        self.entries.stop()
        self.pending.stop()


def start_refreshes(
    spark: SparkSession, root: str, store: str, current: list[str], every: list[str], events: DataFrame | None = None, least_words: int = 0, most: int = 5, shards: int = 16, settle: int = 2000,
    tell: Callable[[DataFrame], None] | None = None, every_ms: int = 500,
) -> Refreshes:
    """Keep a snapshot of what is pending under a root, from the stream of its files and a stream of events (EVENTS).

    A file is read when its time changes.  tell gets the snapshot (scope,
    total, items) after each micro-batch that changes it; pending_now reads it
    at any time.  What a failed micro-batch has written is written again.
    """
    registered(spark)
    with_state_store(spark)
    files = spark.readStream.format("notes").option("settle", settle).load(root)
    seen = sightings(files, current, every)
    both = seen if events is None else seen.unionByName(from_events(events))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/changes/batch={number}")

    spark.createDataFrame([], CHANGES).write.mode("ignore").parquet(f"{store}/changes/batch=-1")  # the second query finds a folder
    start = lambda df, run, name: df.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{store}/checkpoints/{name}").trigger(processingTime=f"{every_ms} milliseconds").start()
    entries = start(entry_changes(both, least_words), keep, "entries")

    def snapshot(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        table = f"{store}/shards"
        new = batch.select("scope", "shard", "total", "items")
        save(load(spark, table, TOPS).join(new, ["scope", "shard"], "left_anti").unionByName(new), table)  # a few rows a shard
        if tell:
            tell(pending_now(spark, store, most))

    changes = spark.readStream.schema(CHANGES).option("basePath", f"{store}/changes").parquet(f"{store}/changes/batch=*")
    return Refreshes(entries, start(newest_by_shard(scope_changes(changes), most, shards), snapshot, "pending"))


def pending_now(spark: SparkSession, store: str, most: int = 5) -> DataFrame:
    """scope, total, items (relpath, mtime), newest first, as the last micro-batch left them."""
    return snapshot_of_shards(load(spark, f"{store}/shards", TOPS), most)
