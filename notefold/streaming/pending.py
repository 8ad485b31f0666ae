"""Pending work from a stream of vault events, with Structured Streaming; the same functions serve batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("mtime", "in_current", "in_all")


def dirty_paths(events: DataFrame) -> DataFrame:
    """Paths of markdown files that events (path, kind, old_path if there is one) touch; a rename touches both of its paths."""
    old = F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")
    touched = events.where(F.col("kind").isin("create", "modify", "delete", "rename")).select(F.explode(F.array("path", old)).alias("path"))
    return touched.where(F.col("path").isNotNull() & F.endswith(F.lower("path"), F.lit(".md"))).distinct()


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a burst of each vault: events (ts) with pauses under the gap; fires when the gap has passed.

    by: columns that name the vault, none for a single one; late: watermark of a stream.
    """
    if late:
        events = events.withWatermark("ts", late)
    # streams need a key beside the session: a single vault gets one that is always zero
    keys = [F.col(c) for c in by] or [F.pmod(F.unix_micros("ts"), F.lit(1)).alias("__vault")]
    # windows that touch are one for Spark; a pause of just the gap ends a burst, so windows are a microsecond shorter
    burst = F.session_window("ts", f"{gap} -1 microseconds")
    return events.groupBy(*keys, burst.alias("w")).agg(F.count("*").alias("n_events")).select(*by, F.col("w.start").alias("started"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("fires"), "n_events")


def start_refresh(events: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str):
    """Call refresh with the dirty paths of each micro-batch; a running refresh delays the next, which then takes all that has come."""
    return events.writeStream.foreachBatch(lambda batch, _: refresh(dirty_paths(batch))).option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()


def rescan_needed(listed: DataFrame, known: DataFrame, dirty: DataFrame, forced: bool = False) -> DataFrame:
    """Listed files (relpath, mtime, scope flags if known has them) that must be read: all if forced, else new, modified or dirty ones and those whose scopes changed."""
    marks = [c for c in MARKS if c in listed.columns and c in known.columns]
    was = known.select("relpath", F.struct(*marks).alias("was"))
    seen = listed.join(was, "relpath", "left").join(dirty.select(F.col("path").alias("relpath"), F.lit(True).alias("dirty")).distinct(), "relpath", "left")
    return seen.where(F.lit(forced) | ~F.struct(*marks).eqNullSafe(F.col("was")) | F.coalesce("dirty", F.lit(False))).drop("was", "dirty")


def refreshed(entries: DataFrame, listed: DataFrame, dirty: DataFrame, read: Callable[[DataFrame], DataFrame], least_words: int = 0, forced: bool = False) -> DataFrame:
    """relpath, mtime, in_current, in_all, hash, scanned, updated: one row a listed file that stays an entry or was read.

    entries: what the last refresh gave (rows with a hash); listed: relpath,
    mtime, in_current, in_all; read adds hash and words to the files it is
    given, and only those that need it are.  A file read with too few words or
    no hash has a null hash: it is no entry.  What is not listed is gone.
    """
    kept = ("relpath", *MARKS, "hash")
    entries = entries.where("hash is not null")
    due = rescan_needed(listed, entries, dirty, forced)
    new = read(due).withColumn("hash", F.when((F.col("words") >= least_words) & (F.col("hash") != ""), F.col("hash")))
    old = entries.select(*kept).join(listed.select("relpath"), "relpath", "left_semi").join(due.select("relpath"), "relpath", "left_anti")
    no = F.lit(False)
    return old.select(*kept, no.alias("scanned"), no.alias("updated")).union(new.select(*kept, F.lit(True).alias("scanned"), F.col("hash").isNotNull().alias("updated")))


def refresh_metrics(refresh: DataFrame, listed: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row: listed, scanned, updated, tracked, dirty_paths of what refreshed gave."""
    own = refresh.agg(F.count_if("scanned").alias("scanned"), F.count_if("updated").alias("updated"), F.count("hash").alias("tracked"))
    few = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  # one row each
    return few(listed, "listed").join(own).join(few(dirty.distinct(), "dirty_paths"))
