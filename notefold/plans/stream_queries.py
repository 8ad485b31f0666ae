"""Registered queries that run as streams with keyed state: tables become files of a stream, and what comes out is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.plans.queries import _EVENTS, _NOTES, _PENDING, _pending, query
from notefold.plans.shared import shared_folder
from notefold.sources import notes as src

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _through(spark: SparkSession, label: str, rounds: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str, schema: str) -> DataFrame:
    """What a stream gives for rounds of rows, each a run of its query from the same checkpoint; `batch` numbers its micro-batches."""
    from notefold.streaming.state import with_state_store

    base, before = f"{shared_folder(spark)}/notefold-stream/{label}-{uuid.uuid4().hex}", spark.conf.get(_PROVIDER)
    with_state_store(spark)
    try:
        for k, rows in enumerate(rounds):
            rows.write.parquet(f"{base}/in/round{k}")
            stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 32).parquet(f"{base}/in")
            kept = make(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
            kept.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{base}/out")


@query(f"""WITH {_EVENTS}, v AS (SELECT event_id, ts, substr(path, 2, 1) AS vault FROM ev), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY vault ORDER BY ts, event_id) + INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM v), s AS (SELECT *, sum(new) OVER (PARTITION BY vault ORDER BY ts, event_id) AS k FROM g),
b AS (SELECT vault, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 300000000 AS fires, count(*) AS n_events FROM s GROUP BY vault, k)
SELECT vault, started // 1000 AS started_ms, fires // 1000 AS fires_ms, n_events FROM b WHERE fires <= (SELECT epoch_us(max(ts)) FROM ev) - 3600000000""")
def debounced_stream(spark, d):
    from notefold.streaming.state import debounced_by_timers

    events = src.vault_events(spark, d).select(F.substring("path", 2, 1).alias("vault"), "ts")
    # the whole table comes before the watermark moves: an hour later than the latest event it is told what no event can join
    bursts = _through(spark, "bursts", [events], lambda s: debounced_by_timers(s, ("vault",), "300 seconds", "3600 seconds"), "append", "vault string, started timestamp, fires timestamp, n_events long")
    return bursts.select("vault", F.unix_millis("started").alias("started_ms"), F.unix_millis("fires").alias("fires_ms"), "n_events")


@query(f"WITH {_PENDING}, own AS (SELECT * FROM pend WHERE mtime % 10 <> 3), t AS (SELECT scope, count(*) AS total FROM own GROUP BY scope), i AS (SELECT scope, relpath FROM own QUALIFY row_number() OVER (PARTITION BY scope ORDER BY mtime DESC, relpath) <= 5) SELECT scope, total, string_agg(relpath, ',' ORDER BY relpath) AS items FROM t JOIN i USING (scope) GROUP BY scope, total")
def pending_stream(spark, d):
    from notefold.streaming.state import TOPS, newest_by_shard, snapshot_of_shards

    pending = _pending(spark, d)
    first = pending.select("scope", "relpath", "mtime", F.lit(True).alias("pending"), F.lit(1).cast("long").alias("seq"))
    done = first.where("mtime % 10 = 3").withColumns({"pending": F.lit(False), "seq": F.lit(2).cast("long")})  # a tenth stops being pending
    rows = _through(spark, "pending", [first, done], newest_by_shard, "update", TOPS)
    last = rows.groupBy("scope", "shard").agg(F.max_by(F.struct("total", "items"), "batch").alias("x")).select("scope", "shard", "x.*")
    return snapshot_of_shards(last).select("scope", "total", F.array_join(F.array_sort(F.transform("items", lambda x: x["relpath"])), ",").alias("items"))


@query(f"""WITH {_NOTES}, n AS (SELECT doc_id, relpath, mtime, sha1(body) AS hash FROM notes), known AS (SELECT relpath, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS was FROM n WHERE doc_id % 3 <> 0)
SELECT n.relpath, k.was IS DISTINCT FROM n.mtime OR doc_id % 13 = 0 AS scanned, CASE WHEN k.was IS DISTINCT FROM n.mtime OR doc_id % 13 = 0 THEN hash ELSE 'old' END AS hash, CASE WHEN k.was IS DISTINCT FROM n.mtime OR doc_id % 13 = 0 THEN doc_id % 4 <> 0 ELSE true END AS pending FROM n LEFT JOIN known k USING (relpath) WHERE doc_id % 11 <> 0""")
def rescan_stream(spark, d):
    from notefold.streaming.state import CHANGES, entry_changes

    n = src.notes(spark, d)
    yes, none = F.lit(True), F.lit(None)

    def rows(of: DataFrame, kind: str, seq: int, mtime=None, own=None) -> DataFrame:
        return of.select("relpath", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), (none if mtime is None else mtime).cast("long").alias("mtime"), yes.alias("in_current"), yes.alias("in_all"), (none if own is None else own).cast("string").alias("hash"), F.lit(9).alias("words"))

    was = rows(n.where("doc_id % 3 <> 0"), "listed", 1, F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")), F.lit("old"))
    now = rows(n.where("doc_id % 11 <> 0"), "listed", 2, F.col("mtime"), F.sha1(F.col("body").cast("binary")))
    gone = rows(n.where("doc_id % 11 = 0"), "gone", 2)
    dirty, told = rows(n.where("doc_id % 13 = 0"), "dirty", 2), rows(n.where("doc_id % 4 = 0"), "known", 2, own=F.sha1(F.col("body").cast("binary")))
    out = _through(spark, "entries", [was, told.union(dirty), now.union(gone)], entry_changes, "update", CHANGES)
    return out.groupBy("relpath").agg(F.max_by(F.struct("scanned", "hash", "pending", "gone"), "batch").alias("x")).where("not x.gone").select("relpath", "x.scanned", "x.hash", "x.pending")
