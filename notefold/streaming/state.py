"""Refreshes, newest pending notes and bursts as keyed state of a stream: a micro-batch touches the state of its own keys only.

State lies in RocksDB (a session names that provider once, see
with_state_store) and outlives a restart by the checkpoint.  The same rows cut
into other micro-batches give the same state.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGHTINGS = "relpath string, seq long, kind string, mtime long, in_current boolean, in_all boolean, hash string, words int"
CHANGES = "relpath string, mtime long, in_current boolean, in_all boolean, hash string, scanned boolean, updated boolean, gone boolean, pending boolean, seq long"
TOPS = "scope string, shard int, total long, items array<struct<mtime: long, relpath: string>>"
BURSTS = "started timestamp, fires timestamp, n_events long"


def with_state_store(spark: SparkSession) -> None:
    """Let streams that the session starts from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Entries(StatefulProcessor):
    def __init__(self, least_words: int):
        self._least = least_words

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value a file, so that a micro-batch asks for it once and puts it back once
        self._file = handle.getValueState("file", "mtime long, in_current boolean, in_all boolean, hash string, known string, dirty boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = known = None
        dirty = forced = False
        self._seq = 0
        for r in rows:  # the last sighting and the last known hash count, in whatever order rows come
            if r.kind in ("listed", "gone") and (seen is None or r.seq > seen.seq):
                seen = r
            elif r.kind == "known" and (known is None or r.seq > known.seq):
                known = r
            dirty, forced, self._seq = dirty or r.kind == "dirty", forced or r.kind == "forced", max(self._seq, r.seq)
        self._was = self._file.get()
        was = tuple(self._was) if self._was else (None, None, None, None, None, False)
        entry = was[:4] if was[3] is not None else None
        told = was[4] if known is None else known.hash
        dirty = dirty or was[5]
        if seen is None:  # what a dirty file holds is known once it is listed again
            self._keep(entry, told, dirty or forced)
            if known is not None and entry is not None:
                yield self._row(key, entry, told, False, False)
            return
        if seen.kind == "gone":
            self._keep(None, told, False)
            yield Row(relpath=key[0], mtime=seen.mtime, in_current=False, in_all=False, hash=None, scanned=False, updated=False, gone=True, pending=False, seq=self._seq)
            return
        marks = (seen.mtime, seen.in_current, seen.in_all)
        if entry is not None and entry[:3] == marks and not dirty and not forced:
            self._keep(entry, told, False)
            yield self._row(key, entry, told, False, False)
            return
        good = seen.hash if seen.hash and (seen.words or 0) >= self._least else None
        entry = (*marks, good)
        self._keep(entry if good else None, told, False)
        yield self._row(key, entry, told, True, good is not None)

    def _keep(self, entry, told: str | None, dirty: bool) -> None:
        now = (*(entry or (None,) * 4), told, dirty)
        if now == (None,) * 5 + (False,):
            if self._was:
                self._file.clear()
        elif not self._was or now != tuple(self._was):
            self._file.update(now)

    def _row(self, key, entry, known: str | None, scanned: bool, updated: bool) -> Row:
        mtime, current, every, own = entry
        return Row(relpath=key[0], mtime=mtime, in_current=current, in_all=every, hash=own, scanned=scanned, updated=updated, gone=False, pending=own is not None and own != known, seq=self._seq)

    def close(self) -> None:
        pass


def entry_changes(sightings: DataFrame, least_words: int = 0) -> DataFrame:
    """One row (CHANGES) for each file that a micro-batch of sightings (SIGHTINGS) tells of.

    kind is `listed` (mtime, scope flags, and hash and words of the content),
    `gone`, `dirty` (an event touched the file), `forced` (it has to be read
    whatever its marks) or `known` (hash as the last run left it).  Of several
    in a micro-batch the one with the highest seq counts.  A listed file is
    scanned if it is no entry yet, its mtime or flags changed, or it is dirty
    or forced; one of under least_words words or without a hash is no entry.
    pending: an entry whose hash is not the known one.
    """
    return sightings.groupBy("relpath").transformWithState(_Entries(least_words), CHANGES, "Update", "None")


class _Newest(StatefulProcessor):
    """Of a shard of a scope: all pending notes, and the first of them in order as a list that is filled again only when retractions empty it."""

    def __init__(self, most: int, spare: int):
        self._most, self._room = most, most + spare

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._all = handle.getMapState("all", "relpath string", "mtime long")
        self._top = handle.getListState("top", "order long, relpath string")
        self._total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last: dict[str, Row] = {}
        for r in rows:
            if r.relpath not in last or r.seq > last[r.relpath].seq:
                last[r.relpath] = r
        total = self._total.get()[0] if self._total.exists() else 0
        top = [(int(o), p) for o, p in self._top.get()]
        whole = len(top) == total  # else notes stand behind the list's last
        for path, r in last.items():
            was = self._all.getValue((path,))
            if was is not None:
                at = bisect.bisect_left(top, (-was[0], path))
                if at < len(top) and top[at] == (-was[0], path):
                    del top[at]
                total -= 1
                self._all.removeKey((path,)) if not r.pending else None
            if r.pending:
                self._all.updateValue((path,), (r.mtime,))
                total += 1
                if whole or (top and (-r.mtime, path) < top[-1]):
                    bisect.insort(top, (-r.mtime, path))
            if len(top) > self._room:
                top, whole = top[: self._room], False
            if not whole and len(top) < self._most:
                top = self._filled()
                whole = len(top) == total
        self._total.update((total,))
        self._top.put(top) if top else self._top.clear()
        yield Row(scope=key[0], shard=key[1], total=total, items=[Row(mtime=-o, relpath=p) for o, p in top[: self._most]])

    def _filled(self) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        for (path,), (mtime,) in self._all.iterator():
            if len(out) < self._room or (-mtime, path) < out[-1]:
                bisect.insort(out, (-mtime, path))
                del out[self._room :]
        return out

    def close(self) -> None:
        pass


def newest_by_shard(changes: DataFrame, most: int = 5, shards: int = 16, spare: int = 45) -> DataFrame:
    """scope, shard, total, items: what a micro-batch of changes (scope, relpath, mtime, pending, seq) leaves pending in each shard that it touches.

    A scope is dealt to shards by path, so no task holds all of it.  Of several
    changes of a note in a micro-batch the one with the highest seq counts.
    """
    dealt = changes.withColumn("shard", F.pmod(F.xxhash64("relpath"), F.lit(shards)).cast("int"))
    return dealt.groupBy("scope", "shard").transformWithState(_Newest(most, spare), TOPS, "Update", "None")


def scope_changes(changes: DataFrame) -> DataFrame:
    """Rows of entry_changes (with a seq) as changes of scopes: a note is pending in each scope that it is in."""
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), (F.col("pending") & F.col(c) & ~F.col("gone")).alias("pending")) for s, c in (("current", "in_current"), ("all", "in_all"))))
    return changes.select("relpath", F.coalesce("mtime", F.lit(0)).alias("mtime"), "seq", F.explode(scopes).alias("s")).select("s.scope", "relpath", "mtime", "s.pending", "seq")


def snapshot_of_shards(shards: DataFrame, most: int = 5) -> DataFrame:
    """scope, total, items (relpath, mtime), newest first, of the last row of each shard; a few rows a scope. Scopes without pending notes have no row."""
    each = shards.where("total > 0").select("scope", F.explode("items").alias("x"))
    first = each.select("scope", "x.*", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("x.mtime").desc(), "x.relpath")).alias("pos")).where(F.col("pos") <= most)
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "relpath", "mtime"))), lambda x: F.struct(x["relpath"].alias("relpath"), x["mtime"].alias("mtime")))
    return shards.groupBy("scope").agg(F.sum("total").alias("total")).join(first.groupBy("scope").agg(items.alias("items")), "scope")


class _Bursts(StatefulProcessor):
    """Open bursts of a vault in order of time; each is told once its gap has passed the watermark. One timer a vault waits for the first of them."""

    def __init__(self, gap_us: int):
        self._gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        bursts = sorted(tuple(map(int, b)) for b in self._open.get())
        before = self._timer(bursts[0]) if bursts else None
        for r in rows:
            at = bisect.bisect_left(bursts, (r.us,))
            first, last, n = r.us, r.us, 1
            while at < len(bursts) and bursts[at][0] < last + self._gap:  # the burst behind it begins within the gap
                last, n = max(last, bursts[at][1]), n + bursts[at][2]
                del bursts[at]
            if at and first < bursts[at - 1][1] + self._gap:
                at -= 1
                first, last, n = bursts[at][0], max(last, bursts[at][1]), n + bursts[at][2]
                del bursts[at]
            bursts.insert(at, (first, last, n))
        after = self._timer(bursts[0]) if bursts else None
        if before is not None and before != after:
            self._handle.deleteTimer(before)
        if after is not None and before != after:
            self._handle.registerTimer(after)
        self._open.put(bursts) if bursts else self._open.clear()
        return iter(())

    def _timer(self, burst: tuple[int, int, int]) -> int:
        return -(-(burst[1] + self._gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        bursts = sorted(tuple(map(int, b)) for b in self._open.get())
        over = [b for b in bursts if self._timer(b) <= passed]
        rest = bursts[len(over) :]
        self._open.put(rest) if rest else self._open.clear()
        if rest:
            self._handle.registerTimer(self._timer(rest[0]))
        for first, last, n in over:
            yield Row(**dict(zip(self._keys, key, strict=True)), started_us=first, fires_us=last + self._gap, n_events=n)

    def close(self) -> None:
        pass


def debounced_by_timers(events: DataFrame, by: tuple[str, ...], gap: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """by.., started, fires, n_events: one row a burst of each vault (the columns `by`) of a stream of events (ts), once no event can join it.

    A burst is events with pauses under the gap; it is told when the watermark,
    the latest event less `late`, reaches the gap's end.  Events that come later
    than that are dropped.  The state of a vault is its open bursts.
    """
    if not by:
        raise ValueError("a stream has to name the columns of its vaults")
    gap_us = events.sparkSession.sql(f"SELECT unix_micros(timestamp '2000-01-01 00:00:00' + interval {gap}) - unix_micros(timestamp '2000-01-01 00:00:00')").first()[0]
    kinds = dict(events.dtypes)
    bursts = _Bursts(int(gap_us))
    bursts._keys = by
    marked = events.withWatermark("ts", late).select(*by, "ts", F.unix_micros("ts").alias("us"))
    out = marked.groupBy(*by).transformWithState(bursts, ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["started_us long", "fires_us long", "n_events long"]), "Append", "EventTime")
    return out.select(*by, F.timestamp_micros("started_us").alias("started"), F.timestamp_micros("fires_us").alias("fires"), "n_events")
