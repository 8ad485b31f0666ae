"""A run over a folder of notes from end to end: read, index, relate, tag, then preview or write, and keep what the next run needs.

    python -m notefold.plans.batch --config FILE [--current | --all] [--preflight] [options]
    python -m notefold.plans.batch --root NOTES --store FOLDER [--scope DIR ...] [--url SERVER --embed-model M --chat-model M] [options]

    options: [--index] [--tag] [--preview] [--apply] [--apply-preview] [--limit N] [--refresh-all] [--rebuild] [--quiet]

The store is a folder that all executors share.  It holds the index in buckets,
versions of the state as Parquet, the preview as JSON lines and the log.  A
version counts once it is whole, so a run that breaks off leaves the one before.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.text import SECTION_HEADING
from notefold.operators import notes as N
from notefold.operators import writes as W
from notefold.operators.model import Client, HttpClient, OfflineClient, listed_models
from notefold.operators.preflight import preflight_checks, rollup
from notefold.plans.configured import configured
from notefold.plans.run import Settings, embedded, plan_writes, progress_lines, state_with
from notefold.plans.shared import kept
from notefold.sources.index import VectorIndex
from notefold.sources.notes import read_folder

STATE = "relpath string, hash string"
#: Refused lines of a preview that a result names; the log in the store has all.
SHOWN = 1000


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions under path, oldest first."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return [f"{path}/{n}" for n in names if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version under path; no rows without one."""
    have = versions(spark, path)
    return spark.read.schema(schema).parquet(have[-1]) if have else spark.createDataFrame([], schema)


def save(df: DataFrame, path: str) -> None:
    """Write df as the newest version under path; older ones go once it is whole."""
    spark = df.sparkSession
    have = versions(spark, path)
    number = int(have[-1].rsplit("/v", 1)[-1]) + 1 if have else 1
    df.write.mode("overwrite").parquet(f"{path}/v{number:08d}")
    for old in have:
        at, fs = _folder(spark, old)
        fs.delete(at, True)


def preview_lines(rows: DataFrame) -> DataFrame:
    """(relpath, value): a JSON line for each of rows (relpath, summary, tags, concepts, related)."""
    return rows.select("relpath", F.to_json(F.struct(F.col("relpath").alias("path"), "summary", "tags", "concepts", "related")).alias("value"))


def write_preview(rows: DataFrame, path: str) -> None:
    """A JSON line for each of rows (relpath, summary, tags, concepts, related), in order of paths; nothing is written without rows."""
    lines = kept(preview_lines(rows).orderBy("relpath").select("value"), "preview")
    if not lines.isEmpty():
        lines.write.mode("overwrite").text(path)


def read_preview(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of the lines of a preview, numbered in no order that matters; no rows where there is none."""
    at, fs = _folder(spark, path)
    lines = spark.read.text(path) if fs.exists(at) else spark.createDataFrame([], "value string")
    return lines.select(F.monotonically_increasing_id().alias("seq"), "value")


def preview_entries(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """relpath and updates of the preview lines (seq, value) whose code is OK."""
    v = F.from_json("value", f"path string, {W.UPDATES}")
    return lines.join(codes.where("code = 'OK'").select("seq"), "seq").select(v["path"].alias("relpath"), W.preview_updates(v).alias("updates"))


def preview_plan(notes: DataFrame, lines: DataFrame, root: str, section: bool = True, headings: tuple[str, ...] = (SECTION_HEADING,)) -> tuple[DataFrame, DataFrame]:
    """The planned writes of preview lines that are good, and seq, path, code of all; notes are (relpath, text)."""
    codes = kept(W.preview_codes(lines, notes.select("relpath", F.lit(True).alias("is_file")), root), "codes")
    good = preview_entries(lines, codes)
    core = F.transform(F.col("updates.related"), lambda p: F.struct(p.alias("path"), F.lit("core").alias("kind")))
    both = notes.select("relpath", "text").join(good, "relpath").withColumn("links", core)
    return W.planned_writes(both, section, headings), codes


@dataclass(frozen=True)
class Result:
    """What a run found and did: counts by name, and the lines of its log."""

    counts: dict[str, int]
    log: list[str]


def run(
    spark: SparkSession, root: str, store: str, client: Client, settings: Settings = Settings(), scopes: list[str] | None = None, index: bool = False, tag: bool = False, preview: bool = False,
    apply: bool = False, apply_preview: bool = False, limit: int | None = None, rebuild: bool = False, headings: tuple[str, ...] = (SECTION_HEADING,), min_words: int = 30, aliases: DataFrame | None = None, section: bool = True,
) -> Result:
    """One run; index and tag are both done where neither is asked for.

    Notes beyond limit count as gone, as those outside the scopes do.  Each
    model result is had once and kept in the shared folder before it is used.
    Notes are only changed with apply or apply_preview.
    """
    if apply_preview:
        notes = read_folder(spark, root, headings, 0)
        lines = kept(read_preview(spark, f"{store}/preview"), "lines")
        if lines.isEmpty():
            return Result({"preview": 0}, ["PREVIEW_EMPTY"])
        plan, codes = preview_plan(notes, lines, root, section, headings)
        refused = codes.where("code <> 'OK'")
        shown = refused.orderBy("seq").limit(SHOWN).collect()
        bad = [f"[skip] {r.code}: {r.path or '<missing>'}" for r in shown]
        if len(shown) == SHOWN and (more := refused.count() - SHOWN):  # all of them are in the log's table
            bad.append(f"[skip] {more} more refused lines")
        W.refusal_lines(refused).write.mode("append").text(f"{store}/log")
        plan = kept(plan, "plan")
        done = kept(W.apply_writes(plan, root), "written").count()
        save(N.upsert(load(spark, f"{store}/state", STATE), kept(W.state_after(plan.where("new_text is not null"), headings), "state"), "relpath"), f"{store}/state")
        return Result({"preview": codes.count(), "written": done}, bad)

    index, tag = (index, tag) if index or tag else (True, True)
    every = kept(read_folder(spark, root, headings, min_words, scopes), "notes")
    notes = kept(N.first_notes(every, limit), "chosen") if limit else every
    vectors, old_state = VectorIndex(spark, f"{store}/index"), load(spark, f"{store}/state", STATE)
    if rebuild:
        old_state = old_state.limit(0)
    changed = kept(N.changed_notes(notes, old_state), "changed")
    gone = N.removed_notes(old_state, notes).count()
    counts = {"notes": notes.count(), "changed": changed.count(), "removed": gone}
    log = [f"Removed {gone} notes from index"] if gone else []

    old_index = vectors.rows()
    away = kept(old_index.select("path").distinct().join(notes.select(F.col("relpath").alias("path")), "path", "left_anti"), "away")
    new_state = N.only_listed(old_state, notes, "relpath")
    if index:
        made, done = embedded(notes, old_state, old_index.limit(0) if rebuild else old_index, client, settings)
        new_state = state_with(old_state, notes, done)
        if rebuild:
            vectors.rebuild(made)
        elif not (made.isEmpty() and away.isEmpty()):
            vectors.upsert(made, away)  # the buckets of notes that changed or went
    elif not away.isEmpty():
        vectors.remove(away)
    vectors.compact()
    vectors.vacuum()
    new_index, new_state = vectors.rows(), kept(new_state, "state")
    if tag:
        plan, rows = plan_writes(notes, changed, new_index, client, aliases, settings, allowed=every.select(F.col("relpath").alias("path")), section=section, headings=headings)
        counts["planned"] = plan.count()
        progress_lines(rows, settings.related_limit).write.mode("append").text(f"{store}/log")
        if preview:
            write_preview(rows, f"{store}/preview")
        if apply:
            counts["written"] = kept(W.apply_writes(plan, root), "written").count()
            new_state = kept(N.upsert(new_state, W.state_after(plan.where("new_text is not null"), headings), "relpath"), "state")
    save(new_state, f"{store}/state")
    spark.createDataFrame([(line,) for line in [*log, *(f"{k}: {n}" for k, n in counts.items())]], "value string").coalesce(1).write.mode("append").text(f"{store}/log")
    return Result(counts, log)


def preflight(spark: SparkSession, config: str) -> dict:
    """Whether a run could start, what to say of it, and every check."""
    path, fs = _folder(spark, config)
    raw = "\n".join(r.value for r in spark.read.text(config).collect()) if fs.exists(path) else None  # one settings file
    checks = preflight_checks(spark, raw, listed_models)
    (whole,) = rollup(checks).collect()
    return {"ok": whole.ok, "summary": whole.summary, "checks": [{k: r[k] for k in ("code", "label", "status", "message")} for r in checks.orderBy("seq").collect()]}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("config", "root", "store", "url"):
        p.add_argument(f"--{name}")
    p.add_argument("--scope", action="append")
    p.add_argument("--limit", type=int)
    p.add_argument("--min-words", type=int, default=30)
    p.add_argument("--embed-model", default="")
    p.add_argument("--chat-model", default="")
    for name in ("index", "tag", "preview", "apply", "apply-preview", "refresh-all", "rebuild", "preflight", "quiet"):
        p.add_argument(f"--{name}", action="store_true")
    scope = p.add_mutually_exclusive_group()
    scope.add_argument("--current", action="store_true")
    scope.add_argument("--all", action="store_true")
    a = p.parse_args(args)
    if not a.config and not (a.root and a.store) or a.preflight and not a.config:
        p.error("a run needs a config, or a root and a store; a preflight needs a config")
    spark = SparkSession.builder.getOrCreate()
    if a.preflight:
        said = preflight(spark, a.config)
        print(json.dumps(said))
        return 0 if said["ok"] else 1
    what = dict(index=a.index, tag=a.tag, preview=a.preview, apply=a.apply, apply_preview=a.apply_preview, limit=a.limit, rebuild=a.rebuild)
    if a.config:
        own, code = configured(spark, a.config, "all" if a.all else "current" if a.current else None, a.root, a.store)
        if own is None:
            print(f"[error][{code}] No config can be read from {a.config}.", file=sys.stderr)
            return 1
        client = HttpClient(a.url, a.embed_model or own.client.embed_model, a.chat_model or own.client.chat_model) if a.url else own.client
        got = run(spark, own.root, own.store, client, replace(own.settings, refresh_all=a.refresh_all), a.scope or own.scopes, headings=own.headings, min_words=own.min_words, aliases=own.aliases, section=own.section, **what)
    else:
        client = HttpClient(a.url, a.embed_model, a.chat_model) if a.url else OfflineClient()
        got = run(spark, a.root, a.store, client, Settings(refresh_all=a.refresh_all), a.scope, min_words=a.min_words, **what)
    if not a.quiet:
        print("\n".join([*got.log, *(f"{k}: {n}" for k, n in got.counts.items())]))
    return 1 if got.log == ["PREVIEW_EMPTY"] else 0


if __name__ == "__main__":
    sys.exit(main())
