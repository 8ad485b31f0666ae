"""Configuration, run state, vocabularies and logs: small JSON files around the notes, and tables of the same shape."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.runtime import scope_path, scope_paths


def read_config(raw: str | None) -> tuple[dict | None, str]:
    """Settings and a code: CONFIG_MISSING (no file), CONFIG_INVALID (no JSON), CONFIG_EMPTY (no object, or none in it), CONFIG_OK."""
    if raw is None:
        return None, "CONFIG_MISSING"
    try:
        config = json.loads(raw)
    except json.JSONDecodeError:
        return None, "CONFIG_INVALID"
    return (config, "CONFIG_OK") if isinstance(config, dict) and config else (None, "CONFIG_EMPTY")


def load_config(spark: SparkSession, *places: str) -> tuple[dict | None, str]:
    """read_config of the first place that exists, by whatever file system its path names."""
    jvm = spark._jvm
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read_config("\n".join(r.value for r in spark.read.text(place).collect()))  # one settings file
    return read_config(None)


def config_code(raw: Column) -> Column:
    """The code of read_config for a column of file contents."""
    v = F.try_parse_json(raw)
    return F.when(raw.isNull(), "CONFIG_MISSING").when(v.isNull(), "CONFIG_INVALID").when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")) & (F.schema_of_variant(v) != "OBJECT<>"), "CONFIG_OK").otherwise("CONFIG_EMPTY")


def updated_scopes(raw: Column, current: Column, every: Column) -> Column:
    """A config's text with its three scope keys set to usable folders, in order; other keys stay. Null where it is no JSON object, or a scope has no usable folder."""
    held = F.try_variant_get(F.try_parse_json(raw), "$", "map<string, variant>")
    one, two = scope_paths(current), scope_paths(every)
    new = {"notes_paths": one, "notes_paths_current": one, "notes_paths_all": two}
    rest = F.map_filter(held, lambda k, _: ~k.isin(*new))
    made = F.map_concat(rest, F.create_map(*(x for k, v in new.items() for x in (F.lit(k), F.parse_json(F.to_json(v))))))
    return F.when((F.size(one) > 0) & (F.size(two) > 0) & held.isNotNull(), F.to_json(made))


def with_scopes(raw: str, current: Iterable[str], every: Iterable[str]) -> str:
    """updated_scopes of one config file, indented; what is wrong is an error."""
    names = "raw string, current array<string>, every array<string>"
    row = SparkSession.active().createDataFrame([(raw, list(current), list(every))], names).select(updated_scopes(F.col("raw"), F.col("current"), F.col("every"))).first()
    if row[0] is None:
        raise ValueError("the config has to be a JSON object, and both scopes need at least one folder")
    return json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False) + "\n"


def state_of(raw: Column) -> Column:
    """Entries (relpath, hash) of a state file's text {"files": {path: {"hash": ...}}}; what has another shape is left out."""
    files = F.try_variant_get(F.try_parse_json(raw), "$.files", "map<string, variant>")
    hash_of = lambda v: F.try_variant_get(v, "$.hash", "variant")
    entry = lambda e: F.struct(F.replace(e["key"], F.lit("\\"), F.lit("/")).alias("relpath"), F.try_variant_get(e["value"], "$.hash", "string").alias("hash"), F.schema_of_variant(hash_of(e["value"])).alias("kind"))
    return F.filter(F.transform(F.map_entries(files), entry), lambda e: e["kind"] == "STRING")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(relpath, hash) from a JSON state file, or from a folder that write_state has made."""
    if path.endswith(".json"):
        return spark.read.text(path, wholetext=True).select(F.inline(state_of(F.col("value")))).select("relpath", "hash")
    return spark.read.schema("relpath string, hash string").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    state.select("relpath", "hash").write.mode("overwrite").parquet(path)


def controlled_tags(raw: str | None) -> list[str]:
    """A controlled vocabulary from the text of a JSON list; anything else is no vocabulary."""
    try:
        own = json.loads(raw or "[]")
    except json.JSONDecodeError:
        return []
    return [str(x) for x in own] if isinstance(own, list) else []


def tag_aliases(table: DataFrame) -> DataFrame:
    """(alias, canonical) of rows (seq, raw): JSON objects whose lists name aliases of their key, and whose strings name what their key means.

    Empty names are left out; of several entries for an alias the last wins.
    """
    each = table.select("seq", F.posexplode(F.map_entries(F.try_variant_get(F.try_parse_json("raw"), "$", "map<string, variant>"))).alias("i", "e"))
    key, value = F.col("e.key"), F.col("e.value")
    kind = F.schema_of_variant(value)
    listed = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda a: F.struct(a.alias("alias"), key.alias("canonical")))
    single = F.array(F.struct(key.alias("alias"), F.try_variant_get(value, "$", "string").alias("canonical")))
    none = F.array().cast("array<struct<alias:string,canonical:string>>")
    pairs = each.select("seq", "i", F.posexplode(F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(kind == "STRING", single).otherwise(none)).alias("k", "p"))
    named = pairs.where("p.alias <> '' and p.canonical <> ''")
    return named.groupBy(F.col("p.alias").alias("alias")).agg(F.max_by("p.canonical", F.struct("seq", "i", "k")).alias("canonical"))


def run_log(steps: DataFrame) -> DataFrame:
    """(value) lines of a run in order of seq: '[code] note' or the message alone. steps: seq, code, note, msg."""
    line = F.when(F.col("code").isNotNull(), F.concat(F.lit("["), "code", F.lit("] "), F.coalesce("note", F.lit("")), F.when(F.col("msg").isNotNull(), F.concat(F.lit(" "), "msg")).otherwise(""))).otherwise(F.coalesce("msg", F.lit("")))
    return steps.orderBy("seq").select(line.alias("value"))


def write_log(steps: DataFrame, path: str) -> None:
    run_log(steps).write.mode("overwrite").text(path)


def scopes_table(spark: SparkSession, scopes: dict[str, list[str]]) -> DataFrame:
    """(scope, folder) of usable folders; a few rows of configuration."""
    rows = [(s, f) for s, folders in scopes.items() for f in folders]
    return spark.createDataFrame(rows, "scope string, folder string").withColumn("folder", scope_path(F.col("folder"))).where("folder is not null")
