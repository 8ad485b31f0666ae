"""What a config file says about a run: folders, thresholds, vocabularies, the model server and its limits."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.runtime import chosen_scope
from notefold.functions.text import SECTION_HEADING
from notefold.operators.model import HttpClient
from notefold.plans.run import Settings
from notefold.sources import config as C

# Keys of a config file and the settings that they are.
SETTING_OF = {
    "chunk_target_tokens": "target_tokens", "chunk_overlap_tokens": "overlap_tokens", "related_candidate_limit": "candidate_limit", "related_min_score": "min_score", "related_limit": "related_limit",
    "related_overreach": "overreach", "related_creative": "creative", "related_creative_min": "creative_low", "related_creative_max": "creative_high", "tag_limit": "tag_limit", "concept_limit": "concept_limit",
    "concept_max_words": "concept_max_words", "concept_case": "concept_case", "min_tag_length": "min_tag_length", "tag_max_words": "tag_max_words", "min_tag_frequency": "min_tag_frequency",
    "tag_frequency_fallback": "tag_frequency_fallback", "allow_free_tags": "allow_free_tags",
}
#: What holds where a config does not say.
DEFAULTS = Settings(candidate_limit=40, min_score=0.0, min_tag_frequency=1, concept_case="keep")
DEFAULT_TIMEOUT = 120


@dataclass(frozen=True)
class Configured:
    """A run as its config file has it."""

    root: str
    store: str
    scopes: list[str]
    settings: Settings
    client: HttpClient
    headings: tuple[str, ...]
    section: bool
    min_words: int
    aliases: DataFrame | None


def settings_of(config: dict[str, Any]) -> Settings:
    kinds = {f.name: type(getattr(DEFAULTS, f.name)) for f in fields(Settings)}
    said = {name: kinds[name](config[key]) for key, name in SETTING_OF.items() if config.get(key) is not None}
    return replace(DEFAULTS, by_notes=config.get("related_strategy", "chunk") != "chunk", **said)


def scopes_of(spark: SparkSession, config: dict[str, Any], mode: str | None) -> list[str]:
    """Folders of a mode (current, all or none)."""

    def folders(key: str) -> Column:
        own = config.get(key)
        return F.array(*map(F.lit, own)).cast("array<string>") if isinstance(own, list) else F.lit(None).cast("array<string>")

    values = F.struct(*(folders(k).alias(k) for k in ("notes_paths_all", "notes_paths_current", "notes_paths")), F.lit(config.get("notes_path")).cast("string").alias("notes_path"))
    (row,) = spark.range(1).select(chosen_scope(F.lit(mode or ""), values).alias("s")).collect()
    return [s for s in row.s or [] if s is not None]


def client_of(config: dict[str, Any]) -> HttpClient:
    plain = int(config.get("ollama_timeout_seconds", DEFAULT_TIMEOUT))
    return HttpClient(
        config["ollama_base_url"], config["embed_model"], config["llm_model"], int(config.get("ollama_embed_timeout_seconds", plain)), int(config.get("ollama_llm_timeout_seconds", plain)),
        int(config.get("ollama_retries", 1)), float(config.get("ollama_backoff_seconds", 2.0)),
    )


def _beside(folder: str, name: str) -> str:
    return name if posixpath.isabs(name) or "://" in name else posixpath.normpath(posixpath.join(folder, name))


def _text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def configured(spark: SparkSession, path: str, mode: str | None = None, root: str | None = None, store: str | None = None) -> tuple[Configured | None, str]:
    """A run and a code of load_config; None where the config is missing, broken or empty. Paths are relative to the config's folder, the store to the root."""
    config, code = C.load_config(spark, path)
    if config is None:
        return None, code
    folder = posixpath.dirname(path)
    root = root or _beside(folder, config.get("vault_root", "."))
    store = store or _beside(root, posixpath.dirname(config.get("db_path", "data/index")) or ".")
    controlled = C.controlled_tags(_text(spark, _beside(folder, config["controlled_tags_path"]))) if config.get("controlled_tags_path") else []
    raw = _text(spark, _beside(folder, config["tag_aliases_path"])) if config.get("tag_aliases_path") else None
    aliases = C.tag_aliases(spark.createDataFrame([(0, raw)], "seq int, raw string")) if raw is not None else None
    heading = config.get("mindmap_heading") or config.get("related_heading") or SECTION_HEADING
    section = config.get("write_mindmap_section", config.get("write_related_section", True))
    return Configured(root, store, scopes_of(spark, config, mode), replace(settings_of(config), controlled=controlled), client_of(config), (heading,), bool(section), int(config.get("min_note_words", 30)), aliases), code
