"""Checks before a run, as a table in order."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.sources.config import read_config

CHECKS = "seq int, code string, label string, status string, message string"
#: What a config has to name.
REQUIRED = ("ollama_base_url", "embed_model", "llm_model")


def preflight_checks(spark: SparkSession, raw_config: str | None, models: Callable[[str], list[str]], needs: tuple[str, ...] = ("pyarrow", "numpy")) -> DataFrame:
    """Checks of interpreter, packages, config, its values, the model server and its models; models(base_url) lists what the server has."""
    rows: list[tuple[str, str, bool, str]] = [("PYTHON_RUNTIME_OK", "Python runtime", True, sys.executable)]
    for name in needs:
        have = importlib.util.find_spec(name) is not None
        rows.append((f"DEPENDENCY_{name.upper()}_{'OK' if have else 'MISSING'}", "Python dependency", have, name))
    config, code = read_config(raw_config)
    rows.append((code, "Config file", config is not None, code))
    if config is not None:
        value = {k: str(config.get(k, "")).strip() for k in REQUIRED}
        absent = [k for k, v in value.items() if not v]
        if absent:
            rows.append(("CONFIG_FIELDS_MISSING", "Config values", False, ", ".join(absent)))
        else:
            rows += _server(value, models)
    return spark.createDataFrame([(k, c, label, "ok" if ok else "error", m) for k, (c, label, ok, m) in enumerate(rows)], CHECKS)


def _server(value: dict[str, str], models: Callable[[str], list[str]]) -> list[tuple[str, str, bool, str]]:
    try:
        have = models(value["ollama_base_url"])
    except Exception as e:
        return [("OLLAMA_UNREACHABLE", "Model server", False, str(e))]
    bases = {x.split(":", 1)[0] for x in have}
    absent = [m for m in (value["embed_model"], value["llm_model"]) if m not in have and m.split(":", 1)[0] not in bases]
    return [("OLLAMA_REACHABLE", "Model server", True, value["ollama_base_url"]), ("OLLAMA_MODELS_MISSING" if absent else "OLLAMA_MODELS_OK", "Models", not absent, ", ".join(absent))]


def rollup(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by.., ok, summary of checks (seq, status, message): the first error's message."""
    bad = F.expr("min_by(message, seq) filter (where status = 'error')")
    return checks.groupBy(*by).agg(F.bool_and(F.col("status") == "ok").alias("ok"), F.coalesce(bad, F.lit("Preflight passed.")).alias("summary"))
