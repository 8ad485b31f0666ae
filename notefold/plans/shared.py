"""Results that a run uses more than once, kept in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; one of our own only where it names none and is one process. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="notefold-run-"))
    return _own[0]


def kept(df: DataFrame, label: str, **options: object) -> DataFrame:
    """df, written once (as Parquet, with its options) and read back: what made it, such as requests to a model, never runs again."""
    path = f"{shared_folder(df.sparkSession)}/notefold-run/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
