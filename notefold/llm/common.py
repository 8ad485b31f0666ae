"""Helpers that the training-data operators share.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``, through Spark's own writers, so that every executor
and the driver see them and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []

#: Characters that separate words: space and \x09 to \x0D, as Python's bytes.split() has them.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the session names none and is one process (tests). A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="notefold-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/notefold/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what cut wrote for df; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for every row (its file and its place there, the same each time it is read), and that column's name.

    What is not read from Parquet files as it is goes to the shared folder first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = cut(docs, "rows")
    row, path, at, file = (fresh(docs, x) for x in ("__row", "__path", "__at", "__file"))
    place = docs.metadataColumn("_metadata")
    placed = docs.select("*", place["file_path"].alias(path), place["row_index"].alias(at))
    files = sorted(r[0] for r in placed.select(path).distinct().collect())
    number = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{file} long, {path} string")
    return placed.join(F.broadcast(number), path).select(*(docs[f"`{c}`"] for c in docs.columns), (F.shiftleft(file, 40) + F.col(at)).alias(row)), row


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold; long texts fill a batch with few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the machine at the end of its rows: workers that wait for the next task stay small."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return wrapped


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_remainder(id_col: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text (null: empty), and more where named, under names that nothing else in docs can clash with."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)
