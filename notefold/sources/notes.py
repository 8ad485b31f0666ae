"""Note sources: folders of markdown files, and the same shapes derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions.text import SECTION_HEADING, body_signature, strip, strip_frontmatter, strip_sections, title_of, word_count
from notefold.sources.vault import usable_scopes


def utf8(content: Column) -> Column:
    """Bytes as text; bytes that are not UTF-8 are left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def read_folder(spark: SparkSession, root: str, headings: tuple[str, ...] = (SECTION_HEADING,), min_words: int = 30, scopes: list[str] | None = None) -> DataFrame:
    """Notes of all markdown files under root: relpath, title, text, body, mtime; only of the folders in scopes, if given, and no others are listed.

    Notes of under min_words words are left out; a folder that is not there has no notes.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.makeQualified(path).toString().rstrip("/")
    wanted = [f"{whole}/{s}" if s != "." else whole for s in usable_scopes(scopes)]
    have = [p for p in wanted if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    rel = F.substr(F.col("path"), F.lit(len(whole) + 2))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(have) if have else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    notes = found.select(rel.alias("relpath"), title_of(rel).alias("title"), utf8(F.col("content")).alias("text"), F.col("modificationTime").alias("mtime"))
    return notes.withColumn("body", strip_sections(strip_frontmatter(F.col("text")), list(headings))).where(word_count(F.col("body")) >= min_words)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: relpath, title, body, mtime."""
    d = load(spark, sf_dir, "documents")
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", rel.alias("relpath"), title_of(rel).alias("title"), F.concat(strip(F.col("text")), F.lit("\n")).alias("body"), F.col("doc_id").alias("mtime"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relpath, hash) as a run left it: every 7th stale, every 11th absent, and notes that are gone."""
    n = notes(spark, sf_dir)
    own = n.where("doc_id % 11 <> 0").select("relpath", F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(body_signature(F.col("body"))).alias("hash"))
    ghost = n.where("doc_id < 5").select(F.concat(F.lit("ghost/"), "title", F.lit(".md")).alias("relpath"), F.lit("gone").alias("hash"))
    return own.union(ghost)


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks: four a note, notes in ten folders."""
    note = F.floor(F.col("vec_id") / 4)
    path = F.concat(F.lit("f"), (note % 10).cast("string"), F.lit("/n"), note.cast("string"))
    return load(spark, sf_dir, "embeddings").select(path.alias("path"), (F.col("vec_id") % 4).cast("int").alias("chunk"), F.col("embedding").cast("array<double>").alias("v"))


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("note"), F.array("p_name", "p_type", "p_brand").alias("tags"))


def vault_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "modify", "click", "modify", "signup", "create", "purchase", "rename", "error", "delete")]), F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("kind"))
