"""From raw documents to packed training sequences, in five stages over all documents.

Each stage is a function of (spark, docs, sf_dir); run() writes what it returns
as Parquet to the shared folder and reads it back for the next one.  Stages
decide by row; ids, which may repeat or be null, only choose what stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notefold.llm import exact_dedup, near_dedup
from notefold.llm.common import cut, table
from notefold.llm.packing import pack
from notefold.llm.quality import keep_good_rows
from notefold.llm.substring_dedup import cut_repeats_of_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble does not reject."""
    return keep_good_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.one_of_each(docs, width=5, share=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, keeps."""
    return cut_repeats_of_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids, and their places in sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, added=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("substrings", substrings), ("packing", packing)]

#: Learned rules, sketches and chunk boundaries have no SQL form; tests compare each stage with plain loops on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
