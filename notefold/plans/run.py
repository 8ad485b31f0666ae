"""A batch run over notes: index what changed, relate, tag, and plan the writes. Every result is a DataFrame.

What a model says is kept in the shared folder before it is used, so each text
is sent once, and everything made from it agrees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions import text as T
from notefold.operators import fuzzy
from notefold.operators import notes as N
from notefold.operators import similarity as S
from notefold.operators import writes as W
from notefold.operators.model import Client, embed_chunks, extract_metadata
from notefold.plans.shared import kept


#: Characters of a note that stand for it where the index has no vectors of it.
ON_THE_FLY = 4000


@dataclass(frozen=True)
class Settings:
    target_tokens: int = 300
    overlap_tokens: int = 40
    candidate_limit: int = 120
    min_score: float = 0.6
    related_limit: int = 8
    overreach: int = 2
    creative: int = 2
    creative_low: float = 0.45
    creative_high: float = 0.7
    tag_limit: int = 3
    concept_limit: int = 4
    concept_max_words: int = 4
    concept_case: str = "lower"
    min_tag_length: int = 2
    tag_max_words: int = 3
    min_tag_frequency: int = 2
    tag_frequency_fallback: int = 1
    allow_free_tags: bool = True
    controlled: list[str] = field(default_factory=list)
    by_notes: bool = False
    refresh_all: bool = False


def embedded(notes: DataFrame, state: DataFrame, index: DataFrame, client: Client, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """New rows (path, chunk, v) of changed notes (all, if the index is empty), and (relpath, hash) of those that have any.

    A note whose embedding fails has none: it keeps its old rows and is tried again next time.
    """
    work = notes.withColumn("hash", T.body_signature(F.col("body"))) if index.isEmpty() else N.changed_notes(notes, state)
    chunks = work.select(F.col("relpath").alias("path"), F.posexplode(T.chunks(F.col("body"), s.target_tokens, s.overlap_tokens)).alias("chunk", "text"))
    made = kept(embed_chunks(chunks, client), "vectors")
    return made, work.join(made.select(F.col("path").alias("relpath")).distinct(), "relpath", "left_semi").select("relpath", "hash")


def state_with(state: DataFrame, notes: DataFrame, done: DataFrame) -> DataFrame:
    """The state of listed notes with the hashes of those that are done."""
    return N.upsert(N.only_listed(state, notes, "relpath"), done, "relpath")


def index_notes(notes: DataFrame, state: DataFrame, index: DataFrame, client: Client, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The index (path, chunk, v) and the state (relpath, hash) after a run: rows of changed notes are new, those of notes that are gone are dropped."""
    made, done = embedded(notes, state, index, client, s)
    return N.upsert(N.only_listed(index, notes), made), state_with(state, notes, done)


def relate(index: DataFrame, s: Settings = Settings(), allowed: DataFrame | None = None, only: DataFrame | None = None, strangers: DataFrame | None = None) -> DataFrame:
    """note, links (path, kind) in order, from chunk vectors or from their means; only to allowed notes (path), and only of the notes `only` (path) names, if given.

    Only those notes' vectors ask for neighbours, and those of strangers (path,
    chunk, v): notes that the index does not hold.
    """
    own = S.mean_vectors(index).withColumn("chunk", F.lit(0)) if s.by_notes else index
    asking = own.join(only, "path", "left_semi") if only is not None else None
    if strangers is not None:
        asking = (own if asking is None else asking).select("path", "chunk", "v").unionByName(strangers)
    if s.by_notes:
        ranked = S.candidates(S.knn_chunks(own, max(10, s.related_limit + 1), asking=asking).where(F.col("score") >= s.min_score), 0)
    else:
        ranked = S.candidates(S.knn_chunks(own, s.candidate_limit, asking=asking), s.min_score)
    if allowed is not None:
        ranked = S.among(ranked, allowed)
    chosen = S.select_links(ranked, s.related_limit, s.overreach, s.creative, s.creative_low, s.creative_high)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "path", "kind")))
    return chosen.groupBy("note").agg(F.transform(ordered, lambda e: F.struct(e["path"].alias("path"), e["kind"].alias("kind"))).alias("links"))


def tag_notes(notes: DataFrame, client: Client, aliases: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """relpath, summary, tags, concepts of notes whose metadata could be had; tags are mapped, capped, and counted over these notes."""
    said = extract_metadata(notes, client, tag_limit=s.tag_limit, concept_limit=s.concept_limit, controlled=s.controlled, allow_free=s.allow_free_tags)
    said = kept(said, "said").where("error is null")
    tagged = said.select(F.col("relpath").alias("note"), T.normalize_tags(F.col("tags")).alias("tags"))
    if aliases is not None:
        tagged = N.mapped_tags(tagged, aliases)
    mapped = fuzzy.controlled_tags(tagged, s.controlled, s.allow_free_tags, s.min_tag_length, s.tag_max_words)
    capped = mapped.select("note", F.slice("tags", 1, s.tag_limit).alias("tags"))
    often = N.frequent_tags(capped, s.min_tag_frequency, s.tag_frequency_fallback)
    concepts = T.normalize_concepts(F.col("concepts"), s.concept_max_words, s.concept_limit, s.concept_case)
    return said.select("relpath", "summary", concepts.alias("concepts")).join(often.withColumnRenamed("note", "relpath"), "relpath")


def plan_writes(notes: DataFrame, changed: DataFrame, index: DataFrame, client: Client, aliases: DataFrame | None = None, s: Settings = Settings(), allowed: DataFrame | None = None, section: bool = True, headings: tuple[str, ...] = (T.SECTION_HEADING,)) -> tuple[DataFrame, DataFrame]:
    """The planned writes (relpath, new_text, changed) and what a preview shows (relpath, summary, tags, concepts, related).

    For the notes (relpath, text, body) that changed names, or for all if they are refreshed.
    """
    work = notes if s.refresh_all else notes.join(changed.select("relpath"), "relpath", "left_semi")
    tagged = tag_notes(work, client, aliases, s)
    asking, strangers = work.select(F.col("relpath").alias("path")), None
    if s.by_notes:  # a note without vectors is embedded as it begins, for its own links alone
        unknown = work.select(F.col("relpath").alias("path"), F.lit(0).alias("chunk"), F.substring("body", 1, ON_THE_FLY).alias("text")).join(index, "path", "left_anti")
        strangers = kept(embed_chunks(unknown, client), "strangers")
    links = relate(index, s, allowed, asking, strangers).withColumnRenamed("note", "relpath")
    none = F.array().cast("array<struct<path:string,kind:string>>")
    both = work.select("relpath", "text").join(tagged, "relpath").join(links, "relpath", "left").withColumn("links", F.coalesce("links", none))
    both = kept(both.withColumn("related", F.transform("links", lambda x: x["path"])), "plan")
    updates = F.struct("summary", "tags", "concepts", "related")
    return W.planned_writes(both.select("relpath", "text", updates.alias("updates"), "links"), section, headings), both.select("relpath", "summary", "tags", "concepts", "related")


def progress_lines(rows: DataFrame, limit: int) -> DataFrame:
    """(value) a line for each note (relpath, related) of a run: how many links it has, and how many it may have."""
    return rows.select(F.concat(F.lit("[related] "), "relpath", F.lit(" -> "), F.size("related").cast("string"), F.lit(f"/{limit}")).alias("value"))
