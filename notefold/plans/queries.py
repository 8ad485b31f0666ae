"""Registered queries of the note engine and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions import runtime as R
from notefold.functions import text as T
from notefold.operators import fuzzy
from notefold.operators import notes as N
from notefold.operators import similarity as S
from notefold.operators import writes as W
from notefold.operators.preflight import rollup
from notefold.plans import batch, run
from notefold.sources import notes as src
from notefold.streaming import pending as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NOTES = r"""notes AS (SELECT doc_id, source || '/' || doc_id || '.md' AS relpath, CAST(doc_id AS VARCHAR) AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) AS body, doc_id AS mtime FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS words FROM notes)"""
_STATE = """state AS (SELECT relpath, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha1(body) END AS hash FROM notes WHERE doc_id % 11 <> 0
UNION ALL SELECT 'ghost/' || title || '.md', 'gone' FROM notes WHERE doc_id < 5)"""
_CHUNKS = """chunks AS (SELECT 'f' || ((vec_id // 4) % 10) || '/n' || (vec_id // 4) AS path, CAST(vec_id % 4 AS INTEGER) AS chunk, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
_KNN = f"""{_CHUNKS}, near AS (SELECT q.path AS note, q.chunk, c.path, c.chunk AS path_chunk, round(list_cosine_similarity(q.v, c.v), 9) AS score FROM chunks q, chunks c
QUALIFY row_number() OVER (PARTITION BY q.path, q.chunk ORDER BY score DESC, c.path, c.chunk) <= 40)"""
_RANKED = f"""{_KNN}, best AS (SELECT note, path, max(score) AS score FROM near WHERE note <> path AND score >= 0.15 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY score DESC, path) AS r FROM best)"""
_TAG = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"""
_TAGS = f"""raw AS (SELECT p_partkey AS note, [p_name, p_type, p_brand] AS raw FROM part), each AS (SELECT note, i, {_TAG} AS tag FROM (SELECT note, unnest(raw) AS t, unnest(range(3)) AS i FROM raw)),
once AS (SELECT note, tag, min(i) AS i FROM each WHERE tag <> '' GROUP BY ALL), tags AS (SELECT note, list(tag ORDER BY i) AS tags FROM once GROUP BY note)"""
_EVENTS = """ev AS (SELECT event_id, ts, 'u' || user_id || '.md' AS path, CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'modify' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' END AS kind FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_NOTES} SELECT relpath, title, CAST(len(words) AS INTEGER) AS n_words, sha1(body) AS hash FROM w WHERE len(words) >= 30")
def scan_notes(spark, d):
    n = src.notes(spark, d)
    return n.select("relpath", "title", T.word_count(F.col("body")).alias("n_words"), T.body_signature(F.col("body")).alias("hash")).where("n_words >= 30")


@query(f"WITH {_NOTES} SELECT relpath FROM w WHERE len(words) >= 30")
def filter_min_words(spark, d):
    return src.notes(spark, d).where(T.word_count(F.col("body")) >= 30).select("relpath")


@query(f"WITH {_NOTES} SELECT relpath, CAST(len(words) AS INTEGER) AS n_words FROM w")
def word_count(spark, d):
    return src.notes(spark, d).select("relpath", T.word_count(F.col("body")).alias("n_words"))


@query(f"WITH {_NOTES} SELECT relpath, sha1(body) AS hash FROM notes")
def body_signature(spark, d):
    return src.notes(spark, d).select("relpath", T.body_signature(F.col("body")).alias("hash"))


@query(r"""SELECT p_partkey, regexp_extract(replace(p_name, ' ', '/') || '.v1.md', '([^/]+?)(\.[^./]*)?$', 1) AS title FROM part""")
def title_from_path(spark, d):
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".v1.md"))
    return src.load(spark, d, "part").select("p_partkey", T.title_of(path).alias("title"))


@query(f"WITH {_NOTES}, p AS (SELECT relpath FROM notes UNION ALL SELECT title || '.md' FROM notes) SELECT relpath, split_part(relpath, '/', 1) AS folder FROM p")
def top_level_folder(spark, d):
    n = src.notes(spark, d)
    paths = n.select("relpath").union(n.select(F.concat("title", F.lit(".md"))))
    return paths.select("relpath", T.top_folder(F.col("relpath")).alias("folder"))


_SCOPES = "scopes AS (SELECT * FROM (VALUES ('current', 'src0'), ('current', 'src1'), ('all', '.')) s(scope, folder))"


def _scopes(spark):
    return spark.createDataFrame([("current", "src0"), ("current", "src1"), ("all", ".")], "scope string, folder string")


@query(f"WITH {_NOTES}, {_SCOPES} SELECT DISTINCT scope, relpath FROM notes, scopes WHERE folder = '.' OR relpath = folder OR starts_with(relpath, folder || '/')")
def scope_filter(spark, d):
    return N.in_scopes(src.notes(spark, d), _scopes(spark))


@query(f"WITH {_NOTES}, {_SCOPES} SELECT scope, relpath FROM notes, scopes WHERE folder = '.' OR relpath = folder OR starts_with(relpath, folder || '/')")
def scope_union(spark, d):
    n, s = src.notes(spark, d), F.broadcast(_scopes(spark))
    return n.join(s, T.in_folder(n["relpath"], s["folder"])).select("scope", "relpath")


_CHUNK_TEXT = f"""WITH {_NOTES}, c AS (SELECT relpath, words, unnest(range(CASE WHEN len(words) = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((len(words) - 225) / 195.0) AS BIGINT)) END)) AS i FROM w)"""


@query(_CHUNK_TEXT + " SELECT relpath, CAST(i AS INTEGER) AS chunk, array_to_string(words[i * 195 + 1 : i * 195 + 225], ' ') AS text FROM c")
def chunk_text(spark, d):
    return src.notes(spark, d).select("relpath", F.posexplode(T.chunks(F.col("body"))).alias("chunk", "text"))


@query(_CHUNK_TEXT + " SELECT relpath, count(*) AS n_chunks FROM c GROUP BY relpath")
def chunk_counts(spark, d):
    return chunk_text(spark, d).groupBy("relpath").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {_NOTES} SELECT relpath, substr(body, 1, 2000) AS doc FROM notes")
def truncate_doc(spark, d):
    return src.notes(spark, d).select("relpath", F.substring("body", 1, 2000).alias("doc"))


@query(f"WITH {_NOTES}, {_STATE} SELECT relpath, hash FROM state")
def load_state(spark, d):
    return src.state(spark, d)


@query(f"WITH {_NOTES}, {_STATE} SELECT n.relpath, sha1(n.body) AS hash FROM notes n LEFT JOIN state s USING (relpath) WHERE sha1(n.body) IS DISTINCT FROM s.hash")
def changed_notes(spark, d):
    return N.changed_notes(src.notes(spark, d), src.state(spark, d)).select("relpath", "hash")


@query(f"WITH {_NOTES}, {_STATE} SELECT relpath FROM state WHERE relpath NOT IN (SELECT relpath FROM notes)")
def removed_notes(spark, d):
    return N.removed_notes(src.state(spark, d), src.notes(spark, d)).select("relpath")


@query(f"WITH {_NOTES} SELECT relpath FROM notes ORDER BY relpath LIMIT 20")
def limit_notes(spark, d):
    return N.first_notes(src.notes(spark, d).select("relpath"), 20)


@query(f"WITH {_CHUNKS} SELECT path, chunk, v[1] AS first FROM chunks WHERE path = 'f3/n13'")
def vector_get(spark, d):
    return src.chunk_vectors(spark, d).where("path = 'f3/n13'").select("path", "chunk", F.element_at("v", 1).alias("first"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS n FROM chunks")
def vector_count(spark, d):
    return src.chunk_vectors(spark, d).agg(F.count("*").alias("n"))


@query(f"WITH {_CHUNKS}, u AS (SELECT * FROM chunks WHERE path NOT LIKE 'f1/%' UNION ALL SELECT path, 0, list_transform(v, lambda x: 1.0::DOUBLE) FROM chunks WHERE path LIKE 'f1/%' AND chunk = 0) SELECT path, chunk, CAST(len(v) AS INTEGER) AS size, round(list_sum(v), 6) AS total FROM u")
def vector_upsert(spark, d):
    c = src.chunk_vectors(spark, d)
    new = N.upsert(c, c.where("path like 'f1/%' and chunk = 0").withColumn("v", F.transform("v", lambda x: F.lit(1.0))))
    return new.select("path", "chunk", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_CHUNKS} SELECT path, chunk FROM chunks WHERE path NOT IN (SELECT path FROM chunks WHERE path LIKE 'f2/%')")
def vector_delete_removed(spark, d):
    c = src.chunk_vectors(spark, d).select("path", "chunk")
    return N.only_listed(c, c.where("path not like 'f2/%'").select(F.col("path").alias("relpath")))


@query(f"WITH {_CHUNKS}, e AS (SELECT path, unnest(v) AS x, unnest(range(len(v))) AS i FROM chunks) SELECT path, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM e GROUP BY path, i")
def mean_vector(spark, d):
    return S.mean_vectors(src.chunk_vectors(spark, d)).select("path", F.posexplode("v").alias("i", "x")).select("path", "i", F.round("x", 6).alias("x"))


@query(f"WITH {_KNN} SELECT note, chunk, path, path_chunk, round(score, 6) AS score FROM near")
def knn_chunks(spark, d):
    return S.knn_chunks(src.chunk_vectors(spark, d)).select("note", "chunk", "path", "path_chunk", F.round("score", 6).alias("score"))


_RENEWED = """kept AS (SELECT path, chunk, CASE WHEN vec_id // 4 % 50 = 7 THEN list_reverse(v) ELSE v END AS v FROM (SELECT vec_id, 'f' || ((vec_id // 4) % 10) || '/n' || (vec_id // 4) AS path, CAST(vec_id % 4 AS INTEGER) AS chunk, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) WHERE vec_id // 4 % 50 <> 13)"""


@query(f"""WITH {_RENEWED} SELECT q.path AS note, q.chunk, c.path, c.chunk AS path_chunk, round(round(list_cosine_similarity(q.v, c.v), 9), 6) AS score FROM kept q, kept c
QUALIFY row_number() OVER (PARTITION BY q.path, q.chunk ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.path, c.chunk) <= 20""")
def renewed_neighbours(spark, d):
    # lists of the whole table, renewed after one note in fifty has changed and another is gone
    before = src.chunk_vectors(spark, d)
    number = F.regexp_extract("path", "([0-9]+)$", 1).cast("long") % 50
    after = before.where(number != 13).withColumn("v", F.when(number == 7, F.reverse("v")).otherwise(F.col("v")))
    changed = before.where(number.isin(7, 13)).select("path").distinct()
    found = S.renewed_neighbours(S.knn_chunks(before, 40), after, changed, k=20, spare=20)
    return found.rows.where("rank <= 20").select("note", "chunk", "path", "path_chunk", F.round("score", 6).alias("score"))


@query(f"""WITH {_CHUNKS}, e AS (SELECT path, unnest(v) AS x, unnest(range(len(v))) AS i FROM chunks), m AS (SELECT path, i, avg(x) AS x FROM e GROUP BY path, i), n AS (SELECT path, list(x ORDER BY i) AS v FROM m GROUP BY path),
near AS (SELECT q.path AS note, c.path, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM n q, n c QUALIFY row_number() OVER (PARTITION BY q.path ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.path) <= 10) SELECT note, path, score FROM near WHERE note <> path""")
def knn_notes(spark, d):
    means = S.mean_vectors(src.chunk_vectors(spark, d)).withColumn("chunk", F.lit(0))
    return S.knn_chunks(means, 10).where("note <> path").select("note", "path", F.round("score", 6).alias("score"))


@query(f"WITH {_RANKED} SELECT note, path, round(score, 6) AS score FROM best")
def best_score_per_note(spark, d):
    return S.candidates(S.knn_chunks(src.chunk_vectors(spark, d)), 0.15).select("note", "path", F.round("score", 6).alias("score"))


@query(f"WITH {_RANKED} SELECT note, path, CAST(r AS INTEGER) AS rank FROM ranked")
def rank_candidates(spark, d):
    return S.candidates(S.knn_chunks(src.chunk_vectors(spark, d)), 0.15).select("note", "path", "rank")


@query(f"WITH {_KNN} SELECT note, chunk, path, path_chunk FROM near WHERE score >= 0.2")
def candidate_score_filter(spark, d):
    return S.knn_chunks(src.chunk_vectors(spark, d)).where("score >= 0.2").select("note", "chunk", "path", "path_chunk")


@query(f"WITH {_RANKED} SELECT note, path FROM ranked WHERE path IN (SELECT path FROM chunks WHERE path LIKE 'f1/%' OR path LIKE 'f4/%')")
def allowed_semi(spark, d):
    c = src.chunk_vectors(spark, d)
    allowed = c.where("path like 'f1/%' or path like 'f4/%'").select("path").distinct()
    return S.among(S.candidates(S.knn_chunks(c), 0.15), allowed).select("note", "path")


def _links_sql(low: float, high: float) -> str:
    run = "OVER (PARTITION BY note ORDER BY r)"
    return f"""WITH {_RANKED}, a AS (SELECT *, r <= 4 AS core, least(count(*) OVER (PARTITION BY note), 4) AS n_core, split_part(note, '/', 1) <> split_part(path, '/', 1) AS far FROM ranked),
b AS (SELECT *, NOT core AND far AND sum(CAST(NOT core AND far AS INT)) {run} <= greatest(1, 6 - n_core) AS over FROM a),
c AS (SELECT *, sum(CAST(over AS INT)) OVER (PARTITION BY note) AS n_over, NOT core AND NOT over AS free, score BETWEEN {low} AND {high} AS band FROM b),
e AS (SELECT *, free AND band AND CASE WHEN 8 - n_core - n_over > 0 THEN sum(CAST(free AND band AS INT)) {run} <= 8 - n_core - n_over ELSE sum(CAST(free AS INT)) {run} = 1 END AS made FROM c),
f AS (SELECT *, sum(CAST(made AS INT)) OVER (PARTITION BY note) AS n_made, free AND NOT made AS rest FROM e),
g AS (SELECT *, rest AND sum(CAST(rest AS INT)) {run} <= 8 - n_core - n_over - n_made AS fill FROM f),
h AS (SELECT *, CASE WHEN core THEN 0 WHEN over THEN 1 WHEN made THEN 2 WHEN fill THEN 3 END AS k FROM g)
SELECT note, path, ['core', 'overreach', 'creative', 'fill'][k + 1] AS kind, CAST(row_number() OVER (PARTITION BY note ORDER BY k, r) AS INTEGER) AS pos FROM h WHERE k IS NOT NULL QUALIFY pos <= 8"""


@query(_links_sql(0.15, 0.25))
def select_links(spark, d):
    return S.select_links(S.candidates(S.knn_chunks(src.chunk_vectors(spark, d)), 0.15), low=0.15, high=0.25)


@query(f"WITH {_CHUNKS}, n AS (SELECT DISTINCT path FROM chunks), links AS (SELECT note, count(*) AS n FROM ({_links_sql(0.15, 0.25)}) GROUP BY note) SELECT '[related] ' || path || ' -> ' || coalesce(links.n, 0) || '/8' AS value FROM n LEFT JOIN links ON note = path")
def related_progress(spark, d):
    c = src.chunk_vectors(spark, d)
    links = S.select_links(S.candidates(S.knn_chunks(c), 0.15), low=0.15, high=0.25)
    each = links.groupBy("note").agg(F.collect_list("path").alias("related"))
    rows = c.select(F.col("path").alias("note")).distinct().join(each, "note", "left").select(F.col("note").alias("relpath"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))
    return run.progress_lines(rows, 8)


@query(_links_sql(0.20, 0.205))
def select_links_fill(spark, d):
    return S.select_links(S.candidates(S.knn_chunks(src.chunk_vectors(spark, d)), 0.15), low=0.20, high=0.205)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_score(spark, d):
    v = src.load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pair = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pair.select("vec_id", F.round(dot(F.col("v"), F.col("u")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("u"), F.col("u"))), 6).alias("score"))


def _tags(spark, d):
    return src.raw_tags(spark, d).select("note", T.normalize_tags(F.col("tags")).alias("tags"))


@query(f"WITH {_TAGS} SELECT note, array_to_string(tags, ',') AS tags FROM tags")
def normalize_tags(spark, d):
    return _tags(spark, d).select("note", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGS}, x AS (SELECT note, i, CASE WHEN tag = 'promo-brushed-tin' THEN 'promotion' WHEN tag = 'brand13' THEN 'brand' ELSE tag END AS tag FROM once WHERE note % 9 <> 0), y AS (SELECT note, tag, min(i) AS i FROM x GROUP BY ALL), z AS (SELECT note, string_agg(tag, ',' ORDER BY i) AS tags FROM y GROUP BY note) SELECT note, coalesce(z.tags, '') AS tags FROM raw LEFT JOIN z USING (note)")
def alias_map(spark, d):
    aliases = spark.createDataFrame([("promo-brushed-tin", "promotion"), ("brand13", "brand")], "alias string, canonical string")
    own = F.when(F.col("note") % 18 == 0, F.lit(None)).when(F.col("note") % 9 == 0, F.array().cast("array<string>")).otherwise(F.col("tags"))  # some notes have none
    return N.mapped_tags(_tags(spark, d).select("note", own.alias("tags")), aliases).select("note", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGS} SELECT tag, count(*) AS n FROM once GROUP BY tag")
def tag_frequency(spark, d):
    return N.tag_counts(_tags(spark, d))


@query(f"""WITH {_TAGS}, n AS (SELECT tag, count(*) AS n FROM once GROUP BY tag), k AS (SELECT o.note, list(o.tag ORDER BY o.i) FILTER (n.n >= 12) AS kept, list(o.tag ORDER BY o.i) AS every FROM once o JOIN n USING (tag) GROUP BY o.note)
SELECT note, array_to_string(CASE WHEN kept IS NULL OR len(kept) = 0 THEN every[1:1] ELSE kept END, ',') AS tags FROM k""")
def tag_frequency_filter(spark, d):
    return N.frequent_tags(_tags(spark, d), 12, 1).select("note", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGS} SELECT note, coalesce(string_agg(tag, ',' ORDER BY i), '') AS tags FROM (SELECT note, i, CASE WHEN len(tag) >= 2 AND len(string_split(tag, '-')) <= 2 THEN tag END AS tag FROM once) GROUP BY note")
def filter_tags(spark, d):
    return _tags(spark, d).select("note", F.array_join(T.allowed_tags(F.col("tags"), 2, 2), ",").alias("tags"))


@query(f"WITH {_TAGS} SELECT note, array_to_string(tags[1:2], ',') AS tags FROM tags")
def cap_tags(spark, d):
    return _tags(spark, d).select("note", F.array_join(F.slice("tags", 1, 2), ",").alias("tags"))


_PARTS = r"parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.,]')) AS raw, unnest(range(1, len(regexp_split_to_array(text, '[.,]')) + 1)) AS i FROM documents), p AS (SELECT doc_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS x FROM parts)"


@query(f"""WITH {_PARTS}, k AS (SELECT doc_id, i, lower(x) AS x FROM p WHERE x <> '' AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda z: z <> '')) <= 4),
o AS (SELECT doc_id, x, min(i) AS i FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o)
SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS concepts FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 4 GROUP BY d.doc_id""")
def normalize_concepts(spark, d):
    items = F.split("text", "[.,]")
    return src.load(spark, d, "documents").select("doc_id", F.array_join(T.normalize_concepts(items), "|").alias("concepts"))


@query(f"""WITH {_PARTS}, o AS (SELECT doc_id, lower(x) AS low, min_by(x, i) AS x, min(i) AS i FROM p GROUP BY doc_id, lower(x)) SELECT doc_id, string_agg(x, '|' ORDER BY i) AS items FROM o GROUP BY doc_id""")
def ordered_dedupe(spark, d):
    items = F.transform(F.split("text", "[.,]"), T.strip)
    return src.load(spark, d, "documents").select("doc_id", F.array_join(T.keep_first_ignoring_case(items), "|").alias("items"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ', ' || p_type, '[\\n,;]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part""")
def normalize_list_field(spark, d):
    return src.load(spark, d, "part").select("p_partkey", F.array_join(T.split_list_field(F.concat("p_name", F.lit(", "), "p_type")), "|").alias("items"))


@query("""WITH r AS (SELECT n_name || ':' || (n_nationkey % 3) AS name FROM nation), a AS (SELECT n_name || ':latest' AS name FROM nation WHERE n_nationkey % 4 <> 0)
SELECT name FROM r WHERE name NOT IN (SELECT name FROM a) AND split_part(name, ':', 1) NOT IN (SELECT split_part(name, ':', 1) FROM a)""")
def missing_models(spark, d):
    n = src.load(spark, d, "nation")
    required = n.select(F.concat("n_name", F.lit(":"), (F.col("n_nationkey") % 3).cast("string")).alias("name"))
    return N.missing_models(required, n.where("n_nationkey % 4 <> 0").select(F.concat("n_name", F.lit(":latest")).alias("name")))


_PENDING = f"{_NOTES}, {_STATE}, {_SCOPES}, pend AS (SELECT DISTINCT scope, n.relpath, n.mtime FROM notes n JOIN scopes ON folder = '.' OR starts_with(n.relpath, folder || '/') LEFT JOIN state s ON s.relpath = n.relpath WHERE sha1(n.body) IS DISTINCT FROM s.hash)"


def _pending(spark, d):
    n = src.notes(spark, d)
    changed = N.changed_notes(n, src.state(spark, d)).select("relpath", "mtime")
    return N.in_scopes(n, _scopes(spark)).join(changed, "relpath")


@query(f"WITH {_PENDING} SELECT scope, relpath, mtime FROM pend")
def pending_join(spark, d):
    return _pending(spark, d)


@query(f"WITH {_PENDING} SELECT count(*) FILTER (scope = 'current') AS current, count(*) FILTER (scope = 'all') AS every FROM pend")
def pending_totals(spark, d):
    return _pending(spark, d).agg(F.count_if(F.col("scope") == "current").alias("current"), F.count_if(F.col("scope") == "all").alias("every"))


@query(f"WITH {_PENDING} SELECT scope, relpath, mtime, CAST(row_number() OVER (PARTITION BY scope ORDER BY mtime DESC, relpath) AS INTEGER) AS pos FROM pend QUALIFY pos <= 5")
def pending_top_items(spark, d):
    return N.newest_pending(_pending(spark, d))


@query(f"WITH {_PENDING}, t AS (SELECT scope, count(*) AS total FROM pend GROUP BY scope), i AS (SELECT scope, relpath FROM pend QUALIFY row_number() OVER (PARTITION BY scope ORDER BY mtime DESC, relpath) <= 5) SELECT scope, total, string_agg(relpath, ',' ORDER BY relpath) AS items FROM t JOIN i USING (scope) GROUP BY scope, total")
def pending_snapshot(spark, d):
    return N.pending_snapshot(_pending(spark, d)).select("scope", "total", F.array_join(F.array_sort(F.transform("items", lambda x: x["relpath"])), ",").alias("items"))


@query(f"WITH {_NOTES}, {_STATE} SELECT s.relpath, s.hash FROM state s WHERE s.relpath IN (SELECT relpath FROM notes WHERE starts_with(relpath, 'src0/'))")
def entry_eviction(spark, d):
    listed = src.notes(spark, d).where(F.startswith("relpath", F.lit("src0/")))
    return N.only_listed(src.state(spark, d), listed, "relpath")


@query(f"WITH {_EVENTS} SELECT DISTINCT path FROM ev WHERE kind IN ('create', 'modify', 'delete', 'rename')")
def dirty_paths(spark, d):
    return P.dirty_paths(src.vault_events(spark, d))


@query(f"""WITH {_EVENTS}, g AS (SELECT ts, CASE WHEN ts < lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new, event_id FROM ev), s AS (SELECT ts, sum(new) OVER (ORDER BY ts, event_id) AS k FROM g)
SELECT epoch_us(min(ts)) // 1000 AS started_ms, (epoch_us(max(ts)) + 300000000) // 1000 AS fires_ms, count(*) AS n_events FROM s GROUP BY k""")
def debounce_sessions(spark, d):
    s = P.debounced(src.vault_events(spark, d), "300 seconds")
    return s.select(F.unix_millis("started").alias("started_ms"), F.unix_millis("fires").alias("fires_ms"), "n_events")


@query(f"""WITH {_NOTES}, known AS (SELECT relpath, CASE WHEN doc_id % 5 = 0 THEN mtime - 1 ELSE mtime END AS was FROM notes WHERE doc_id % 3 <> 0), dirty AS (SELECT relpath FROM notes WHERE doc_id % 13 = 0)
SELECT n.relpath FROM notes n LEFT JOIN known k USING (relpath) WHERE k.was IS DISTINCT FROM n.mtime OR n.relpath IN (SELECT relpath FROM dirty)""")
def incremental_rescan(spark, d):
    n = src.notes(spark, d)
    known = n.where("doc_id % 3 <> 0").select("relpath", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"))
    return P.rescan_needed(n.select("relpath", "mtime"), known, n.where("doc_id % 13 = 0").select(F.col("relpath").alias("path"))).select("relpath")


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"summary":"' || turn || '"}' WHEN 1 THEN 'Sure: {"summary":"x' || turn || '"} done' ELSE 'nothing' END AS c FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN 'x' || turn END AS summary FROM c""")
def json_salvage(spark, d):
    t = F.col("turn").cast("string")
    c = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"summary":"'), t, F.lit('"}'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('Sure: {"summary":"x'), t, F.lit('"} done'))).otherwise("nothing")
    return src.load(spark, d, "conversations").select("conv_id", "turn", F.get_json_object(T.salvaged_json(c), "$.summary").alias("summary"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'WRITE_TARGET_EMPTY' WHEN doc_id % 9 = 1 THEN 'WRITE_TARGET_TRAVERSAL' WHEN doc_id % 9 IN (2, 5) THEN 'WRITE_TARGET_OUTSIDE_VAULT' WHEN doc_id % 9 IN (3, 6) THEN 'WRITE_TARGET_NOT_MARKDOWN' ELSE 'OK' END AS code FROM documents")
def write_target_validation(spark, d):
    k, own = F.col("doc_id") % 9, F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    shapes = (F.lit(" "), F.concat(F.lit("../"), own, F.lit(".md")), F.concat(F.lit("/etc/"), own, F.lit(".md")), F.concat(own, F.lit(".txt")), F.concat(F.lit(" "), own, F.lit(".MD ")),
              F.concat(F.lit("/vault/a/../../"), own, F.lit(".md")), F.concat(own, F.lit("/.md")), F.concat(F.lit("/vault/b/../"), own, F.lit(".md")), F.concat(own, F.lit("/./x.md")))
    target = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    return src.load(spark, d, "documents").select("doc_id", T.target_code(target, "/vault").alias("code"))


@query(r"""SELECT p_partkey, regexp_replace(replace('/' || replace(p_name, ' ', chr(92)) || '//', chr(92), '/'), '^/+|/+$', '', 'g') AS folder FROM part""")
def normalize_folder(spark, d):
    path = F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("\\")), F.lit("//"))
    return src.load(spark, d, "part").select("p_partkey", T.normalize_folder(path).alias("folder"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_id * 1000 + CASE WHEN event_id % 9 < 3 THEN 5 ELSE greatest(5, CAST(floor(value + 0.5) AS BIGINT)) END * 60000 END AS next_ms FROM events""")
def schedule_next(spark, d):
    mode, k = F.when(F.col("event_type") == "view", "manual").otherwise("interval"), F.col("event_id") % 9
    minutes = F.when(k == 0, float("inf")).when(k == 1, float("nan")).when(k > 2, F.col("value"))  # or none
    return src.load(spark, d, "events").select("event_id", R.next_run(mode, minutes, F.col("event_id") * 1000).cast("long").alias("next_ms"))


@query(f"WITH {_EVENTS} SELECT event_id, kind FROM ev QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 50")
def recent_log(spark, d):
    return src.vault_events(spark, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "kind")


@query("""SELECT conv_id, max_by(text, turn) FILTER (role = 'assistant') AS last_err, coalesce(max_by(text, turn) FILTER (role = 'assistant'), max_by(text, turn)) AS context FROM conversations GROUP BY conv_id""")
def last_line(spark, d):
    own = F.expr("max_by(text, turn) filter (where role = 'assistant')")
    return src.load(spark, d, "conversations").groupBy("conv_id").agg(own.alias("last_err"), F.coalesce(own, F.max_by("text", "turn")).alias("context"))


@query("""SELECT conv_id, bool_and(turn % 7 <> 6) AS ok, coalesce(min_by(text, turn) FILTER (turn % 7 = 6), 'Preflight passed.') AS summary FROM conversations GROUP BY conv_id""")
def preflight_rollup(spark, d):
    checks = src.load(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.when(F.col("turn") % 7 == 6, "error").otherwise("ok").alias("status"), F.col("text").alias("message"))
    return rollup(checks, by=("conv_id",))


_ARGS = ", ".join(f"'{a}'" for a in R.RUN_ARGS)


@query(f"""WITH a AS (SELECT doc_id, list_filter(list_transform(range(3), lambda k: [{_ARGS}, '--x' || source, 'x', ''][1 + (doc_id * 7 + k * 5) % 14]), lambda x: x NOT IN ({_ARGS})) AS bad FROM documents) SELECT doc_id, array_to_string(bad, '|') AS refused FROM a WHERE len(bad) > 0""")
def args_allowlist(spark, d):
    every = F.array(*map(F.lit, R.RUN_ARGS), F.concat(F.lit("--x"), F.col("source")), F.lit("x"), F.lit(""))
    args = F.transform(F.array(*map(F.lit, range(3))), lambda k: F.element_at(every, (1 + (F.col("doc_id") * 7 + k * 5) % 14).cast("int")))
    bad = src.load(spark, d, "documents").select("doc_id", R.refused_args(args).alias("bad"))
    return bad.where(F.size("bad") > 0).select("doc_id", F.array_join("bad", "|").alias("refused"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN '\"' || p_name || '\"' ELSE p_name END || ' ' || p_brand AS line FROM part")
def command_preview(spark, d):
    return src.load(spark, d, "part").select("p_partkey", R.command_line(F.array("p_name", "p_brand")).alias("line"))


_MD = f"{_NOTES}, md AS (SELECT relpath, body, '---' || chr(10) || 'summary: old' || chr(10) || '---' || chr(10) || body AS text FROM notes)"


def _front(spark, d):
    return src.notes(spark, d).select("relpath", "body", F.concat(F.lit("---\nsummary: old\n---\n"), "body").alias("text"))


@query(f"WITH {_MD} SELECT relpath, sha1(body) AS hash, 3 AS closes FROM md")
def split_frontmatter(spark, d):
    return _front(spark, d).select("relpath", F.sha1(T.strip_frontmatter(F.col("text")).cast("binary")).alias("hash"), T.frontmatter_end(F.col("text")).alias("closes"))


@query(f"WITH {_NOTES} SELECT relpath, sha1(rtrim(body, chr(10))) AS hash FROM notes")
def strip_trailing_dividers(spark, d):
    return src.notes(spark, d).select("relpath", F.sha1(T.strip_trailing_dividers(F.concat("body", F.lit("\n---\n\n---\n"))).cast("binary")).alias("hash"))


@query(f"WITH {_NOTES} SELECT relpath, sha1(body || chr(10) || '> [!note] related work by others' || chr(10) || '> kept' || chr(10) || '# Next' || chr(10) || '#x' || chr(10) || 'last' || chr(10)) AS hash FROM notes")
def strip_related_section(spark, d):
    # a callout of the user's own that only begins like a generated one stays
    made = F.concat("body", F.lit(f"\n> [!note] related work by others\n> kept\n<!-- mindmap:START -->\n  ## related\n- [[a]]\n# Next\n## Links\ngone\n## Mindmap\ngone\n#x\n{T.CALLOUT}\n> - [[x]]\n> [!tip]- RELATED\n> y\nlast\n"))
    return src.notes(spark, d).select("relpath", F.sha1(T.strip_sections(made, ["## Links"]).cast("binary")).alias("hash"))


@query(_links_sql(0.15, 0.25).replace("SELECT note, path, ['core'", f"SELECT note, string_agg('> - <span class=\"{T.LINK_CLASS}' || kind || '\">[[' || path || '|' || split_part(path, '/', 2) || ']]</span>', chr(10) ORDER BY pos) AS block FROM (SELECT note, path, ['core'") + ") GROUP BY note")
def render_links(spark, d):
    links = select_links(spark, d).groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "kind"))), lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"))).alias("links"))
    kinds = F.transform("links", lambda x: F.struct(x["path"].alias("path"), F.when(x["kind"] != "core", x["kind"]).alias("kind")))  # core is what a link without a kind is
    return links.select("note", F.substr(T.render_links(kinds), F.lit(len(T.CALLOUT) + 2)).alias("block"))


def _preview_rows(spark, d):
    tags = _tags(spark, d)
    return tags.select(F.concat(F.lit("t/"), F.col("note").cast("string"), F.lit(".md")).alias("relpath"), F.element_at("tags", 1).alias("summary"), "tags", F.slice("tags", 1, 1).alias("concepts"), F.array().cast("array<string>").alias("related"))


_QUOTED = """array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ',')"""


@query(f"""WITH {_TAGS} SELECT '{{"path":"t/' || note || '.md","summary":"' || tags[1] || '","tags":[' || {_QUOTED} || '],"concepts":["' || tags[1] || '"],"related":[]}}' AS line FROM tags""")
def preview_write(spark, d):
    return batch.preview_lines(_preview_rows(spark, d)).select(F.col("value").alias("line"))


@query(f"WITH {_TAGS} SELECT 't/' || note || '.md' AS path, array_to_string(tags, ',') AS tags, tags[1] AS summary FROM tags")
def preview_read(spark, d):
    rows = _preview_rows(spark, d)
    lines = batch.preview_lines(rows).select(F.concat("relpath", F.lit("!")).alias("seq"), "value").union(rows.select("relpath", F.lit('{"path": "../x.md"}')).union(spark.createDataFrame([("a", "{broken"), ("b", "")], "seq string, value string")))
    codes = W.preview_codes(lines, rows.select("relpath", F.lit(True).alias("is_file")))
    return batch.preview_entries(lines, codes).select(F.col("relpath").alias("path"), F.array_join("updates.tags", ",").alias("tags"), "updates.summary")


@query()
def fuzzy_tag_join(spark, d):
    tags = _tags(spark, d).select(F.explode("tags").alias("tag"))
    controlled = [r.t for r in src.load(spark, d, "part").select(T.normalize_tag(F.col("p_type")).alias("t")).distinct().collect()]  # 150 types at any scale
    return fuzzy.nearest_tags(tags, controlled)


@query(f"""WITH {_NOTES}, l AS (SELECT doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 13 = 0 AS due, len(string_split(body, ' ')) >= 200 AS long FROM notes WHERE doc_id % 7 <> 0)
SELECT count(*) AS listed, count(*) FILTER (due) AS scanned, count(*) FILTER (due AND long) AS updated, count(*) FILTER (NOT due OR long) AS tracked, (SELECT count(*) FROM notes WHERE doc_id % 13 = 0) AS dirty_paths FROM l""")
def pending_metrics(spark, d):
    n = src.notes(spark, d)
    flags = F.startswith("relpath", F.lit("src0/")).alias("in_current"), F.lit(True).alias("in_all")
    listed = n.where("doc_id % 7 <> 0").select("relpath", "mtime", *flags)
    known = n.where("doc_id % 3 <> 0").select("relpath", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), *flags, F.sha1("body").alias("hash"))
    dirty = n.where("doc_id % 13 = 0").select(F.col("relpath").alias("path"))
    read = lambda due: due.join(n.select("relpath", F.sha1("body").alias("hash"), F.size(F.split("body", " ")).alias("words")), "relpath")
    return P.refresh_metrics(P.refreshed(known, listed, dirty, read, least_words=200), listed, dirty)


@query("""SELECT conv_id, turn, '[' || CASE WHEN turn % 2 = 0 THEN 'warn' ELSE 'error' END || '][T' || turn || '] ' || role || CASE WHEN turn % 3 = 0 THEN ' Guidance: retry' ELSE '' END || ' Context: conv=' || conv_id AS line FROM conversations""")
def diagnostic_line(spark, d):
    level = F.when(F.col("turn") % 2 == 0, "warn").otherwise("error")
    guidance = F.when(F.col("turn") % 3 == 0, "retry").when(F.col("turn") % 3 == 1, "")
    context = F.create_map(F.lit("conv"), F.col("conv_id").cast("string"))
    return src.load(spark, d, "conversations").select("conv_id", "turn", T.diagnostic_line(level, F.concat(F.lit("T"), F.col("turn").cast("string")), F.col("role"), context, guidance).alias("line"))
