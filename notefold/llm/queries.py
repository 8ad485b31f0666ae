"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.lm_scoring import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), with_ids=False, added=True)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=3, share=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.substring_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.chat import digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.whitening import whitening_rows

    return whitening_rows(table(spark, sf_dir, "embeddings"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notefold.llm.clustering import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (
    SELECT page_id, html, first, sha1(html) AS hex FROM p
)
SELECT page_id,
       CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       translate(array_to_string(list_transform(range(8), lambda k: lpad(to_base(CAST('0x' || substr(hex, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT), 32), 4, '0')), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP11_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
           regexp_replace(text, '([\[<]\\*)(/?INST\]|ROLE\]|TURN\]|/?s>)', '\1\\\2', 'g') AS written,
           regexp_replace(role, '([\[<]\\*)(/?INST\]|ROLE\]|TURN\]|/?s>)', '\1\\\2', 'g') AS written_role
    FROM rows
), b AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY place) IS DISTINCT FROM role AS opens FROM t
), g AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
           CAST(sum(length(written) + CASE WHEN NOT opens THEN 6 WHEN role = 'assistant' THEN 7 ELSE 19 + length(written_role) END) AS BIGINT) AS formatted_chars,
           count(*) FILTER (WHERE opens) AS n_blocks
    FROM b GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_blocks FROM g
"""

def _op13_sql(rounds: int = 10) -> str:
    """Rounds as a chain of tables: vectors and centroids a row a component."""
    tables = ["""WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(v) AS x FROM kept
), first AS (
    SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < 8
), c0 AS MATERIALIZED (SELECT cluster, unnest(range(64)) AS i, unnest(v) AS x FROM first"""]
    for k in range(rounds + 1):
        tables.append(f"""d{k} AS (SELECT r, cluster, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} c USING (i) GROUP BY r, cluster
), a{k} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(cluster, d * 100 + cluster) AS cluster FROM d{k} GROUP BY r""")
        if k < rounds:
            tables.append(f"""m{k} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM v JOIN a{k} USING (r) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (SELECT cluster, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN m{k} USING (cluster, i)""")
    tables.append(f"h AS (SELECT cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return "\n), ".join(tables) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (cluster)
"""


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_exact_dedup, op3_token_counts, op4_top_k, op6_bpe, op5_best_fit_packing, op7_substring_dedup, op8_warc, op9_quality, op10_near_dedup, op11_chat_formatting, op12_whitening, op13_clustering)}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op4_top_k": OP4_SQL, "op8_warc": OP8_SQL, "op11_chat_formatting": OP11_SQL, "op13_clustering": _op13_sql()}
