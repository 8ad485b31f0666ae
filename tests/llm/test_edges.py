"""Rows that are hard on operators, and every pipeline stage on them: nulls, repeats, empty tables, clashing names."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from notefold.llm.components import components
from notefold.llm.exact_dedup import exact_groups, one_of_each
from notefold.llm.near_dedup import near_groups
from notefold.llm.packing import pack
from notefold.llm.quality import score_quality
from notefold.llm.setsketch import Words, jaccard, shingles, sketch
from notefold.llm.substring_dedup import boundaries, cut_repeats_of_rows
from notefold.llm.topk import top_k
from notefold.llm.warc import archive_round_trip
from tests.conftest import SMALL

LONG = " ".join(f"term{k}" for k in range(80))
HARD = [(1, LONG), (2, LONG), (2, None), (3, ""), (None, LONG), (None, None), (4, LONG.replace("term9 ", "")), (5, "é" * 5000), (5, "é" * 5000), (6, "\x00 ퟿ \U0001f600")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, hub long, `a b` string, __y int"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, None, None, None, 1, 2, "x", 3) for r in HARD], SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, hard, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, hard, SMALL)
    rows = out.count()
    none = stage(spark, hard.where(F.lit(False)), SMALL)
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        assert rows >= len(HARD)
    else:
        assert out.columns == hard.columns and 0 < rows <= len(HARD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "packing"])
def test_stages_take_any_column_names(spark, name):
    rows = [(k, f"{LONG} {k % 2}", 1, 2, 3, 4, 5, 6, 7) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row int, __PATH int, __at int, `__spans` int, __text int, `__gone` int, `x.y` int")
    out = dict(corpus_pipeline.STAGES)[name](spark, df, SMALL)
    assert out.columns == df.columns and all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6, 7) for r in out.collect())


def test_chunks_end_between_characters(spark):
    rng = np.random.default_rng(3)
    for text in ("日本語" * 400, "é" * 3000, "".join(chr(int(c)) for c in rng.choice([0x41, 0xE9, 0x65E5, 0x1F600], 4000))):
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = boundaries(raw, 24, 256)
        assert ends[-1] == len(raw) and not any((raw[e] & 0xC0) == 0x80 for e in ends[:-1]) and np.diff(np.r_[0, ends]).max() < 260
    passage = "".join(chr(int(c)) for c in rng.choice(np.arange(0x4E00, 0x9000), 300))
    left = {r.doc_id: r.text for r in cut_repeats_of_rows(spark.createDataFrame([(1, passage), (2, f"前{passage}後")], "doc_id long, text string")).collect()}
    assert left[1] == passage and "\ufffd" not in left[2] and len(left[2]) < 60 and left[2][0] == "前" and left[2][-1] == "後"


def test_pack_repeats_and_nulls(hard):
    rows = pack(hard, P.path("byte_bpe_50k.json")).collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5 and r.piece == 0 for r in rows) == 2
    assert [(r.length, r.start) for r in rows if r.doc_id == 3] == [(1, 0)]


def test_top_k_hard_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [9.0, 9.0], 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [float("inf"), 0.0], 1), (4, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {0} and not {None, 3} & {r.vec_id for r in got}
    best = sorted((r["rank"], r.vec_id) for r in got)[0][1]
    assert best == 4
    assert top_k(df.where(F.lit(False)), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_top_k_of_empty_and_zero_vectors(spark, parts):
    rows = [(100, [0.5]), (1, []), (2, [0.0, 0.0]), (3, [-1.0, 4.0]), (200, []), (4, [1.0, 1.0, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    whole = {i: [int(np.floor(1024 * x)) for x in [*v, 0.0, 0.0, 0.0][:3]] for i, v in rows}
    for some in (rows, [r for r in rows if not any(r[1])]):
        ids = {r[0] for r in some}
        want = sorted((q, i, sum(a * b for a, b in zip(whole[q], whole[i], strict=True))) for q in ids & {100, 200} for i in ids - {q})
        got = top_k(df.where(F.col("vec_id").isin(*ids)), F.col("vec_id") % 100 == 0, block=2).collect()
        assert sorted((r.query_id, r.vec_id, r.score) for r in got) == want
        assert all(r["rank"] == 1 + sum((-s, i) < (-r.score, r.vec_id) for q, i, s in want if q == r.query_id) for r in got)


def test_exact_dedup_of_the_largest_id(spark):
    top = (1 << 63) - 1
    rows = [(top, "a b"), (None, "a  b"), (None, "c"), (None, "c"), (top, "d"), (-top - 1, "d"), (5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect()), key=repr)
    assert got == sorted([(top, top, 2, True), (None, top, 2, False), (None, None, 2, True), (None, None, 2, True), (top, -top - 1, 2, False), (-top - 1, -top - 1, 2, True), (5, 5, 1, True)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in one_of_each(df).collect()), key=repr) == sorted([(top, "a b"), (None, "c"), (-top - 1, "d"), (5, "e")], key=repr)


def test_warc_repeats_and_nulls(spark):
    rows = [(3, None, None), (1, "u", "p"), (1, "u", "p"), (2, "\r\nx: y", "p"), (4, "é", "é" * 70_000)]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    again = [(1, "u", "A"), (2, "u", "A"), (2, "u", "B"), (5, "u", "B"), (3, "u", "C"), (3, "u", "A")]
    back = archive_round_trip(spark.createDataFrame(again, "page_id long, url string, html string")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "A", "response", None), (2, "A", "revisit", 1), (2, "B", "response", None), (5, "B", "revisit", 2), (3, "C", "response", None), (3, "A", "revisit", 1)]
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == sorted(((i, digest(t), k, f) for i, t, k, f in want), key=repr)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (2, 3, 4)} == {(2, "revisit", 1), (3, "response", None), (4, "response", None)}
    assert {r.payload_digest for r in got if r.page_id == 4} == {base64.b32encode(hashlib.sha1("é".encode() * 70_000).digest()).decode()}


def test_quality_labels_that_do_not_count(spark, hard):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    got = score_quality(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)


def test_sketches_merge_and_estimate():
    words, rng = Words(), np.random.default_rng(4)
    a, b = (shingles(" ".join(f"w{x}" for x in rng.integers(0, 50, n)), 3, words) for n in (400, 900))
    both = np.unique(np.concatenate([a, b]))
    assert (sketch(both) == np.maximum(sketch(a), sketch(b))).all()
    off = []
    for share in (0.5, 0.8, 0.95):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            k = int(1000 * 2 * share / (1 + share))
            y = np.concatenate([x[:k], rng.integers(0, 1 << 63, 1000 - k).astype(np.uint64)])
            u, v = (sketch(np.unique(s)) for s in (x, y))
            off.append(jaccard(np.array([(u > v).sum()]), np.array([(u < v).sum()]), np.array([(u == v).sum()]), np.array([1000]), np.array([1000]))[0] - k / (2000 - k))
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 0.2


def test_components_of_long_chains(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and got[1000] == got[1001] == 1000
    assert components(links.where(F.lit(False))).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(120)]
    rows = [(k, " ".join(base[: int(rng.integers(110, 121))])) for k in range(700)] + [(9000 + k, " ".join(f"o{k}x{j}" for j in range(30))) for k in range(50)]
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(700)} == {0} and all(got[9000 + k] == 9000 + k for k in range(50))
