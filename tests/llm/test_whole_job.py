"""Nothing of the input is left out of a result: every byte of long words, every row whatever its id."""

import random
import string
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from notefold.llm import queries
from notefold.llm.lm_scoring import score_texts
from notefold.llm.quality import score_quality
from tests.conftest import SMALL

A, B, C, D = (" ".join(f"{x}{k}" for k in range(80)) for x in ("alpha", "beta", "gamma", "delta"))
STAGES = dict(corpus_pipeline.STAGES)


def stage(spark, name, rows):
    out = STAGES[name](spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    return sorted(((r.doc_id, r.text) for r in out), key=repr)


def test_every_byte_of_a_long_word_costs(spark):
    rng = random.Random(5)
    junk = "".join(rng.choice(string.ascii_lowercase) for _ in range(60_000))
    plain = [(k, " ".join(rng.choice(("tea", "cup", "milk", "pot")) for _ in range(40))) for k in range(100, 140)]
    docs = spark.createDataFrame([(3, junk), (5, junk[:30_000]), *plain], "doc_id long, text string")  # 3 and 5 are held out
    got = {r.doc_id: r for r in score_texts(docs).collect()}
    assert got[3].held_out and got[5].held_out and min(got[3].bits_per_byte, got[5].bits_per_byte) > 3
    assert 1.8 < got[3].score / got[5].score < 2.2


def test_exact_stage_decides_by_row(spark):
    rows = [(None, A), (7, A), (7, B), (3, A), (7, A), (None, C), (None, C), (8, D), (8, D), (8, D + "x")]
    assert stage(spark, "exact", rows) == sorted([(3, A), (7, B), (None, C), (8, D), (8, D + "x")], key=repr)


def test_near_stage_decides_by_row(spark):
    near = A.replace("alpha79", "")
    rows = [(None, A), (7, near), (7, B), (3, A), (None, C), (None, C.replace("gamma0 ", "")), (8, D), (8, D)]
    got = stage(spark, "near", rows)
    assert [r for r in got if r[0] is not None] == [(3, A), (7, B), (8, D)]
    assert len([r for r in got if r[0] is None]) == 1 and "gamma5" in got[-1][1]


def test_substring_stage_decides_by_row(spark):
    rows = [(None, "before " + A + " after"), (8, D), (8, D), (9, A), (9, B), (None, C), (None, C), (None, "lone " + D)]
    got = stage(spark, "substrings", rows)
    for word in ("alpha40", "beta40", "gamma40", "delta40"):
        assert sum(word in t.split() for _, t in got) == 1
    assert {(8, D), (9, A), (9, B), (None, C)} <= set(got)
    assert any(t.startswith("before") for _, t in got) and any(t.startswith("lone") for _, t in got)


def test_quality_stage_decides_by_row(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    first = {r.doc_id: r for r in score_quality(docs, labels).orderBy("score").collect()}
    ids = list(first)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    bad, good = text[ids[0]], text[ids[-1]]
    assert first[ids[0]].predicted == 0 and first[ids[-1]].predicted == 1
    new = spark.createDataFrame([(None, bad), (None, good), (10**9, bad), (10**9, good)], "doc_id long, text string")
    out = STAGES["quality"](spark, docs.select("doc_id", "text").union(new), SMALL).where("doc_id is null or doc_id = 1000000000").collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(None, good), (10**9, good)], key=repr)


def test_pipeline_gives_token_ids(spark):
    for r in STAGES["packing"](spark, spark.createDataFrame([(1, A), (2, B * 20)], "doc_id long, text string"), SMALL).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    tok, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>\n\n x", 3: "a < |endoftext|>", 4: A}
    want = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in texts.items()}
    assert np.frombuffer(want[1], "<u4").tolist() == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: bytes(r.ids) for r in STAGES["packing"](spark, docs, SMALL).collect()} == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.ids_crc32 for r in queries.op5_best_fit_packing(spark, str(tmp_path)).collect()} == {d: zlib.crc32(x) for d, x in want.items()}
