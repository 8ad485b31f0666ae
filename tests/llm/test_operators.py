"""The ten operators against brute force: ties, nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from notefold.llm import queries
from notefold.llm.bpe import decode, encode, encoder, merged, round_trip
from notefold.llm.exact_dedup import exact_groups
from notefold.llm.lm_scoring import score_texts
from notefold.llm.near_dedup import near_groups
from notefold.llm.packing import pack, plan
from notefold.llm.quality import score_quality
from notefold.llm.substring_dedup import cut_repeats_of_rows, repeated_spans
from notefold.llm.token_counts import MARK, Trie, pieces, token_counts
from notefold.llm.topk import top_k
from notefold.llm.warc import MAGIC, archive_round_trip
from tests.conftest import SMALL

BASE = " ".join(f"word{k} of" for k in range(60))
TEXTS = [
    (1, "a b c"), (2, "a \t b\n\nc"), (3, None), (4, ""), (5, " \n"), (6, BASE), (7, BASE.replace("word7 ", "other ")), (8, BASE + " end"), (9, "x" * 70_000), (10, "One two " * 3000),
    (11, "one TWO " * 3000), (12, "É été naïve 日本 " * 9), (12, "É été naïve 日本 " * 9), (13, "intro " + BASE + " outro tail"), (14, "<|endoftext|> it's  100% \x00ok"),
]
NAMES = "doc_id long, text string, keep_id long, n int, sha string, component string, batch int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "s", "c", 3, "x") for r in TEXTS] + [(None, "no id", 1, 2, "s", "c", 3, "x")], NAMES)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(docs).collect()}
    for d, t in TEXTS:
        r = got[d, hashlib.sha256(norm(t).encode()).hexdigest()]
        same = [x for x, y in TEXTS if norm(y) == norm(t)]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), min(same) == d)
    assert exact_groups(docs).count() == len(TEXTS) + 1


def components(rows, width, share):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return sets, comp


@pytest.mark.parametrize(("width", "share"), [(3, 85), (5, 80)])
def test_near(docs, width, share):
    sets, comp = components(TEXTS, width, share)
    for r in near_groups(docs, width, share).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and not r.kept


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = pack(docs, P.path("byte_bpe_50k.json")).collect()
    own = collections.defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 8192
    for d, t in TEXTS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(own[d], key=lambda r: r.piece)[:: 2 if d == 12 else 1]
        assert b"".join(r.ids for r in got) == np.array(ids, "<u4").tobytes()
        assert all(r.length == 2048 for r in got[1:]) and got[0].start == 0
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for places in seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    n = collections.Counter(rng.integers(1, 2049, 20_000).tolist())
    slots = plan(n, 2048)
    assert sum(n.values()) == sum(n[k] for k in {int(s[0]) for s in slots})
    used = 1 + max(int(s[2] + (((n[int(s[0])] if i + 1 == len(slots) or slots[i + 1][0] != s[0] else slots[i + 1][1]) - s[1] - 1) // s[3])) for i, s in enumerate(slots))
    assert used <= 1.01 * sum(k * v for k, v in n.items()) / 2048 + 1


def test_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = encoder(path)
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    for r in round_trip(docs, path).collect():
        if r.doc_id is not None:
            t = dict(TEXTS)[r.doc_id] or ""
            ids = lib.encode_ordinary(t)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(own.whole.key) == sorted(own.rank)
    assert merged(b"zqzqzq", own.rank) == lib.encode_ordinary("zqzqzq")
    back = {r.doc_id: bytes(r.text) for r in decode(encode(docs, path), path).collect()}
    assert back[12] == dict(TEXTS)[12].encode()


def test_token_counts(docs):
    score = pieces(P.path("piece_bpe_32k.model"))
    t = Trie(score)

    def brute(word):
        s = MARK + word.decode()
        best = [(0.0, 0)]
        for i in range(1, len(s) + 1):
            c = []
            for j in range(max(0, i - 40), i):
                if s[j:i] in score:
                    c.append((best[j][0] + score[s[j:i]], best[j][1] - 1))
                elif i - j == 1:
                    c.append((best[j][0] + t.unknown, best[j][1] - len(s[j:i].encode())))
            best.append(max(c))
        return -best[-1][1], best[-1][0]

    for r in token_counts(docs, P.path("piece_bpe_32k.model")).collect():
        if r.doc_id is not None and r.doc_id != 9:
            w = (dict(TEXTS)[r.doc_id] or "").encode().split()
            each = [brute(x) for x in w]
            assert (r.n_words, r.n_tokens) == (len(w), sum(x for x, _ in each)) and math.isclose(r.score, sum(x for _, x in each), rel_tol=1e-12)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=8) * (1 + k % 3)], "q", 1.0) for k in range(260)] + [(300, [1.0] * 8, "q", 1.0), (400, [1.0] * 8, "q", 1.0), (501, None, "q", 1.0), (600, [float("nan")] * 8, "q", 1.0), (700, [1.0, None], "q", 1.0), (800, [2.0, 1.0], "q", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string, norm double")
    ok = {k: np.array([math.floor(1024 * x) for x in v] + [0] * (8 - len(v))) for k, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    got = collections.defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = {q: [(s, c) for s, c in sorted(((int(ok[q] @ v), c) for c, v in ok.items() if c != q), key=lambda x: (-x[0], x[1]))[:10]] for q in ok if q % 100 == 0}
    assert got == want
    assert top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


def test_substrings(docs):
    got = {}
    for r in repeated_spans(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[13].spans and got[7].spans and not got[6].spans  # the first copy keeps the passage
    assert got[3].n_chunks == got[4].n_chunks == 0 and not got[1].spans
    assert [(s.start, s.end) for s in got[9].spans] == [(256, 69_888)]  # equal letters: all full chunks but the first
    left = {r.doc_id: r.text for r in cut_repeats_of_rows(docs).collect()}
    assert left[13].startswith("intro") and len(left[13]) < len(BASE) / 2 and left[6] == BASE
    assert cut_repeats_of_rows(docs).columns == docs.columns


def test_warc(spark):
    fake = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcdef\r\n\r\n"
    rows = [(1, "u", "a"), (2, None, None), (3, "u\r\nx", ""), (4, "u", "a"), (5, "u", MAGIC + "x" + MAGIC * 2), (6, "u", fake), (7, "u", "z" * 300 + fake * 5), (8, "u", fake)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, head string, first int").coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.page_id: tuple(r)[1:] for r in archive_round_trip(df).collect()}
            for i, _, h in rows:
                raw, first = (h or "").encode(), min(a for a, _, c in rows if (c or "") == (h or ""))
                assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    r = queries.QUERIES["op9_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(x.quality == x.predicted for x in r) >= 0.95 * len(r)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}


def test_lm(docs):
    tok = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in TEXTS}
    train = [d for d, _ in TEXTS if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(w for d in train for w in tok[d]) + collections.Counter([b"no", b"id", b"\n"])
    n, v = sum(c.values()), len(c)
    for r in score_texts(docs).collect():
        if r.doc_id is None:
            continue
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok[r.doc_id])
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tok[r.doc_id]), sum(c[w] > 0 for w in tok[r.doc_id]), n, r.doc_id not in train)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (exact_groups(empty), near_groups(empty), pack(empty, P.path("byte_bpe_50k.json")), round_trip(empty, P.path("byte_bpe_multi_50k.tiktoken")), token_counts(empty, P.path("piece_bpe_32k.model")), repeated_spans(empty), score_quality(empty, labels), score_texts(empty)):
        assert out.count() == 0
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    ids = {r.doc_id for r in rows}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: norm(r.text) for r in docs}
    assert len({text[i] for i in ids}) == len(ids) and len(ids) > 0.6 * len(docs)
