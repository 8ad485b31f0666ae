"""Substring dedup and every pipeline stage, on all rows of a small table, against plain loops."""

import bisect
import collections
import math
import re

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from notefold.llm.common import cut
from notefold.llm.quality import STATS, fit_quality, statistics
from notefold.llm.setsketch import mix
from notefold.llm.substring_dedup import GEAR, repeated_spans
from tests.conftest import SMALL

SPACE = b" \t\n\x0b\x0c\r"
GEARS = GEAR.tolist()
PASSAGE = " ".join(f"shared{k} words" for k in range(40))


def plain_chunks(text, average=24, longest=256):
    """(bytes, start, end) of each chunk, by the definition, byte by byte."""
    raw, place, out, at = [], [], [], 0
    source = (text or "").encode()
    for k, b in enumerate(source):
        if b in SPACE and k and source[k - 1] in SPACE:
            continue
        raw.append(32 if b in SPACE else b + 32 if 65 <= b <= 90 else b)
        place.append(k)
    place.append(len(source))
    hashes = [sum(GEARS[raw[j - i]] << i for i in range(min(16, j + 1))) & 0xFFFFFFFF for j in range(len(raw))]
    small = mix(np.array(hashes, np.uint64)) < np.uint64((1 << 64) // average)
    for j in range(len(raw)):
        if small[j] or j + 1 == len(raw) or j + 1 - at == longest:
            out.append(j + 1)
            at = j + 1
    starts = [j for j, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
    ends = sorted({starts[bisect.bisect_left(starts, e)] for e in out})
    return [(bytes(raw[a:b]), place[a], place[b]) for a, b in zip([0, *ends], ends)]


def plain_spans(rows, least=96):
    """(id, chunks, chunks in repeated runs, spans) for each row; ids are unique, none counts as the largest."""
    chunks = [(doc, plain_chunks(text)) for doc, text in rows]
    times = collections.Counter(c for _, own in chunks for c, _, _ in own)
    order = lambda doc: (doc is None, doc or 0)
    keeper = {}
    for doc, own in sorted(chunks, key=lambda x: order(x[0])):
        for k, (c, _, _) in enumerate(own):
            keeper.setdefault(c, (doc, k))
    out = []
    for doc, own in chunks:
        n, spans, k = 0, [], 0
        while k < len(own):
            run = k
            while run < len(own) and times[own[run][0]] > 1:
                run += 1
            if run > k and own[run - 1][2] - own[k][1] >= least:
                n += run - k
                a = k
                while a < run:
                    b = a
                    while b < run and keeper[own[b][0]] != (doc, b):
                        b += 1
                    if b > a and own[b - 1][2] - own[a][1] >= least:
                        spans.append((own[a][1], own[b - 1][2]))
                    a = b + 1
            k = run + 1
        out.append((doc, len(own), n, spans))
    return out


def without(text, spans):
    if not spans:
        return text
    raw, parts, at = text.encode(), [], 0
    for a, b in [*spans, (len(text.encode()),) * 2]:
        parts.append(raw[at:a])
        at = b
    return b" ".join(p for p in parts if p).decode()


def plain_near(rows, width=5, share=80):
    """Rows that stay: the smallest id of what links reach."""
    sets, top = {}, {d: d for d, _ in rows}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        for e, other in sets.items():
            if e != d and s and other and 100 * len(s & other) >= share * len(s | other):
                a, b = sorted((root(d), root(e)))
                top[b] = a
    return [(d, t) for d, t in rows if root(d) == d]


def least_bins(lengths, room=2048):
    """Sequences that best fit needs, longest first, one piece at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, n)
        left = (free.pop(k) if k < len(free) else room) - n
        bisect.insort(free, left)
    return len(free)


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def planted(spark):
    """All documents of the small table, then exact and near copies, shared passages, cases of other scripts, empty and null texts."""
    rows = pairs(spark.read.parquet(f"{SMALL}/documents.parquet"))
    texts = [t for _, t in rows]
    extra = [texts[3], texts[3].replace(" ", "\n\n"), texts[5] + " and one more", PASSAGE, "Intro. " + PASSAGE + " " + texts[7], texts[9] + "\n" + PASSAGE.upper() + " the end", "日本語 " * 90, "naïve " + "日本語 " * 90, "é" * 900, "x" + "é" * 900, "one " * 400, "", None, " \n"]
    return rows + [(10**6 + k, t) for k, t in enumerate(extra)]


def test_repeated_spans_against_plain_loops(spark, planted):
    rows = [*planted, (None, "lone " + PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_chunks, r.n_repeated, [tuple(s) for s in r.spans]) for r in repeated_spans(docs).collect()]
    want = plain_spans(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(bool(s) for *_, s in want) > 8


def test_pipeline_against_plain_loops(spark, planted):
    stages = dict(corpus_pipeline.STAGES)
    docs = cut(spark.createDataFrame(planted, "doc_id long, text string").repartition(5), "planted")
    own = {}

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stats = cut(statistics(docs), "statistics")
    model, x = fit_quality(stats, labels), stats.select("doc_id", *STATS).toPandas()
    good = {int(d) for d, s in zip(x["doc_id"], model.score(x[list(STATS)].to_numpy(float)), strict=True) if s >= 0.3}
    own["quality"] = [r for r in planted if r[0] in good]

    def check(name, docs, want):
        out = cut(stages[name](spark, docs, SMALL), name)
        assert pairs(out) == sorted(want, key=lambda r: r[0]), name
        return out

    docs = check("quality", docs, own["quality"])
    assert 0.3 * len(planted) < len(own["quality"]) < len(planted)
    docs = cut(docs.unionByName(spark.createDataFrame([r for r in planted if r[0] >= 10**6 and r[0] not in good and r[1]], "doc_id long, text string")), "with-planted")

    first = {}
    for d, t in pairs(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (d, t))
    docs = check("exact", docs, first.values())
    docs = check("near", docs, plain_near(pairs(docs)))
    rows = pairs(docs)
    left = [(d, without(t, s), s) for (d, t), (*_, s) in zip(rows, plain_spans(rows), strict=True)]
    docs = check("substrings", docs, [(d, t) for d, t, s in left if not s or t.encode().strip(SPACE)])
    assert any(s for *_, s in left)

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in pairs(docs)}
    pieces = collections.defaultdict(list)
    packed = stages["packing"](spark, docs, SMALL).collect()
    for r in sorted(packed, key=lambda r: r.piece):
        assert r.start == sum(len(p) for p in pieces[r.doc_id]) and r.piece == len(pieces[r.doc_id])
        pieces[r.doc_id].append(np.frombuffer(r.ids, "<u4").tolist())
    assert {d: sum(p, []) for d, p in pieces.items()} == ids
    assert all(len(p) == math.ceil(len(ids[d]) / 2048) and all(len(x) == 2048 for x in p[1:]) for d, p in pieces.items())
    ends = collections.defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) == least_bins([r.length for r in packed])
