"""The language model against a plain one that goes bit by bit, and its scores under other partitions."""

import collections
import math
import random

import numpy as np
import pytest

from notefold.llm import context_mixing as C
from notefold.llm.lm_scoring import score_texts


def bits_of(code, word):
    return [int(b) for c in word + b"\n" for b in code.bit[code.start[c] : code.start[c] + code.length[c]]]


@pytest.fixture(scope="module")
def corpus():
    """Tokens as (previous, word, hash of the two before, training), and a speller fitted on the training words."""
    rng = random.Random(7)
    words = [b""] + [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))).encode() for _ in range(120)] + ["é日".encode(), b"x" * 90]
    tokens = []
    for d in range(60):
        text = [rng.choice(words[1 : 1 + rng.choice((5, 122))]) for _ in range(rng.randint(0, 40))]
        for _ in range(2 if d % 7 == 0 else 1):
            own = [words.index(w) for w in text] + [0]
            for k, w in enumerate(own):
                last, second = (own[k - 1] if k else 0), (own[k - 2] if k > 1 else 0)
                tokens.append((last, w, second * 1000 + last, d % 5 != 1))
    count = collections.Counter(w for _, w, _, train in tokens if train)
    seen = sorted(count)
    byte = collections.Counter()
    for k, n in count.items():
        for c in words[k] + b"\n":
            byte[c] += n
    speller = C.Speller(C.Code(byte), 16)
    tables = speller.empty()
    own, n = [words[k] for k in seen], np.array([count[k] for k in seen])
    speller.count(tables, own, n, np.ones(len(n), bool))
    speller.freeze(tables)
    speller.learn(own, n)
    speller.levels = C._refined(speller.gated.hits)
    return words, tokens, speller


def plain(words, tokens, speller):
    """The mixed model with dictionaries for counts and a loop for every bit."""
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(2)]
    for last, w, before, train in tokens:
        if train:
            path = bits_of(speller.code, words[w])
            for t, b in enumerate(path[:64]):
                counts[0][last, tuple(path[:t])][b] += 1
                counts[1][last, before, tuple(path[:t])][b] += 1
    times = collections.Counter(tokens)
    rows = {}
    for last, w, before, train in times:
        logit, logs, _ = speller.spell([words[w]], np.array([int(train)]))
        rows[last, w, before, train] = {"path": bits_of(speller.code, words[w]), "logit": logit.tolist(), "logs": logs.tolist(), "p": 0.0}

    def klass(z, o):
        n = z + o
        if min(z, o):
            return 5 if n >= 8 else 4
        return 3 if n >= 4 else min(n, 2)

    weights, step = [[0.6, 0.5, 0.7] for _ in range(36)], [[1e-3] * 3 for _ in range(36)]
    hits = [[[0.0, 0.0] for _ in range(33)] for _ in range(36)]
    level = lambda g, k: (hits[g][k][1] + 8 / (1 + math.exp(12 - k * 24 / 32))) / (sum(hits[g][k]) + 8)
    live = set(rows)
    for t in range(64):
        both, one = [], []
        for key in list(live):
            last, w, before, train = key
            r, path = rows[key], rows[key]["path"]
            found = []
            for table, at in zip(counts, ((last, tuple(path[:t])), (last, before, tuple(path[:t]))), strict=True):
                n = list(table[at])
                if train:
                    n[path[t]] -= 1
                found.append([max(x, 0) for x in n])
            if sum(found[1]):
                both.append((key, found))
            elif sum(found[0]):
                one.append((key, found))
            else:
                r["p"] += sum(r["logs"][t:])
                live.discard(key)
        for group, inputs in ((both, 3), (one, 2)):
            told = []
            for key, found in group:
                r = rows[key]
                g = klass(*found[0]) * 6 + klass(*found[1])
                x = [r["logit"][t]] + [math.log((o + 0.3) / (z + 0.3)) for z, o in found][: inputs - 1]
                mixed = min(12.0, max(-12.0, sum(a * b for a, b in zip(weights[g], x, strict=False))))
                at = (mixed + 12) * 32 / 24
                low = min(int(at), 31)
                q = 1 / (1 + math.exp(-mixed))
                p = min(1 - 1e-6, max(1e-6, (q + level(g, low) * (1 - at + low) + level(g, low + 1) * (at - low)) / 2))
                b = r["path"][t]
                r["p"] += math.log(p if b else 1 - p)
                told.append((g, x, q, low + (at - low > 0.5), b, times[key] if key[3] else 0))
            slope, n = [[0.0] * 3 for _ in range(36)], [0.0] * 36
            for g, x, q, k, b, m in told:
                hits[g][k][b] += m
                n[g] += m
                for j, v in enumerate(x):
                    slope[g][j] += m * (b - q) * v
            for g in range(36):
                for j in range(inputs):
                    s = slope[g][j] / max(n[g], 1)
                    step[g][j] += s * s
                    weights[g][j] += 0.05 * s / math.sqrt(step[g][j])
        live = {k for k in live if len(rows[k]["path"]) > t + 1}
    for key in live:
        rows[key]["p"] += sum(rows[key]["logs"][64:])
    return np.array([rows[k]["p"] for k in tokens])


def test_mixing_equals_a_plain_model(corpus):
    words, tokens, speller = corpus
    last, word, before, train = (np.array(x) for x in zip(*tokens, strict=True))
    want = plain(words, tokens, speller)
    order = np.random.default_rng(1).permutation(len(tokens))  # in any order
    got = C.score_tokens(words, last[order], word[order], before[order].astype(np.uint32), train[order], speller)
    assert np.allclose(got, want[order], atol=5e-3) and (got < 0).all()


def test_code_is_a_code(corpus):
    _, _, speller = corpus
    code = speller.code
    assert math.isclose(sum(2.0 ** -int(n) for n in code.length if n), 1) and [s for s in range(256) if not code.length[s]] == [9, 11, 12, 13, 32]
    for w in (b"", b"abc", b"x" * 90, b"\x00\xff"):
        path = bits_of(code, w)
        head, n = code.heads([b"q", w])
        assert n[1] == len(path) and int(head[1]) == int("".join(map(str, path[:64])).ljust(64, "0"), 2)


def test_probabilities_of_all_words_add_up_to_one(corpus):
    """A bit and its other value share one: over the tree of words, what words up to a length leave is what longer ones have."""
    _, _, speller = corpus
    code = speller.code
    logit, logs, _ = speller.spell([b"ab"], np.array([0]))
    for t, b in enumerate(bits_of(code, b"ab")):
        p = math.exp(logs[t])
        assert 0 < p < 1 and (logit[t] == 0 or abs(p - 1 / (1 + math.exp(-logit[t] if b else logit[t]))) < 0.6)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice((3, 300))]) for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(400, "w1 " * 3000), (401, "w1 " * 3000)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = score_texts(docs.repartition(parts), bucket=2000).collect()
            found.append({r.doc_id: (r.score, r.base_score, r.n_known) for r in got})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0].keys() == found[1].keys() == dict(rows).keys()
    assert all(np.allclose(found[0][k], found[1][k], rtol=1e-6) for k in found[0])


def test_beats_the_base_on_held_out_rows(spark):
    got = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > 0.9 * got[1] > got[1]


def test_a_text_that_occurs_again_is_told_apart(spark):
    rng = random.Random(2)
    words = [f"term{k}" for k in range(4000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(400)]
    twice = [(1000 + k, t) for k, t in rows[:40]]
    got = {r.doc_id: r.bits_per_byte for r in score_texts(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()}
    again, once = [got[k] for k, _ in twice], [got[k] for k, _ in rows[40:]]
    assert np.median(again) < 0.6 * np.median(once)


def test_scores_do_not_depend_on_the_size_of_buckets(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice((2, 20, 400))]) for _ in range(60))) for k in range(300)] + [(None, "w1 w2 " * 200), (None, "w1 w2 " * 200)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string"), []
    for bucket in (100, 1 << 20):  # at 100 tokens a bucket every word is more than an eighth of one
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.score, r.base_score, r.n_known) for r in score_texts(docs.repartition(3), bucket=bucket).collect()))
    assert np.allclose(found[0], found[1], rtol=0, atol=1e-4) and len(found[0]) == len(rows)


def test_a_bit_that_groups_share_is_predicted_once(corpus, monkeypatch):
    """Groups by context, first bits and whether they are left out; words that differ only after 64 bits are among them."""
    words, tokens, speller = corpus
    words = [*words, b"x" * 91, b"x" * 90 + b"y"]
    tokens = [*tokens, *((0, w, 0, d % 2 == 0) for d in range(5) for w in (len(words) - 1, len(words) - 2, 121))]
    counts, groups = collections.Counter(), set()
    paths = [bits_of(speller.code, w) for w in words]
    for last, w, before, train in tokens:
        for t in range(min(64, len(paths[w])) * train):
            counts[last, *paths[w][:t]] += 1
            counts[(last, before), *paths[w][:t]] += 1
    for last, w, before, train in tokens:
        for t in range(len(paths[w])):
            groups.add(("word", train, *paths[w][: t + 1]) if t < 64 else ("word", train, w, t))  # of the speller, and of the longest context that says something
            says = [c for c in ((last, before), last) if counts[c, *paths[w][:t]] > train]
            groups |= {(c, train, *paths[w][: t + 1]) for c in says[:1]}
    predicted, of = [], C._probability
    monkeypatch.setattr(C, "_probability", lambda logit, *more: predicted.append(len(logit)) or of(logit, *more))
    last, word, before, train = (np.array(x) for x in zip(*tokens, strict=True))
    got = C.score_tokens(words, last, word, before.astype(np.uint32), train, speller)
    assert sum(predicted) <= len(groups)
    assert np.allclose(got, plain(words, tokens, speller), atol=5e-3)
