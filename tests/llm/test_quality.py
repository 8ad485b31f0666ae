"""The quality classifier against plain loops: statistics, rules as columns, the lasso's conditions, what is learned from."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from notefold.llm.quality import STATS, Model, Rule, _lasso, fit, fit_quality, score_quality, statistics
from tests.conftest import SMALL

TEXTS = ["", " \n\t", "One two. Three, FOUR!\n\nfive | 66 é日\nOne two\nOne two", "a a a a a", "XYZ ABC x; ; - % end?\r\nnext\x0bline\x0c!", "word " * 200 + "\n" * 5 + "9", "  no ascii space  ", "é" * 300, "\x00 \x1f ~ `"]


def plain(text):
    """The statistics by their names, byte by byte."""
    raw = text.encode()
    n, words, own = len(raw), [], b""
    for c in [*raw, 32]:
        if c in b" \t\n\x0b\x0c\r":
            words += [own] if own else []
            own = b""
        else:
            own += bytes([c])
    out = dict.fromkeys(STATS, 0.0) | {"log_bytes": math.log(1 + n)}
    w = len(words)
    if not w:
        return out
    kinds = dict.fromkeys(("upper", "digit", "space", "wide", "stop", "mark", "symbol", "bang", "bar"), 0)
    symbol = lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".?,;:'\"()-!|"
    for c in raw:
        kinds["upper"] += 65 <= c <= 90
        kinds["digit"] += 48 <= c <= 57
        kinds["space"] += c == 32 or 9 <= c <= 13
        kinds["wide"] += c > 127
        kinds["stop"] += chr(c) in ".?"
        kinds["mark"] += chr(c) in ",;:'\"()-"
        kinds["symbol"] += symbol(c)
        kinds["bang"] += c == 33
        kinds["bar"] += c == 124
    count = lambda items: {x: items.count(x) for x in set(items)}
    pairs = [(words[k], words[k + 1]) for k in range(w - 1)]
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return out | {k: v / n for k, v in kinds.items()} | {
        "log_words": math.log(1 + w), "word_bytes": sum(len(x) for x in words) / w, "cased_words": sum(len(x) > 2 and x.isupper() for x in words) / w, "symbol_words": sum(symbol(x[-1]) for x in words) / w,
        "lone_symbols": sum(len(x) == 1 and x[0] < 128 and not chr(x[0]).isalnum() for x in words) / w, "window_distinct": sum(len(set(words[k : k + 64])) for k in range(0, w, 64)) / w,
        "top_word": max(count(words).values()) / w, "top_pair": max(count(pairs).values(), default=0) / w, "repeat_lines": 1 - len(set(lines)) / len(lines), "line_words": math.log(1 + w / len(lines)),
        "ended_lines": sum(x.strip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
    }


def test_statistics_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(TEXTS)] + [(-99, None), (None, "x y")], "doc_id long, text string")
    both = docs.unionByName(more)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = statistics(both).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert all(math.isclose(r[s], want[s], rel_tol=1e-12, abs_tol=1e-12) for s in STATS), (r.doc_id, [(s, r[s], want[s]) for s in STATS if not math.isclose(r[s], want[s], rel_tol=1e-12, abs_tol=1e-12)])


def test_rules_are_the_same_as_columns_and_loops(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((400, len(STATS))), 2)
    rules = tuple(Rule(tuple((STATS[int(f)], bool(rng.integers(2)), float(np.round(rng.random(), 2))) for f in rng.choice(len(STATS), int(rng.integers(1, 4)), replace=False)), float(rng.normal())) for _ in range(25))
    model = Model(0.3, rules)
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], "k int, " + ", ".join(f"{s} double" for s in STATS))
    got = {r.k: r.score for r in df.select("k", model.column().alias("score")).collect()}
    for k, row in enumerate(x):
        total = 0.3
        for r in rules:
            if all((row[STATS.index(name)] > bound) == above for name, above, bound in r.conditions):
                total += r.weight
        assert math.isclose(got[k], 1 / (1 + math.exp(-total)), rel_tol=1e-9) and math.isclose(model.score(x[k : k + 1])[0], got[k], rel_tol=1e-9)


def test_the_lasso_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 12)) < 0.4).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] - 0.2)))).astype(float)
    penalty = 0.02
    bias, w = _lasso(x, y, penalty, 3000)
    gradient = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / len(y)
    assert abs(np.mean(1 / (1 + np.exp(-(bias + x @ w))) - y)) < 1e-6
    for g, v in zip(gradient, w, strict=True):
        assert abs(g + penalty * np.sign(v)) < 1e-5 if v else abs(g) <= penalty + 1e-6
    assert w[0] > 0.5 and w[1] < -0.3 and (w == 0).sum() >= 6


def test_learned_from_named_rows_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    named = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    train = [d for d in named if d in texts and not held(d)]
    x = np.array([[plain(texts[d])[s] for s in STATS] for d in train])
    y = np.array([named[d] for d in train], float)
    model = fit_quality(statistics(docs), labels)
    order = {tuple(r): k for k, r in enumerate(x.tolist())}
    assert len(order) <= len(train) and all(r.weight for r in model.rules) and len(model.rules) > 3
    # flipping every label that must not be read changes nothing
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit_quality(statistics(docs), flipped) == model
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert all(got[d].held_out == held(d) and got[d].predicted == (got[d].score >= 0.3) for d in texts)
    scores = model.score(np.array([[plain(texts[d])[s] for s in STATS] for d in texts]))
    assert np.allclose([got[d].score for d in texts], scores, atol=1e-9)
    own = model.score(x)
    assert own[y == 1].mean() > own[y == 0].mean() + 0.3
    assert fit(x, np.ones(len(y))).rules == ()
