"""Quality classifier: a sparse ensemble of rules over statistics of the text.

1. `statistics` measures every whole text.
2. Shallow trees are boosted on a bounded sample of labelled rows; every path
   from a root is a rule, a conjunction of up to `depth` conditions.
3. A logistic regression with an L1 penalty weighs the rules; most weights
   become zero.
4. The rules that are left compile into one Spark column expression, so scoring
   is a projection inside generated code.

Only the text is an input: never labels, lang, source or the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notefold.llm.common import cut, id_remainder, lean, small_batches, texts, with_rows

STATS = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "wide", "stop", "mark", "symbol", "bang", "bar", "cased_words", "symbol_words", "lone_symbols", "window_distinct", "top_word", "top_pair", "repeat_lines", "line_words", "ended_lines"]
#: Labelled rows that the fit reads at most (those of smallest hash), whatever the corpus.
SAMPLE = 40_000
_WINDOW = 64
_UPPER, _DIGIT, _SPACE = range(65, 91), range(48, 58), (32, *range(9, 14))
_STOP, _MARK = b".?", b",;:'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP + _MARK + b"!|")


def measures(text: str) -> list[float]:
    """The statistics of one text, in the order of STATS; an empty text has zeros."""
    raw = text.encode()
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [np.log1p(n)] + [0.0] * (len(STATS) - 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda of: float(byte[list(of)].sum()) / n
    size = sum(map(len, words))
    cased = sum(1 for x in words if len(x) > 2 and x.isupper())
    symbol = sum(1 for x in words if x[-1] in _SYMBOL)
    lone = sum(1 for x in words if len(x) == 1 and x[0] < 128 and not x.isalnum())
    distinct = sum(len(set(words[i : i + _WINDOW])) for i in range(0, w, _WINDOW)) / w
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(w), size / w, share(_UPPER), share(_DIGIT), share(_SPACE), float(byte[128:].sum()) / n, share(_STOP), share(_MARK), share(_SYMBOL), share(b"!"), share(b"|"),
        cased / w, symbol / w, lone / w, distinct, max(Counter(words).values()) / w, max(pairs.values(), default=0) / w,
        1 - len(set(lines)) / len(lines), np.log1p(w / len(lines)), sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")) / len(lines),
    ]


@lean
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([measures(x) for x in b["text"].to_pylist()], float).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every row of docs; zeros, or the length alone, for a text that is null, empty or without words. Ids may repeat or be null."""
    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, bound): the statistic is over the bound, or (above False) is not."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.conditions:
            out &= (x[:, STATS.index(name)] > bound) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, bound in self.conditions:
            out = out & (F.col(name) > bound if above else F.col(name) <= bound)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum(r.weight * r.holds(x) for r in self.rules))))

    def column(self) -> Column:
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(), r.weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for col in x.T]


def _grow(code, edges, grad, hess, rows, depth, path, rules) -> list[tuple[np.ndarray, float]]:
    """Grow one tree by second-order gain; every node below the root is a rule. Returns the leaves."""
    g, h = grad[rows], hess[rows]
    value = -g.sum() / (h.sum() + 1)
    best = (1e-3, None, None)
    if depth and len(rows) >= 40:
        for f in range(code.shape[1]):
            k = len(edges[f]) + 1
            if k == 1:
                continue
            gl, hl, nl = (np.cumsum(np.bincount(code[rows, f], w, k))[:-1] for w in (g, h, np.ones(len(rows))))
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(nl < 10) | (len(rows) - nl < 10)] = 0
            if gain.max(initial=0) > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        return [(rows, value)]
    _, f, cut_at = best
    leaves = []
    for above in (False, True):
        own = (*path, (STATS[f], above, float(edges[f][cut_at])))
        rules.append(own)
        leaves += _grow(code, edges, grad, hess, rows[(code[rows, f] > cut_at) == above], depth - 1, own, rules)
    return leaves


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias is free."""
    x = np.hstack([np.ones((len(x), 1)), x])
    lip = np.linalg.norm(x, 2) ** 2 / 4 / len(x) + 1e-9
    w = z = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - x.T @ (p - y) / len(x) / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lip, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> Model:
    """Rules from boosted trees over x (columns as STATS), weighed by the lasso. One class, or no rows: a constant score."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), ())
    edges = _edges(x, 48)
    code = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
    rng, margin, found = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(200, len(y) // 2)])
        for own, value in _grow(code, edges, p - y, p * (1 - p), rows, depth, (), rules := []):
            margin[own] += 0.3 * value
        found += rules
    rules = [Rule(c) for c in dict.fromkeys(found)]
    hold = np.stack([r.holds(x) for r in rules], 1).astype(float)
    bias, w = _lasso(hold, y, penalty)
    return Model(bias, tuple(Rule(r.conditions, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def fit_quality(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows whose id remainder is not 0: the `sample` rows of smallest hash.

    A share of all hash values that holds about 1.5 times as many goes first,
    so the bound holds for what reaches the driver at any size.  Several labels of one id count as their mean, rounded; null labels and ids
    do not count.
    """
    named = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.round(F.avg("quality")).alias("__y"))
    named = cut(named, "labelled")
    share = min(1.0, 1.5 * sample / max(1, named.count()))  # so that no task sends many more rows than are taken
    own = stats.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).where(id_remainder(F.col("doc_id")) != 0).join(named, F.col("doc_id") == F.col("__id")).select(*STATS, F.col("__y").cast("double"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("__h"), "doc_id")
    rows = own.orderBy("__h", "doc_id", *STATS).limit(sample).drop("__h", "doc_id").toPandas().to_numpy(float)
    return fit(rows[:, :-1], rows[:, -1]) if len(rows) else fit(np.zeros((0, len(STATS))), np.zeros(0))


def score_quality(docs: DataFrame, labels: DataFrame, at: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null text is the empty one, which has a score as well.  Repeated rows are
    scored each; a null id counts as the empty text for held_out.  Without any
    usable label every score is 0.5.  An empty table gives an empty result.
    Other columns of docs are ignored.
    """
    stats = cut(statistics(docs, id_col, text_col), "statistics")
    score = fit_quality(stats, labels, sample).column()
    return stats.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= at, 1).otherwise(0))


def keep_good_rows(docs: DataFrame, labels: DataFrame, at: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score under `at`, each on its own text.

    Decides by row, so ids may repeat or be null.  A null text scores as the
    empty one.  Columns of any names stay as they are; an empty table stays
    empty.
    """
    rows, row = with_rows(docs)
    stats = cut(statistics(rows, row, text_col), "statistics").withColumnRenamed("doc_id", "__row")
    named = stats.join(rows.select(F.col(row).alias("__row"), rows[f"`{id_col}`"].cast("long").alias("doc_id")), "__row")
    score = fit_quality(named, labels, sample).column()
    bad = cut(stats.where(score < at).select(F.col("__row").alias(row)), "rejected")
    return rows.join(bad, row, "left_anti").drop(row)
