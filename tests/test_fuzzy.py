"""Nearest tags against difflib over whole vocabularies, and how few are compared exactly."""

import difflib
import random

from pyspark.sql import functions as F

from notefold.operators import fuzzy
from notefold.operators.fuzzy import Vocabulary, nearest_tags

WORDS = ["data", "graph", "note", "index", "spark", "learning", "machine", "vector", "query", "stream", "plan", "garden", "travel", "budget", "recipe", "health"]


def made(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        t = "-".join(rng.sample(WORDS, rng.randrange(1, 4))) + rng.choice(("", "s", "2", "x9"))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("abcdefgz-") + t[k + rng.randrange(2) :]
        out.add("-".join(x for x in t.split("-") if x))
    return sorted(out)


def plain(tag, vocabulary, least=0.75):
    return next(iter(difflib.get_close_matches(tag, vocabulary, 1, least)), None)


def test_same_as_difflib_with_few_comparisons():
    vocabulary, tags = made(700, 1), made(250, 2) + ["", "a", "q" * 300, "data" * 80, "é-ß"]
    own, compared = Vocabulary([*vocabulary, ""]), 0
    for least in (0.75, 0.4):
        for t in tags if least == 0.75 else tags[::9]:
            best, ratio, n = own.nearest(t, least)
            assert best == plain(t, [*vocabulary, ""], least)
            assert best is None or ratio == difflib.SequenceMatcher(None, best, t).ratio()
            compared += n if least == 0.75 else 0
    assert compared < 0.03 * len(tags) * len(vocabulary)


def test_bounds_hold_for_ten_thousand_tags():
    """A tenth of the tags of a large vocabulary, each changed a little: all are found again, by some comparisons each."""
    vocabulary = made(10_000, 3)
    own, rng, compared = Vocabulary(vocabulary), random.Random(5), 0
    for t in rng.sample(vocabulary, 1000):
        k = rng.randrange(len(t))
        best, ratio, n = own.nearest(t[:k] + "q" + t[k + 1 :], 0.75)
        assert ratio >= difflib.SequenceMatcher(None, t, t[:k] + "q" + t[k + 1 :]).ratio() or len(t) < 4
        compared += n
    assert compared < 0.02 * 1000 * 10_000


def test_tables_and_lists_agree(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE", 40)
    monkeypatch.setattr(fuzzy, "GROUP", 50)
    vocabulary, tags = made(150, 1), made(120, 2) + made(150, 1)[:9]
    df = spark.createDataFrame([(t,) for t in [*tags, *tags[:5], None]], "tag string")
    want = {t: plain(t, vocabulary) for t in tags}
    assert {r.tag: r.nearest for r in nearest_tags(df, vocabulary).collect()} == want
    table = spark.createDataFrame([(t.upper(),) for t in vocabulary] + [(None,), ("",)], "tag string")
    assert {r.tag: r.nearest for r in nearest_tags(df, table).collect()} == want
    assert {r.nearest for r in nearest_tags(df, table.where(F.lit(False))).collect()} == {None}
    assert nearest_tags(df.where(F.lit(False)), table).count() == 0
