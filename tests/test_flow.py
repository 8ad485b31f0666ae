"""Front matter written as one flow mapping: what is set reads back, what is not stays as it was."""

import random

import pytest
from pyspark.sql import functions as F

from notefold.functions.frontmatter import updated

yaml = pytest.importorskip("yaml")
UPDATES = {"summary": "a: b, [c] #d", "tags": ["x", "y z", "q,r", "true"], "concepts": []}
NOTES = [
    "{}", "{ }", "{a: 1}", "{summary: old}", "{summary: 'it''s, {old}', b: [1, {c: 2}]}", '{"summary": "x\\"}, y", tags: [a, b]}', "# first\n{a: 1, # one, two }\n tags: [x, # y\n  z], b: null}  # last\n# end",
    "{summary, tags: }", "{summary:, a: http://x.y:80/z#f}", "{a: &n [1, 2], b: *n, summary: !!str 5}", "{a: 1, tags: [x],}", "{\n  summary: two\n    lines,\n  n: 1\n}", '{"a":1,"tags":["x"],"summary":"s"}', "{'tags': [], x: {}}", "{é: ü, 日: 本}",
]


def read(text):
    return yaml.safe_load(text.split("---\n")[1])


@pytest.mark.parametrize("inner", NOTES)
def test_set_values_read_back(inner):
    text = f"---\n{inner}\n---\nbody\n"
    out = updated(text, UPDATES, ["summary", "tags", "concepts"])
    old = yaml.safe_load(inner)
    assert read(out) == {**old, **UPDATES}
    assert out.endswith("\n---\nbody\n") and out.count("#") >= inner.count("#")
    assert updated(out, UPDATES, ["summary", "tags", "concepts"]) == out
    assert updated(text, {}, []) == text


def test_only_the_value_changes():
    inner = "{a:   1 , tags: [x] ,  # why\n  z: {q: [1,2]} }"
    out = updated(f"---\n{inner}\n---\n", {"tags": ["new"]}, [])
    assert out == "---\n" + inner.replace("[x]", "[new]") + "\n---\n"


@pytest.mark.parametrize("inner", ["{a: 1", "{a: 'x}", "{a: 1} b: 2", "{a: [1}", "{,}", "{a b: {c}"])
def test_broken_ones_are_left_alone(inner):
    with pytest.raises(ValueError):
        updated(f"---\n{inner}\n---\n", UPDATES, [])


def test_random_mappings():
    rng = random.Random(2)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 2 else 4)
        if kind < 4:
            return (rng.randrange(99), "plain text", "it's, [odd] {x}: #y", None)[kind]
        return [value(depth + 1) for _ in range(rng.randrange(3))] if kind < 6 else {f"k{k}": value(depth + 1) for k in range(rng.randrange(3))}

    for _ in range(300):
        old = {k: value() for k in rng.sample(["summary", "tags", "a", "b c", "d"], rng.randrange(5))}
        inner = yaml.safe_dump(old, default_flow_style=True, width=rng.choice((20, 1000))).strip()
        assert read(updated(f"---\n{inner}\n---\n", UPDATES, ["summary"])) == {**old, **UPDATES}


def test_only_front_matter_goes_to_python(spark):
    from notefold.functions.frontmatter import divided, head, update_frontmatter

    body = "text\r\nof the body\n" * 5000
    texts = ["", "\n", "---", "---\n---", "---\n---\n", "--- x\na: 1\n --- \x85\t\nb", "---\r\na: 1\r\n---\r\n\r\nb\r\n", "---\na: 1\n----\nb", "---\na: 1\n--- x\n---\n---\n", "no\n---\na: 1\n---\n", "---\na: 1\n\x1c---\x1f\n\nb", "---\n{a: 1}\n---\nb", "---\n{a\n---\nb", f"---\na: é日\n---\n{body}", f"---\n{body}", body, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("u", F.struct(F.lit("s").alias("summary")))
    out = df.select("k", head(F.col("text")).alias("head"), update_frontmatter(F.col("text"), F.col("u")).alias("new"))
    for r in out.collect():
        text = texts[r.k]
        if text is None:
            assert r.head is None and r.new is None
            continue
        rows, rest = divided(text)
        assert divided(r.head)[0] == rows and (rows is None) == (r.head == "") and len(r.head) <= 200
        try:
            want = updated(text, {"summary": "s"}, ["summary", "tags", "concepts", "related"])
        except ValueError:
            want = None
        assert r.new == want, (text[:50], r.new, want)
    plan = out.select("new")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" in plan
