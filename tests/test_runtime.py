"""Front matter, configuration, paths, the model client and a whole run on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from notefold.functions import frontmatter as Y
from notefold.functions import runtime as R
from notefold.functions.text import chunks
from notefold.operators import fuzzy
from notefold.operators import model as M
from notefold.operators import writes as W
from notefold.operators.preflight import preflight_checks, rollup
from notefold.plans import run
from notefold.sources import config as C
from notefold.sources import notes as src

NEW = {"summary": "new summary", "tags": ["one", "two"], "concepts": ["focus"], "related": ["Notes/Other.md"]}
ORDER = ["summary", "tags", "concepts", "related"]


def test_update_keeps_comments_and_nested_values():
    text = "---\n# top\ntitle: Sample\naliases:\n  - Alpha\nmeta:\n  flags:\n    pinned: true # inline\nsummary: old\n---\nBody here.\n"
    got = Y.updated(text, NEW, ORDER)
    assert got == "---\n# top\ntitle: Sample\naliases:\n  - Alpha\nmeta:\n  flags:\n    pinned: true # inline\nsummary: new summary\ntags:\n  - one\n  - two\nconcepts:\n  - focus\nrelated:\n  - Notes/Other.md\n---\nBody here.\n"
    assert Y.updated(got, NEW, ORDER) == got


def test_update_replaces_blocks_and_leaves_others():
    text = "---\ndescription: |\n  line one\n\n  line two\ntags:\n- old\n- older\ncreated: 2026-03-24\nsummary: >\n  long\n  text\n---\nBody.\n"
    got = Y.updated(text, {"summary": "fresh: yes", "tags": []}, ORDER)
    assert got == "---\ndescription: |\n  line one\n\n  line two\ntags: []\ncreated: 2026-03-24\nsummary: 'fresh: yes'\n---\nBody.\n"


def test_update_without_front_matter_and_not_a_mapping():
    got = Y.updated("Simple body.\n", {"summary": "s", "tags": ["a"]}, ORDER)
    assert got == "---\nsummary: s\ntags:\n  - a\n---\nSimple body.\n"
    with pytest.raises(ValueError):
        Y.updated("---\n- a\n- b\n---\nx", {"summary": "s"}, ORDER)


@pytest.mark.parametrize("value", ["plain words", "true", "12", "2026-01-01", "a: b", "it's", " lead", "x #y", "tab\there", "", "- dash", "*star", "ends:", "日本", "null", "[x]", "line\nbreak", "ünï"])
def test_scalars_read_back(value):
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load("\n".join(Y.rendered("k", value))) == {"k": value}
    assert yaml.safe_load("\n".join(Y.rendered("k", [value, "b"]))) == {"k": [value, "b"]}


def test_front_matter_columns(spark):
    rows = [("---\na: 1\nb: [x]\n---\nz",), ("none",), ("---\n- x\n---\n",), ("---\na: [\n---\n",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    updates = F.struct(F.lit("s").alias("summary"), F.lit(None).cast("string").alias("other"))
    got = df.select(Y.parse_frontmatter(F.col("t")), Y.update_frontmatter(F.col("t"), updates)).collect()
    assert [json.loads(r[0]) if r[0] else None for r in got] == [{"a": 1, "b": ["x"]}, {}, {}, None, {}]
    assert [r[1] for r in got][:3] == ["---\na: 1\nb: [x]\nsummary: s\n---\nz", "---\nsummary: s\n---\nnone", None] and got[4][1] is None


def test_config(spark):
    assert [C.read_config(x)[1] for x in (None, "{", "[]", "{}", '{"a": 1}')] == ["CONFIG_MISSING", "CONFIG_INVALID", "CONFIG_EMPTY", "CONFIG_EMPTY", "CONFIG_OK"]
    new = json.loads(C.with_scopes('{"keep": 1, "notes_paths": ["x"]}', ["b/", "./a", "b"], ["/", "../no"]))
    assert new == {"keep": 1, "notes_paths": ["a", "b"], "notes_paths_current": ["a", "b"], "notes_paths_all": ["."]}
    with pytest.raises(ValueError):
        C.with_scopes("{}", ["a"], [])
    assert C.controlled_tags('["a", 1]') == ["a", "1"] and C.controlled_tags("{") == [] and C.controlled_tags('{"a": 1}') == []
    raw = '{"tag": ["x", "y", ""], "z": "other", "n": 3, "x2": ["x"]}'
    got = C.tag_aliases(spark.createDataFrame([(0, raw), (1, "{bad")], "seq int, raw string")).collect()
    assert {r.alias: r.canonical for r in got} == {"x": "x2", "y": "tag", "z": "other"}


def test_state_and_config_files(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"files": {"a\\\\b.md": {"hash": "h"}, "c.md": {"hash": 3}, "d.md": "x"}}')
    got = C.read_state(spark, str(tmp_path / "state.json"))
    assert [tuple(r) for r in got.collect()] == [("a/b.md", "h")]
    C.write_state(got, str(tmp_path / "state"))
    assert C.read_state(spark, str(tmp_path / "state")).count() == 1
    (tmp_path / "config.json").write_text('{\n"a": 1}')
    assert C.load_config(spark, str(tmp_path / "none.json"), str(tmp_path / "config.json")) == ({"a": 1}, "CONFIG_OK")
    assert C.load_config(spark, str(tmp_path / "none.json")) == (None, "CONFIG_MISSING")


def test_scopes(spark):
    df = spark.createDataFrame([(["b", "a/./c/", "..", ".", "b", "A", "\\x\\y"],)], "p array<string>")
    assert df.select(R.scope_paths(F.col("p"))).first()[0] == [".", "A", "a/c", "b", "x/y"]
    assert df.select(F.size(R.refused_args(F.array(F.lit("--all"), F.lit("--bad"))))).first()[0] == 1
    assert df.select(R.command_line(F.array(F.lit("a b"), F.lit("c")))).first()[0] == '"a b" c'


def test_runtime_paths(spark):
    files = ["/v/c/p/python/m.py", "/v/c/p/python/config.template.json", "/v/tools/py", "/v/x/s.py", "/v/x/c.json"]
    cases = [("", "", ""), ("tools/py", "x/s.py", "x/c.json"), ("python3", "../../o.py", "../o.json"), ("/opt/python3", "/tmp/m.py", ""), ("python3; rm", "", ""), ("python3 -c", "", ""), ("python3.12", "", "")]
    df = spark.createDataFrame([(*c, files) for c in cases], "a string, b string, c string, f array<string>")
    got = [r[0] for r in df.select(R.runtime(F.col("a"), F.col("b"), F.col("c"), F.lit("/v"), F.lit("/v/c/p"), F.col("f"), "m.py")).collect()]
    assert [r.trust for r in got] == ["trusted", "caution", "blocked", "blocked", "blocked", "blocked", "trusted"]
    assert got[0].config.path.endswith("template.json") and got[1].command.path == "/v/tools/py"
    assert (got[2].script.problem, got[2].config.problem, got[3].script.problem, got[3].command.problem, got[4].command.problem, got[5].command.problem) == ("OUTSIDE", "OUTSIDE", "ABSOLUTE", "MISSING", "METACHARACTER", "NOT_ONE_NAME")


def test_preflight(spark):
    good = '{"ollama_base_url": "u", "embed_model": "e:1", "llm_model": "l"}'

    def down(_):
        raise OSError("no")

    codes = lambda raw, models: [r.code for r in preflight_checks(spark, raw, models, ("numpy", "no_such_package")).orderBy("seq").collect()]
    assert codes(None, down) == ["PYTHON_RUNTIME_OK", "DEPENDENCY_NUMPY_OK", "DEPENDENCY_NO_SUCH_PACKAGE_MISSING", "CONFIG_MISSING"]
    assert codes('{"embed_model": "e"}', down)[-1] == "CONFIG_FIELDS_MISSING"
    assert codes(good, down)[-1] == "OLLAMA_UNREACHABLE"
    assert codes(good, lambda _: ["e:2"])[-2:] == ["OLLAMA_REACHABLE", "OLLAMA_MODELS_MISSING"]
    assert rollup(preflight_checks(spark, good, lambda _: ["e:2", "l"])).first().ok


def test_retries():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(RuntimeError):
        M.with_retries(fail, 2, 2.0, waits.append)
    assert (len(calls), waits) == (3, [2.0, 4.0])
    assert M.with_retries(lambda: {"a": 1}, 0) == {"a": 1}


class Moody(M.OfflineClient):
    """Fails on some texts."""

    def embed(self, texts):
        if any("boom" in t for t in texts):
            raise OSError("no")
        return super().embed(texts)[: 1 if any("short" in t for t in texts) else None]

    def chat(self, prompt):
        if "boom" in prompt:
            raise OSError("no")
        return "[1]" if "list" in prompt.rsplit("Note:", 1)[1] else "nothing" if "prose" in prompt else 'Here: {"summary": "s", "tags": ["A b"]} ok'


def test_failures_leave_notes_out(spark):
    chunks_of = spark.createDataFrame([("a", 0, "x"), ("a", 1, "boom"), ("b", 0, "y"), ("c", 0, "short"), ("c", 1, "z"), ("d", 0, None)], "path string, chunk int, text string").coalesce(1)
    assert {r.path for r in M.embed_chunks(chunks_of, Moody(), batch=1).collect()} == {"b", "c", "d"}
    # a request of several notes that fails is asked again note by note: only the note that fails by itself is left out
    assert {r.path for r in M.embed_chunks(chunks_of, Moody(), batch=2).collect()} == {"b", "c", "d"}
    notes = spark.createDataFrame([("a", "boom"), ("b", "prose"), ("c", "a list"), ("d", "fine"), ("e", None)], "relpath string, body string")
    got = {r.relpath: r for r in M.extract_metadata(notes, Moody()).collect()}
    assert got["a"].error == "no" and got["b"].error == got["c"].error == "MODEL_INVALID_RESPONSE"
    assert (got["d"].summary, got["d"].tags, got["d"].concepts, got["d"].error) == ("s", ["A b"], [], None) and got["e"].error is None


def test_controlled_tags(spark):
    df = spark.createDataFrame([(1, ["abcd", "zzzz", "abcf", "x", "a-b-c-d"]), (2, []), (3, ["zzzz"])], "note int, tags array<string>")
    get = lambda free, words=("abce", "abcf"): {r.note: r.tags for r in fuzzy.controlled_tags(df, list(words), free).collect()}
    assert get(False) == {1: ["abcf"], 2: [], 3: []}
    assert get(True) == {1: ["abcf", "zzzz"], 2: [], 3: ["zzzz"]}
    assert get(False, ()) == {1: ["abcd", "zzzz", "abcf"], 2: [], 3: ["zzzz"]}


def test_writes(spark, tmp_path):
    (tmp_path / "n").mkdir()
    notes = [("n/a.md", "Body a.\n"), ("n/b.md", "---\n- x\n---\nBody b.\n"), ("../c.md", "Body c.\n")]
    for rel, t in notes[:2]:
        (tmp_path / rel).write_text(t)
    df = spark.createDataFrame([(r, t, ("s", ["t"], [], ["n/b.md"]), [("n/b.md", "core")]) for r, t in notes], f"relpath string, text string, updates struct<{W.UPDATES.replace(' ', ':').replace(',:', ',')}>, links array<struct<path:string,kind:string>>")
    plan = W.planned_writes(df)
    assert [r.relpath for r in W.apply_writes(plan, str(tmp_path)).collect()] == ["n/a.md"]
    text = (tmp_path / "n/a.md").read_text()
    assert text.startswith("---\nsummary: s\ntags:\n  - t\nconcepts: []\nrelated:\n  - n/b.md\n---\nBody a.\n\n---\n\n> [!") and text.endswith("[[n/b.md|b]]</span>\n")
    again = df.where("relpath = 'n/a.md'").withColumn("text", F.lit(text))
    assert not W.planned_writes(again).first().changed
    assert W.state_after(plan.where("new_text is not null")).count() == 2


def test_whole_run(spark):
    notes = [(f"f{k % 3}/n{k}.md", f"text {k}", " ".join(f"topic{k % 4} word{j} matter{j % 5}" for j in range(60 + k)) + "\n") for k in range(12)]
    df = spark.createDataFrame(notes, "relpath string, text string, body string")
    state = spark.createDataFrame([("f0/n0.md", "old"), ("gone.md", "x")], "relpath string, hash string")
    index = spark.createDataFrame([], "path string, chunk int, v array<double>")
    client, s = M.OfflineClient(), run.Settings(min_score=0.1, candidate_limit=40, min_tag_frequency=1)
    new_index, new_state = run.index_notes(df, state, index, client, s)
    assert new_index.count() == df.select(F.sum(F.size(chunks(F.col("body"))))).first()[0] and {r.relpath for r in new_state.collect()} == {n for n, *_ in notes}
    kept = new_index.cache()
    again, _ = run.index_notes(df, new_state, kept, client, s)
    assert again.count() == kept.count()
    plan = run.plan_writes(df, df.where("relpath like 'f1/%'"), kept, client, None, s)[0].collect()
    assert len(plan) == 4 and all(r.changed and "related:\n  - " in r.new_text for r in plan)
    assert run.plan_writes(df, df.limit(0), kept, client, None, run.Settings(min_score=0.1, by_notes=True, refresh_all=True))[0].count() == 12


def test_knn_over_many_blocks(spark):
    import numpy as np

    from notefold.operators import similarity as S

    v = np.round(np.random.default_rng(5).normal(size=(90, 4)), 1)
    v[60:] = v[:30]  # ties
    rows = [(f"p{k // 3:02}", k % 3, [float(x) for x in v[k]]) for k in range(90)]
    got = {}
    for r in S.knn_chunks(spark.createDataFrame(rows, "path string, chunk int, v array<double>"), 5, 7).collect():
        got.setdefault((r.note, r.chunk), []).append((r["rank"], r.path, r.path_chunk))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    for k, (p, c, _) in enumerate(rows):
        order = sorted(range(90), key=lambda j: (-score[k, j], rows[j][0], rows[j][1]))[:5]
        near = [(rows[j][0], rows[j][1]) for j in order]
        mine = [x[1:] for x in sorted(got[p, c])]
        assert mine == near or [score[k, int(a[1:]) * 3 + b] for a, b in mine] == pytest.approx([score[k, j] for j in order], abs=2e-9)


def test_read_folder(spark, tmp_path):
    root = tmp_path / "my vault+x"
    for rel, raw in {"a.md": b"---\nk: 1\n---\none two three", "f/x/b.v1.md": "é two".encode() + b"\xff three\n", "f/short.md": b"one", "g/c.txt": b"one two three", "g/d.md": b"one two three"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(raw)
    got = {r.relpath: (r.title, r.body) for r in src.read_folder(spark, str(root), min_words=3).collect()}
    assert got == {"a.md": ("a", "one two three\n"), "f/x/b.v1.md": ("b.v1", "é two three\n"), "g/d.md": ("d", "one two three\n")}
    assert {r.relpath for r in src.read_folder(spark, str(root), min_words=3, scopes=["f", "none"]).collect()} == {"f/x/b.v1.md"}
