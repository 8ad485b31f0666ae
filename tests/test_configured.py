"""From a config file to written notes, a preflight, and requests that never are too many at once."""

import glob
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from notefold.operators.model import HttpClient, OfflineClient, embed_chunks, extract_metadata, pooled
from notefold.plans import batch
from notefold.plans.configured import configured, scopes_of, settings_of


class Server:
    """A slow model server that notes what it is asked, and how many requests are open at once."""

    def __init__(self, pause=0.0, fails=()):
        own, offline = self, OfflineClient(16)
        self.guard, self.open, self.most, self.texts, self.prompts = threading.Lock(), 0, 0, [], []

        class Handler(BaseHTTPRequestHandler):
            def send(self, value, code=200):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(value).encode())

            def do_GET(self):
                self.send({"models": [{"name": "embedder:latest"}, {"name": "talker"}]})

            def do_POST(self):
                said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with own.guard:
                    own.open += 1
                    own.most = max(own.most, own.open)
                time.sleep(pause)
                try:
                    if self.path == "/api/embed":
                        if any(f in t for f in fails for t in said["input"]):
                            return self.send({}, 500)
                        with own.guard:
                            own.texts += said["input"]
                        return self.send({"embeddings": offline.embed(said["input"])})
                    with own.guard:
                        own.prompts.append(said["messages"][1]["content"])
                    self.send({"message": {"content": json.dumps({"summary": "s", "tags": ["Topic", "Data Sets"], "concepts": ["Big Idea", "big idea"]})}})
                finally:
                    with own.guard:
                        own.open -= 1

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.server.shutdown()


@pytest.fixture
def vault(tmp_path):
    def made(url):
        root = tmp_path / "vault"
        for k in range(6):
            path = root / ("daily", "work", "private")[k % 3] / f"n{k}.md"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"# Note {k}\n\n" + " ".join(f"common theme{k % 2} word{j}" for j in range(12)) + "\n")
        home = root / ".app"
        home.mkdir()
        (home / "aliases.json").write_text(json.dumps({"subject": ["topic"]}))
        (home / "controlled.json").write_text(json.dumps(["subject", "data-set"]))
        config = {
            "vault_root": "..", "db_path": ".app/data/index", "ollama_base_url": url, "embed_model": "embedder", "llm_model": "talker", "notes_paths_current": ["daily"], "notes_paths_all": ["daily", "/work/"],
            "notes_paths": ["private"], "min_note_words": 3, "related_limit": 2, "related_min_score": 0.1, "tag_aliases_path": "aliases.json", "controlled_tags_path": "controlled.json", "allow_free_tags": False,
            "mindmap_heading": "## Links", "concept_case": "title", "ollama_retries": 0, "related_strategy": "note", "write_mindmap_section": True,
        }
        (home / "config.json").write_text(json.dumps(config))
        return root, str(home / "config.json"), config

    return made


def test_from_a_config_to_written_notes(spark, vault, capsys):
    with Server() as server:
        root, path, _ = vault(server.url)
        before = {p: open(p).read() for p in glob.glob(f"{root}/*/*.md")}
        assert batch.main(["--config", path, "--all", "--apply"]) == 0
        said = capsys.readouterr().out
        assert "notes: 4" in said and "written: 4" in said
        after = {p: open(p).read() for p in before}
        for p, t in after.items():
            if "/private/" in p:
                assert t == before[p]
            else:
                assert "- subject" in t and "- data-set" in t and "Topic" not in t and "- Big Idea" in t and "big idea" not in t
                assert "[[daily/" in t or "[[work/" in t
                assert "private/" not in t
        log = "".join(open(f).read() for f in glob.glob(f"{root}/.app/data/log/part-*"))
        assert log.count("[related] ") == 4 and "/2" in log
        assert len(server.prompts) == 4 and all("subject, data-set" in p and "no tag outside the list" in p for p in server.prompts)
        assert batch.main(["--config", path, "--all", "--apply", "--quiet"]) == 0
        assert capsys.readouterr().out == "" and len(server.prompts) == 4 and {p: open(p).read() for p in before} == after
        assert batch.main(["--config", path, "--preview"]) == 0 and "notes: 2" in capsys.readouterr().out
        assert batch.main(["--config", path, "--tag", "--current"]) == 0 and "notes: 2" in capsys.readouterr().out


def test_refused_previews_are_diagnosed(spark, vault, capsys):
    with Server() as server:
        root, path, _ = vault(server.url)
        os.makedirs(root / ".app/data/preview")
        (root / ".app/data/preview/part-0.txt").write_text('{"path": "daily/n0.md", "summary": "told"}\n[1]\n{"path": "../x.md"}\n{"path": "daily/none.md"}\n')
        assert batch.main(["--config", path, "--apply-preview"]) == 0
        assert "summary: told" in open(root / "daily/n0.md").read()
        log = "".join(open(f).read() for f in glob.glob(f"{root}/.app/data/log/part-*"))
        assert "[warn][PREVIEW_ENTRY_INVALID] This line" in log and "Guidance: Name notes by paths below the vault. Context: entry=" in log and "path=daily/none.md" in log
        assert capsys.readouterr().out.count("[skip]") == 3 and server.prompts == []


def test_preflight(spark, vault, capsys):
    with Server() as server:
        root, path, config = vault(server.url)
        assert batch.main(["--config", path, "--preflight"]) == 0
        said = json.loads(capsys.readouterr().out)
        assert said["ok"] and {c["code"] for c in said["checks"]} >= {"CONFIG_OK", "OLLAMA_REACHABLE", "OLLAMA_MODELS_OK"}
        open(path, "w").write(json.dumps(config | {"llm_model": "other"}))
        assert batch.main(["--config", path, "--preflight"]) == 1
        said = json.loads(capsys.readouterr().out)
        assert not said["ok"] and said["checks"][-1]["code"] == "OLLAMA_MODELS_MISSING" and said["summary"] == said["checks"][-1]["message"] == "other"
    assert batch.main(["--config", path, "--preflight"]) == 1 and "OLLAMA_UNREACHABLE" in capsys.readouterr().out
    open(path, "w").write("{broken")
    assert batch.main(["--config", path]) == 1 and "[error][CONFIG_INVALID]" in capsys.readouterr().err
    assert batch.main(["--config", path + "x", "--preflight"]) == 1 and "CONFIG_MISSING" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        batch.main(["--current", "--all", "--config", path])


def test_what_a_config_leaves_out(spark, tmp_path):
    s = settings_of({"related_limit": "5", "related_min_score": 1, "tag_limit": None})
    assert (s.related_limit, s.min_score, s.tag_limit, s.candidate_limit, s.min_tag_frequency, s.concept_case, s.by_notes) == (5, 1.0, 3, 40, 1, "keep", False)
    assert scopes_of(spark, {"notes_path": "only"}, "all") == ["only"] and scopes_of(spark, {"notes_paths": ["a"], "notes_paths_current": ["b"]}, "current") == ["b"]
    assert scopes_of(spark, {"notes_paths": ["a"]}, "all") == ["a"] and scopes_of(spark, {}, None) == []
    (tmp_path / "c.json").write_text(json.dumps({"vault_root": "v", "ollama_base_url": "u", "embed_model": "e", "llm_model": "l", "ollama_timeout_seconds": 7, "ollama_llm_timeout_seconds": 9}))
    own, code = configured(spark, str(tmp_path / "c.json"))
    assert code == "CONFIG_OK" and own.root == str(tmp_path / "v") and own.store == f"{own.root}/data" and (own.client.embed_timeout, own.client.chat_timeout) == (7, 9) and own.aliases is None


def test_requests_are_bounded_and_each_text_is_asked_once(spark):
    with Server(pause=0.03, fails=("bad",)) as server:
        client = HttpClient(server.url, "e", "m", retries=0)
        rows = [(f"n{k}", c, f"text {k} {c}") for k in range(20) for c in range(3)]
        df = spark.createDataFrame(rows, "path string, chunk int, text string").coalesce(1)
        got = {(r.path, r.chunk): r.v for r in embed_chunks(df, client, batch=4, at_once=3).collect()}
        assert 2 <= server.most <= 3 and sorted(server.texts) == sorted(t for *_, t in rows)
        assert {k: [round(x, 6) for x in v] for k, v in got.items()} == {(p, c): [round(x, 6) for x in OfflineClient(16).embed([t])[0]] for p, c, t in rows}
        bad = spark.createDataFrame([*rows, ("n3", 9, "bad")], "path string, chunk int, text string").coalesce(1)
        assert {r.path for r in embed_chunks(bad, client, batch=8, at_once=2).collect()} == {p for p, *_ in rows} - {"n3"}
        server.most = 0
        notes = spark.createDataFrame([(f"n{k}", f"body {k}") for k in range(12)], "relpath string, body string").coalesce(1)
        said = extract_metadata(notes, client, at_once=5).collect()
        assert 2 <= server.most <= 5 and len(server.prompts) == 12 and all(r.summary == "s" and r.error is None for r in said)


def test_a_rate_is_kept_and_order_stays():
    begun = []

    def call(k):
        begun.append(time.monotonic())
        if k == 3:
            raise ValueError("three")
        return k

    got = list(pooled((lambda k=k: call(k) for k in range(8)), at_once=4, per_second=40))
    assert [x if isinstance(x, int) else str(x) for x in got] == [0, 1, 2, "three", 4, 5, 6, 7]
    assert max(begun) - min(begun) >= 0.16
