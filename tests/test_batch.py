"""Runs from a folder to written notes, with a client that counts what it is asked."""

import glob
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from notefold.operators.model import HttpClient, OfflineClient
from notefold.plans import batch
from notefold.plans.run import Settings, index_notes, plan_writes
from notefold.sources.index import ROWS, VectorIndex

SETTINGS = Settings(min_score=0.0, min_tag_frequency=1)


class Counting(OfflineClient):
    """Writes a line to a file for each text: workers are other processes."""

    def __init__(self, folder):
        super().__init__()
        object.__setattr__(self, "folder", str(folder))

    def _say(self, name, lines):
        with open(f"{self.folder}/{name}-{os.getpid()}", "a") as f:
            f.writelines(json.dumps(x) + "\n" for x in lines)

    def embed(self, texts):
        self._say("embed", texts)
        return super().embed(texts)

    def chat(self, prompt):
        self._say("chat", [prompt])
        return super().chat(prompt)

    def asked(self, name):
        return [json.loads(x) for f in glob.glob(f"{self.folder}/{name}-*") for x in open(f)]


def note(k):
    return f"# Note {k}\n\n" + " ".join(f"common shared theme{j % 3} subject{k} detail{k}x{j}" for j in range(12)) + "\n"


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for k in range(6):
        path = root / ("a" if k % 2 else "b") / f"n{k}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(note(k))
    (tmp_path / "said").mkdir()
    return tmp_path, str(root), str(tmp_path / "store"), Counting(tmp_path / "said")


def go(spark, vault, **how):
    return batch.run(spark, vault[1], vault[2], vault[3], SETTINGS, **how)


def texts(root):
    return {os.path.relpath(f, root): open(f).read() for f in glob.glob(f"{root}/*/*.md")}


def test_a_run_writes_and_the_next_finds_nothing(spark, vault):
    tmp, root, store, client = vault
    got = go(spark, vault, apply=True)
    assert got.counts == {"notes": 6, "changed": 6, "removed": 0, "planned": 6, "written": 6}
    assert len(client.asked("embed")) == len(set(client.asked("embed"))) == 6 and len(client.asked("chat")) == 6
    after = texts(root)
    assert all(t.startswith("---\n") and "[!mindmap]- Mindmap" in t and note(int(p[3])).strip() in t for p, t in after.items())
    again = go(spark, vault, apply=True)
    assert (again.counts["changed"], again.counts["planned"], texts(root)) == (0, 0, after) and len(client.asked("chat")) == 6
    os.remove(f"{root}/b/n0.md")
    with open(f"{root}/a/n1.md", "a") as f:
        f.write("\nmore words\n")
    third = go(spark, vault, index=True)
    assert (third.counts["changed"], third.counts["removed"]) == (1, 1) and "planned" not in third.counts
    paths = {r.path for r in VectorIndex(spark, f"{store}/index").rows().collect()}
    assert paths == set(texts(root)) and len(batch.versions(spark, f"{store}/state")) == 1
    log = "".join(open(f).read() for f in glob.glob(f"{store}/log/part-*"))
    assert all(f"[related] {p} -> " in log for p in texts(root)) and "/8" in log


def test_preview_then_apply(spark, vault):
    tmp, root, store, client = vault
    before = texts(root)
    assert go(spark, vault, apply_preview=True).log == ["PREVIEW_EMPTY"]
    got = go(spark, vault, preview=True)
    assert texts(root) == before and "written" not in got.counts
    entries = [json.loads(x) for f in glob.glob(f"{store}/preview/part-*") for x in open(f)]
    assert {e["path"] for e in entries} == set(before) and all(set(e) == {"path", "summary", "tags", "concepts", "related"} for e in entries)
    with open(f"{store}/preview/part-99999.txt", "w") as f:
        f.write('{broken\n\n{"path": "../x.md"}\n{"path": "none.md"}\n' + json.dumps({"path": f"{root}/../x.md"}) + "\n")
    done = go(spark, vault, apply_preview=True)
    assert done.counts == {"preview": 10, "written": 6}
    assert sorted(x.split()[1] for x in done.log) == ["PREVIEW_LINE_INVALID:", "PREVIEW_TARGET_MISSING:", "WRITE_TARGET_OUTSIDE_VAULT:", "WRITE_TARGET_TRAVERSAL:"]
    assert all("[!mindmap]- Mindmap" in t for t in texts(root).values()) and go(spark, vault).counts["changed"] == 0


def test_limit_scope_and_rebuild(spark, vault):
    assert go(spark, vault, index=True, limit=2).counts == {"notes": 2, "changed": 2, "removed": 0}
    assert go(spark, vault, index=True, scopes=["b"]).counts == {"notes": 3, "changed": 3, "removed": 2}
    assert go(spark, vault, index=True, scopes=["b"], rebuild=True).counts == {"notes": 3, "changed": 3, "removed": 0}
    assert go(spark, vault, scopes=["missing"], apply=True).counts["notes"] == 0


def test_links_stay_among_allowed_notes(spark, vault):
    client = OfflineClient()
    notes = spark.createDataFrame([(f"a/n{k}.md", note(k), note(k)) for k in range(4)], "relpath string, text string, body string")
    index, _ = index_notes(notes, spark.createDataFrame([], batch.STATE), spark.createDataFrame([], ROWS), client, SETTINGS)
    allowed = notes.where("relpath <> 'a/n2.md'").select(F.col("relpath").alias("path"))
    plan, rows = plan_writes(notes, notes, index, client, None, SETTINGS, allowed)
    assert all("a/n2.md" not in r.related for r in rows.collect()) and plan.count() == 4


def test_client_lists_models_and_sends_a_system_message(tmp_path):
    seen = []

    class Server(BaseHTTPRequestHandler):
        def answer(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):
            self.answer({"models": [{"name": "m:latest"}, {"name": ""}, "x", {"name": "e"}]} if self.path == "/api/tags" else {})

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.answer({"message": {"content": "{}"}})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = HttpClient(f"http://127.0.0.1:{server.server_port}/", "e", "m")
        assert client.models() == ["m:latest", "e"] and client.chat("hello") == "{}"
        assert [m["role"] for m in seen[0]["messages"]] == ["system", "user"] and seen[0]["messages"][1]["content"] == "hello"
    finally:
        server.shutdown()
