"""Embeddings and metadata from a model behind a client, for all notes in Arrow batches.

A client has embed(texts) -> vectors and chat(prompt) -> text.  `HttpClient`
asks a server over HTTP; `OfflineClient` needs none: hashed words as vectors,
the text's own first words as metadata.  A failure is a value in a column, so a
note that fails is left out and the run goes on.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol
from urllib import request

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions.text import salvaged_json, strip

#: Texts in one embedding request.
BATCH = 16


class Client(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, prompt: str) -> str: ...


def listed_models(base_url: str) -> list[str]:
    """What preflight_checks asks a server for."""
    return HttpClient(base_url, "", "").models()


def with_retries(call: Callable[[], dict], retries: int = 1, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call(), again after a failure, up to `retries` more times, waiting longer each time; the last failure is raised."""
    for attempt in range(1, max(1, retries + 1) + 1):
        try:
            return call()
        except Exception as e:
            if attempt >= max(1, retries + 1):
                raise RuntimeError(f"request failed after {attempt} attempts: {e}") from e
            sleep(backoff * attempt)
    raise AssertionError


@dataclass(frozen=True)
class HttpClient:
    base_url: str
    embed_model: str
    chat_model: str
    embed_timeout: int = 120
    chat_timeout: int = 180
    retries: int = 1
    backoff: float = 2.0
    system: str = "You describe personal notes. Answer with JSON only, briefly, and from the note alone."

    def models(self, timeout: int = 10) -> list[str]:
        """Names of the models that the server has."""
        with request.urlopen(self.base_url.rstrip("/") + "/api/tags", timeout=timeout) as r:
            listed = json.loads(r.read()).get("models", [])
        return [str(m["name"]) for m in listed if isinstance(m, dict) and m.get("name")]

    def _post(self, endpoint: str, payload: dict, timeout: int) -> dict:
        req = request.Request(self.base_url.rstrip("/") + endpoint, json.dumps(payload).encode(), {"Content-Type": "application/json"})

        def call() -> dict:
            with request.urlopen(req, timeout=timeout) as r:
                return json.loads(r.read())

        return with_retries(call, self.retries, self.backoff)

    def embed(self, texts: list[str]) -> list[list[float]]:
        r = self._post("/api/embed", {"model": self.embed_model, "input": texts}, self.embed_timeout)
        if "embeddings" not in r and "embedding" not in r:
            raise RuntimeError("the response holds no vectors")
        return r["embeddings"] if "embeddings" in r else [r["embedding"]]

    def chat(self, prompt: str) -> str:
        r = self._post("/api/chat", {"model": self.chat_model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], "format": "json", "stream": False}, self.chat_timeout)
        return r.get("message", {}).get("content", "")


@dataclass(frozen=True)
class OfflineClient:
    """No server: signed hashed words as unit vectors; the note's first words as summary, its commonest long words as tags and concepts."""

    size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                row[h % self.size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    def chat(self, prompt: str) -> str:
        words = prompt.rsplit("Note:\n", 1)[-1].split()
        common = [w for w, _ in sorted(Counter(re.sub(r"\W", "", w).lower() for w in words if len(w) > 4).items(), key=lambda x: (-x[1], x[0])) if w]
        return json.dumps({"summary": " ".join(words[:25]), "tags": common[:3], "concepts": common[3:7]})


def pooled(calls: Iterable[Callable[[], object]], at_once: int = 4, per_second: float | None = None) -> Iterator[object]:
    """What the calls give or raise, in order, at most at_once of them at a time and per_second of them begun in a second."""
    guard, free = threading.Lock(), [0.0]

    def one(call: Callable[[], object]) -> object:
        if per_second:
            with guard:
                now = time.monotonic()
                begin = max(now, free[0])
                free[0] = begin + 1 / per_second
            time.sleep(begin - now)
        try:
            return call()
        except Exception as e:
            return e

    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for call in calls:
            waiting.append(pool.submit(one, call))
            if len(waiting) >= 2 * at_once:  # no more are held than keep the pool busy
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def embed_chunks(chunks: DataFrame, client: Client, batch: int = BATCH, at_once: int = 4, per_second: float | None = None) -> DataFrame:
    """path, chunk, v of chunks (path, chunk, text); a note with a failed or short request is left out whole.

    A request holds `batch` texts, of several notes if need be; a task has
    at_once requests open and begins per_second in a second at most.  Where a
    request of several notes fails, each of its notes is asked alone, so one
    note's failure is no other's.
    """

    def vectors(texts: list[str]) -> list | None:
        got = client.embed(texts)
        return got if len(got) == len(texts) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, paths, out = b["text"].to_pylist(), b["path"].to_pylist(), [None] * len(b)
            asked = [range(s, min(s + batch, len(texts))) for s in range(0, len(texts), batch)]
            while asked:
                failed: list[list[int]] = []
                for own, got in zip(asked, pooled((lambda own=own: vectors([texts[k] for k in own]) for own in asked), at_once, per_second), strict=True):
                    if isinstance(got, list):
                        for k, v in zip(own, got, strict=True):
                            out[k] = v
                    elif len({paths[k] for k in own}) > 1:
                        failed += [[k for k in own if paths[k] == p] for p in dict.fromkeys(paths[k] for k in own)]
                asked = failed
            yield pa.RecordBatch.from_arrays([b["path"], b["chunk"], pa.array(out, pa.list_(pa.float64()))], names=["path", "chunk", "v"])

    made = chunks.select("path", F.col("chunk").cast("int").alias("chunk"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "path string, chunk int, v array<double>")
    failed = F.max(F.col("v").isNull()).over(Window.partitionBy("path"))
    return made.withColumn("__failed", failed).where("not __failed").drop("__failed")


def prompt(body: Column, tag_limit: int = 3, concept_limit: int = 4, controlled: list[str] | None = None, allow_free: bool = True) -> Column:
    """What the model is asked about a note."""
    rules = ["- Tags: short broad themes of the note, kebab-case, one to three words each."]
    if controlled:
        rules.append("- Prefer tags of this list: " + ", ".join(controlled))
        if not allow_free:
            rules.append("- Use no tag outside the list.")
    head = f"Answer with one JSON object and nothing else. Keys: summary (one or two sentences), tags (up to {tag_limit}), concepts (up to {concept_limit} noun phrases).\n" + "\n".join(rules) + "\n\nNote:\n"
    return F.concat(F.lit(head), strip(body))


def extract_metadata(notes: DataFrame, client: Client, at_once: int = 4, per_second: float | None = None, **limits) -> DataFrame:
    """relpath, summary, tags, concepts, error of notes (relpath, body). Answers that fail, or hold no JSON object, give an error and nulls.

    A task has at_once requests open and begins per_second in a second at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(pooled((lambda p=p: client.chat(p) for p in b["prompt"].to_pylist()), at_once, per_second))
            said = [None if isinstance(x, Exception) else x for x in got]
            error = [str(x) if isinstance(x, Exception) else None for x in got]
            yield pa.RecordBatch.from_arrays([b["relpath"], pa.array(said, pa.string()), pa.array(error, pa.string())], names=["relpath", "said", "error"])

    asked = notes.select("relpath", prompt(F.coalesce("body", F.lit("")), **limits).alias("prompt"))
    said = asked.mapInArrow(run, "relpath string, said string, error string")
    whole = salvaged_json(F.col("said"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(whole)), F.lit("OBJECT")), F.lit(False))
    row = F.from_json(F.when(is_object, whole), "summary string, tags array<string>, concepts array<string>")
    error = F.coalesce("error", F.when(~is_object, F.lit("MODEL_INVALID_RESPONSE")))
    none = F.array().cast("array<string>")
    field = lambda name, value: F.when(error.isNull(), F.coalesce(row[name], value)).alias(name)
    return said.select("relpath", field("summary", F.lit("")), field("tags", none), field("concepts", none), error.alias("error"))
