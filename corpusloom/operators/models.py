"""Model servers: embedding with self-tuning batches, reranking, and local stand-ins."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import code_text

LOW, HIGH, GOAL_SECONDS, GROW_AFTER = 1024, 256_000, 30.0, 5
ALPHA, BOOTSTRAP = 0.3, 500.0


class ModelError(Exception):
    """A failed call; the message tells the class."""

    @property
    def kind(self) -> str:
        """F16: WorkloadTooBig, ServerDown, PermanentBad or Ambiguous."""
        text = str(self).lower()
        for name, words in (("WorkloadTooBig", code_text.TOO_BIG), ("ServerDown", code_text.SERVER_DOWN), ("PermanentBad", code_text.PERMANENT), ("Ambiguous", code_text.AMBIGUOUS)):
            if any(w in text for w in words):
                return name
        return "PermanentBad"


class Embedder(Protocol):
    """M1: texts to vectors of equal length, in order."""

    def __call__(self, texts: list[str], timeout: float) -> list[list[float]]: ...


class Batcher:
    """M3: a byte budget that grows by a quarter after five good calls and halves on failure.

    ``chars`` are UTF-8 bytes. A failed batch also sets a ceiling of half its size until
    the next success, so a retry is always smaller.
    """

    def __init__(self, hint: int = 10_000, transport: float = 300.0) -> None:
        self.budget, self.transport = min(max(hint, LOW), HIGH), transport
        self.good, self.rate, self.ceiling = 0, None, None

    @property
    def limit(self) -> int:
        return min(self.budget, self.ceiling) if self.ceiling is not None else self.budget

    def pack(self, texts: list[str], start: int) -> int:
        """The end of the batch that begins at ``start``; at least one text."""
        used, end = 0, start
        while end < len(texts):
            used += len(texts[end].encode())
            if end > start and used > self.limit:
                break
            end += 1
        return end

    def timeout(self, chars: int) -> float:
        high = 0.9 * self.transport
        return min(max(10 + 3 * chars / (self.rate or BOOTSTRAP), min(15, high)), high)

    def success(self, chars: int, seconds: float) -> None:
        self.ceiling = None
        seen = chars / max(seconds, 0.001)
        self.rate = seen if self.rate is None else (1 - ALPHA) * self.rate + ALPHA * seen
        self.good += 1
        cap = int(min(max(self.rate * GOAL_SECONDS, LOW), HIGH))
        if self.good >= GROW_AFTER and self.budget < cap:
            self.budget = min(max(int(self.budget * 1.25), self.budget + 1), cap)
            self.good = 0

    def failure(self, chars: int, seconds: float) -> None:
        self.good = 0
        seen = chars / max(seconds, 0.001)
        self.rate = seen if self.rate is None else min(self.rate, seen)
        half = max(chars // 2, 1)
        self.ceiling = half if self.ceiling is None else min(self.ceiling, half)
        self.budget = max(self.budget // 2, LOW)


def embed_all(texts: list[str], embed: Embedder, batcher: Batcher, wait: Callable[[], bool] = lambda: False, alive: Callable[[], bool] = lambda: True) -> list[list[float] | None]:
    """M2, M5: vectors of all texts; null for those a server will not take alone.

    A batch that fails is halved and tried again; a server that is down is waited for at
    most twice; an ambiguous error counts as down if a probe finds nobody there.
    """
    out: list[list[float] | None] = []
    recoveries = 0
    while len(out) < len(texts):
        end = batcher.pack(texts, len(out))
        batch = texts[len(out) : end]
        chars, began = sum(len(t.encode()) for t in batch), time.monotonic()
        try:
            got = embed(batch, batcher.timeout(chars))
            if len(got) != len(batch):
                raise ModelError("the server returned another number of vectors")
            batcher.success(chars, time.monotonic() - began)
            out += got
            continue
        except ModelError as e:
            kind = e.kind
            if kind == "Ambiguous":
                kind = "WorkloadTooBig" if alive() else "ServerDown"
            if kind == "ServerDown":
                recoveries += 1
                if recoveries > 2 or not wait():
                    raise
                continue
            batcher.failure(chars, time.monotonic() - began)
            if len(batch) == 1:
                out.append(None)
    return out


def embed_rows(chunks: DataFrame, embed: Embedder, text: str = "content", hint: int = 10_000, vector: str = "embedding") -> DataFrame:
    """M1, M2 over a table: a column of vectors, each task with a batcher of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batcher = Batcher(hint)
        for pdf in batches:
            yield pdf.assign(**{vector: embed_all([t or "" for t in pdf[text]], embed, batcher)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, `{vector}` array<float>")


def post_json(url: str, body: dict, timeout: float, attempts: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """M6: POST with up to four attempts, doubling the pause, for transient errors only."""
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            error = ModelError(f"http {e.code}: {e.read()[:200]!r}")
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            error = ModelError(str(getattr(e, "reason", e)))
        if error.kind != "Ambiguous" or attempt == attempts - 1:
            raise error
        sleep(pause * 2**attempt)
    raise ModelError("no attempt was made")


class HttpEmbedder:
    """M1, M4: an OpenAI-style embedding endpoint."""

    def __init__(self, url: str, model: str) -> None:
        self.url, self.model = url, model

    def __call__(self, texts: list[str], timeout: float) -> list[list[float]]:
        if not texts:
            return []
        data = post_json(self.url, {"model": self.model, "input": texts}, timeout, attempts=1)["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]

    def dimensions(self) -> int:
        """M4."""
        return len(self(["probe"], 30.0)[0])

    def wait_until_ready(self, seconds: float, sleep: Callable[[float], None] = time.sleep) -> bool:
        """M4: poll every five seconds."""
        for _ in range(max(1, math.ceil(seconds / 5))):
            try:
                self(["probe"], 10.0)
                return True
            except ModelError:
                sleep(5)
        return False


class HashEmbedder:
    """A deterministic stand-in for a model: tokens hashed into signed places, scaled to unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.size = dimensions

    def __call__(self, texts: list[str], timeout: float = 0) -> list[list[float]]:
        import re

        out = []
        for text in texts:
            v = [0.0] * self.size
            for token in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


class HttpReranker:
    """Scores in input order; a text that is too large is cut further, twice at most."""

    def __init__(self, url: str, model: str = "", max_chars: int = 8000) -> None:
        self.url, self.model, self.max_chars, self.rate = url, model, max_chars, None

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        limit = self.max_chars
        for attempt in range(3):
            texts = [d[:limit] for d in documents]
            chars, began = sum(map(len, texts)), time.monotonic()
            timeout = min(max(30 + 3 * chars / (self.rate or 200.0), 30), 1200)
            try:
                results = post_json(self.url, {"model": self.model, "query": query, "documents": texts}, timeout, attempts=1)["results"]
            except ModelError as e:
                if e.kind == "WorkloadTooBig" and attempt < 2 and limit // 2 >= 512:
                    limit //= 2
                    continue
                raise
            seen = chars / max(time.monotonic() - began, 0.001)
            self.rate = seen if self.rate is None else (1 - ALPHA) * self.rate + ALPHA * seen
            scores: list[float | None] = [None] * len(documents)
            for r in results:
                if not 0 <= r["index"] < len(documents):
                    raise ModelError("the reranker named a document that it was not given")
                scores[r["index"]] = float(r.get("relevance_score", r.get("score", 0.0)))
            return [0.0 if x is None else x for x in scores]  # a document that the server leaves out has no say
        raise ModelError("no attempt was made")
