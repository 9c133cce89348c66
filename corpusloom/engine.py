
from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import code_text
from .operators import changes, retrieval
from .operators.chunk import chunk_files
from .operators.models import Embedder, HashEmbedder, ModelError, embed_rows
from .operators.store import Store
from .sources.project import read_project

Progress = Callable[[int, str], None]
COLUMNS = ["file", "start_line", "end_line", "lang", "kind", "name", "score", "dense_score", "sparse_score", "rerank_score", "preview"]


@dataclass(frozen=True)
class Outcome:
    """Hits, and what became of the reranker: Applied, NotRequested, SkippedSymbolQuery or Failed."""

    hits: list[dict]
    reranked: str
    elapsed_ms: int


class Engine:
    """One project's index. The embedder and the reranker are pluggable; without servers, local stand-ins serve."""

    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None, reranker: Callable[[str], Callable] | None = None) -> None:
        self.spark, self.config = spark, config
        self.store = Store(spark, config.store_path or os.path.join(config.root, ".corpusloom", config.collection_name))
        self.embedder = embedder or HashEmbedder(config.dimensions)
        self.reranker = reranker

    def files(self) -> DataFrame:
        c = self.config
        return read_project(self.spark, c.root, c.languages, c.exclude, c.respect_gitignore)

    def index(self, progress: Progress = lambda n, what: None) -> dict[str, int]:
        """Bring the store up to the project's files: only new and changed ones are cut, only new contents embedded."""
        progress(1, "walk")
        self.store.prepare(self.config)
        return self.apply(self.files(), None, progress)

    def apply(self, files: DataFrame, removed: DataFrame | None, progress: Progress = lambda n, what: None) -> dict[str, int]:
        """Apply a snapshot (``removed`` is None: files not in it are gone) or a set of changes."""
        files = files.select("file", "lang", "text", "file_sha256").persist()
        old = self.store.chunks()
        diff = changes.manifest_diff(files, old.select("file", "file_sha256").dropDuplicates(["file"]))
        if removed is not None:
            gone = removed.select("file").withColumn("status", F.lit("removed"))
            diff = diff.filter("status in ('new', 'changed', 'unchanged')").unionByName(gone)
        diff = diff.persist()
        try:
            counts = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
            if not counts.get("new") and not counts.get("changed") and not counts.get("removed"):
                return {"new": 0, "changed": 0, "removed": 0, "unchanged": counts.get("unchanged", 0)}
            progress(2, "chunk")
            fresh = files.join(diff.filter("status in ('new', 'changed')"), "file", "left_semi")
            cut = chunk_files(fresh, self.config.chunking).join(fresh.select("file", "lang", "file_sha256"), "file")
            cut = cut.withColumn("chunk_sha", code_text.sha256_hex(F.col("text"))).withColumnRenamed("text", "content")
            cut = cut.withColumn("chunk_id", code_text.chunk_uuid(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("chunk_sha"))).dropDuplicates(["chunk_id"])
            progress(3, "embed")
            known = changes.reuse_vectors(cut, old.filter("embedding is not null").select("file", "chunk_sha", "chunk_id", "embedding"))
            known = known.persist()
            done = known.filter("embedding is not null")
            todo = embed_rows(known.filter("embedding is null").drop("embedding"), self.embedder, hint=self.config.max_input_chars)
            kept = changes.delete(old, diff.filter("status in ('changed', 'removed')"))
            progress(4, "commit")
            self.store.commit(kept.unionByName(done.select(old.columns)).unionByName(todo.select(old.columns)))
            known.unpersist()
            return {k: counts.get(k, 0) for k in ("new", "changed", "removed", "unchanged")}
        finally:
            files.unpersist()
            diff.unpersist()

    def search(self, query: str, limit: int = 10, lang: str | None = None, path: str | None = None, rerank: bool = True, progress: Progress = lambda n, what: None) -> Outcome:
        """Both legs, their fusion, and the reranker's votes; a reranker that fails leaves the fused order."""
        began = time.monotonic()
        limit = min(max(limit, 1), 50)  # R14
        settings = self.config.search
        self.store.check_readable(self.config)
        progress(1, "embed query")
        vector = self.embedder([query], 30.0)[0]
        chunks = self.store.chunks().withColumn("name", F.col("name"))
        asked = self.spark.createDataFrame([(vector,)], "q array<double>")
        progress(2, "retrieve")
        dense = retrieval.dense(chunks, asked, retrieval.depth(settings.dense_k, path), self.config.dimensions, lang)
        sparse = retrieval.bm25(self.store.postings(), query, retrieval.depth(settings.sparse_k, path), chunks, lang)
        merged = retrieval.merge(chunks.drop("embedding"), dense, sparse, query, settings, path, lang).persist()
        try:
            want, outcome = rerank and self.reranker is not None and self.config.reranker_enabled, "NotRequested"
            if want and not merged.take(1):
                want = False
            elif want and retrieval.skip_rerank(merged, query):
                want, outcome = False, "SkippedSymbolQuery"
            progress(3, "rerank")
            rows = None
            if want:
                try:
                    rows = retrieval.head_and_tail(merged, self.reranker(query), settings, limit, self.config.max_document_chars).select(COLUMNS).collect()
                    outcome = "Applied"
                except (ModelError, OSError):
                    outcome = "Failed"
            if rows is None:
                rows = retrieval.head_and_tail(merged, None, settings, limit).select(COLUMNS).collect()
        finally:
            merged.unpersist()
        progress(4, "done")
        found = Outcome([r.asDict() for r in rows], outcome, int((time.monotonic() - began) * 1000))
        self._log(query, lang, path, limit, found)
        return found

    def read_chunks(self, file: str, start: int | None = None, end: int | None = None) -> list[dict]:
        """Chunks of a file by lines."""
        self.store.check_readable(self.config)
        return [r.asDict() for r in retrieval.read_chunks(self.store.chunks().drop("embedding"), file, start, end).collect()]

    def status(self) -> dict:
        """X2."""
        drift = changes.drift(self.store.chunks().filter("embedding is not null"), self.store.postings().lengths.join(self.store.chunks().select("chunk_id", "file"), "chunk_id"))
        return {"collection": self.config.collection_name, "marker": self.store.status(self.config), "version": self.store.version, **self.store.counts(), "drift": drift.count()}

    def check(self) -> list[tuple[str, bool, str]]:
        """(check, ok, detail)."""
        out = []
        try:
            size = len(self.embedder(["probe"], 30.0)[0])
            out.append(("dimensions", size == self.config.dimensions, f"{size} of {self.config.dimensions}"))
        except ModelError as e:
            out.append(("dimensions", False, str(e)))
        try:
            out.append(("marker", True, self.store.check_readable(self.config)))
        except RuntimeError as e:
            out.append(("marker", False, str(e)))
        if self.reranker is not None:
            df = self.spark.createDataFrame([(0, "read a file from disk"), (1, "colours of the sky")], "i int, content string")
            best = df.select("i", self.reranker("read file")(F.col("content")).alias("s")).orderBy(F.desc("s"), "i").first()
            out.append(("reranker", best["i"] == 0, "prefers the fitting text" if best["i"] == 0 else "prefers the other text"))
        rule = self.config.chunking.default
        out.append(("chunk size", rule.max_bytes <= self.config.max_input_chars * 4, f"{rule.max_bytes} bytes"))
        return out

    def _log(self, query: str, lang: str | None, path: str | None, limit: int, found: Outcome) -> None:
        """One JSON line for each search; a failure to write only loses the line."""
        if not self.config.query_log_path:
            return
        top = [{"file": h["file"], "lines": f"{h['start_line']}-{h['end_line']}", "score": h["score"], "rerank": h["rerank_score"]} for h in found.hits[:3]]
        line = {"ts": int(time.time()), "query": query, "lang": lang, "path": path, "limit": limit, "elapsed_ms": found.elapsed_ms, "results": len(found.hits), "reranked": found.reranked, "top": top}
        try:
            os.makedirs(os.path.dirname(self.config.query_log_path) or ".", exist_ok=True)
            with open(self.config.query_log_path, "a") as f:
                f.write(json.dumps(line) + "\n")
        except OSError:
            pass
