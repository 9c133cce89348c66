"""Configuration from TOML (S12) and the fingerprints that decide on rebuilds."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .operators.chunk import ChunkRule, ChunkRules
from .operators.retrieval import SearchSettings

INDEX_SCHEMA, CHUNKER = 3, 1
SECTIONS = ("project", "index", "embedding", "vector_store", "bm25", "watcher", "chunking")


@dataclass(frozen=True)
class Config:
    """Every knob, with defaults where a section may leave it out."""

    project_id: str
    root: str
    languages: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    exclude: list[str] = field(default_factory=list)
    embedding_url: str = ""
    embedding_model: str = ""
    dimensions: int = 64
    embedding_timeout: int = 300
    startup_wait: int = 300
    max_input_chars: int = 10_000
    store_path: str = ""
    collection: str = ""
    reranker_enabled: bool = True
    reranker_url: str = ""
    reranker_timeout: int = 120
    max_document_chars: int = 8000
    watcher_enabled: bool = True
    debounce_ms: int = 500
    chunking: ChunkRules = ChunkRules()
    search: SearchSettings = SearchSettings()
    query_log_path: str | None = None

    @property
    def collection_name(self) -> str:
        """the given name, or one derived from project and root."""
        if self.collection.strip():
            return self.collection.strip()
        slug = re.sub(r"[^A-Za-z0-9_-]+", "_", self.project_id)
        return f"{slug}_{self.project_fingerprint[:8]}"

    @property
    def project_fingerprint(self) -> str:
        """F14."""
        return hashlib.sha256(f"{self.project_id}\0{self.root}".encode()).hexdigest()

    @property
    def hard_fingerprint(self) -> str:
        """what an index cannot survive a change of."""
        rules = {"default": asdict(self.chunking.default), **{k: asdict(v) for k, v in sorted(self.chunking.per_language.items())}}
        return _digest({"chunking": rules, "model": self.embedding_model, "dimensions": self.dimensions, "index_schema": INDEX_SCHEMA, "chunker": CHUNKER})

    @property
    def soft_fingerprint(self) -> str:
        """what changes only which files belong to the index."""
        return _digest({"languages": sorted(self.languages), "exclude": sorted(self.exclude), "gitignore": self.respect_gitignore})


def _digest(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def load(path: str) -> Config:
    """Read and check a configuration file; the project root must exist."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    missing = [s for s in SECTIONS if s not in raw]
    if missing:
        raise ValueError(f"missing sections: {', '.join(missing)}")
    project, index, emb, store, chunk = (raw[s] for s in ("project", "index", "embedding", "vector_store", "chunking"))
    root = Path(os.path.expandvars(os.path.expanduser(project["root"])))
    if not root.exists():
        raise ValueError(f"project root {root} does not exist")
    sizes = {"max_chunk_lines": 80, "overlap_lines": 15, "max_chunk_chars": 20_000} | {k: v for k, v in chunk.items() if k not in ("per_language", "strategy")}
    rule = lambda d: ChunkRule(d["strategy"], d["max_chunk_lines"], d["overlap_lines"], d["max_chunk_chars"])
    base = {"strategy": chunk["strategy"], **sizes}
    default = ChunkRule("lines", base["max_chunk_lines"], base["overlap_lines"], base["max_chunk_chars"]) if base["strategy"] == "tree-sitter" else rule(base)
    from .operators import syntax

    per = {lang: rule(base | over) for lang, over in chunk.get("per_language", {}).items()}
    if base["strategy"] == "tree-sitter":
        per = {lang: rule(base) for lang in syntax.LANGUAGES} | per
    rerank, search = raw.get("reranker", {}), raw.get("search", {})
    return Config(
        project_id=project["id"], root=str(root.resolve()), languages=list(index.get("languages", [])), respect_gitignore=index.get("respect_gitignore", True), exclude=list(index.get("exclude", [])),
        embedding_url=emb["url"], embedding_model=emb["model"], dimensions=int(emb["dimensions"]), embedding_timeout=emb.get("timeout_secs", 300), startup_wait=emb.get("startup_wait_secs", 300), max_input_chars=emb.get("max_input_chars", 10_000),
        store_path=str(raw["bm25"].get("index_path", store.get("path", ""))), collection=store.get("collection", ""),
        reranker_enabled=rerank.get("enabled", True), reranker_url=rerank.get("url", ""), reranker_timeout=rerank.get("timeout_secs", 120), max_document_chars=rerank.get("max_document_chars", 8000),
        watcher_enabled=raw["watcher"].get("enabled", True), debounce_ms=raw["watcher"].get("debounce_ms", 500), chunking=ChunkRules(default, per),
        search=SearchSettings(**{k: search[k] for k in ("dense_k", "sparse_k", "rerank_top_n", "rrf_k", "rerank_weight", "symbol_boost") if k in search}), query_log_path=raw.get("serve", {}).get("query_log_path"),
    )
