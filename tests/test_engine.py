import io
import json

import pytest

from corpusloom import cli, config
from corpusloom.engine import Engine
from corpusloom.operators.models import Batcher, HashEmbedder, ModelError, embed_all
from corpusloom.operators.retrieval import token_overlap
from corpusloom.operators.store import MarkerError
from corpusloom.server import Server, render_chunks
from corpusloom.sources.policy import IgnoreRules
from corpusloom.sources.project import path_filter, walk
from corpusloom.streaming import watch as W

TOML = """
[project]
id = "my project"
root = "{root}"
[index]
exclude = ["skipme/"]
[embedding]
url = ""
model = "hash"
dimensions = 32
[vector_store]
[bm25]
index_path = "{store}"
[watcher]
[chunking]
strategy = "tree-sitter"
[chunking.per_language.markdown]
strategy = "headings"
[serve]
query_log_path = "{log}"
"""


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "p"
    (root / "src" / "deep").mkdir(parents=True)
    (root / "skipme").mkdir()
    (root / ".hid").mkdir()
    (root / "src" / "__init__.py").write_text("def load_config(path):\n    return open(path).read()\n")
    (root / "src" / "deep" / "q.go").write_text("package q\n\nfunc (s *Store) PruneCache(n int) error {\n\treturn nil\n}\n")
    (root / "README.md").write_text("# Title\n\nAbout caches.\n\n## Usage\n\nRun it.\n")
    (root / "bin.dat").write_bytes(b"x")
    (root / "nul.txt").write_bytes(b"a\0b")
    (root / "skipme" / "a.py").write_text("x = 1\n")
    (root / ".hid" / "b.py").write_text("x = 1\n")
    (root / "ig.log").write_text("x\n")
    (root / ".gitignore").write_text("*.log\n")
    path = tmp_path / "c.toml"
    path.write_text(TOML.format(root=root, store=tmp_path / "store", log=tmp_path / "log" / "q.jsonl"))
    return root, path, tmp_path


def test_index_search_watch_and_status(spark, project):
    root, path, tmp = project
    c = config.load(str(path))
    engine = Engine(spark, c, reranker=token_overlap)
    assert engine.index() == {"new": 3, "changed": 0, "removed": 0, "unchanged": 0}
    assert engine.index()["unchanged"] == 3 and engine.store.version == 1
    found = engine.search("how to load the config")
    assert found.hits[0]["name"] == "load_config" and found.reranked == "Applied"
    assert engine.search("PruneCache").reranked == "SkippedSymbolQuery"
    assert engine.search("PruneCache", rerank=False).hits[0]["name"] == "Store.PruneCache"
    assert {h["file"] for h in engine.search("cache", lang="markdown").hits} <= {"README.md"}
    assert {h["file"] for h in engine.search("cache", path="src/").hits} <= {"src/__init__.py", "src/deep/q.go"}
    assert [h["start_line"] for h in engine.read_chunks("README.md")] == [1, 5]
    assert [h["start_line"] for h in engine.read_chunks("README.md", 6, 6)] == [5]
    assert len((tmp / "log" / "q.jsonl").read_text().splitlines()) == 5

    (root / "src" / "deep" / "q.go").unlink()
    (root / "src" / "deep").rmdir()
    (root / "README.md").write_text("# Title\n\nAbout caches.\n\n## Usage\n\nRun it twice.\n")
    (root / "new.py").write_text("def fresh():\n    pass\n")
    events = tmp / "events"
    events.mkdir()
    (events / "1.json").write_text("\n".join(json.dumps({"path": p, "ts": "2026-01-01T00:00:00"}) for p in ("src/deep", "README.md", "new.py", "new.py", ".", "skipme/a.py")))
    before = {r.chunk_id for r in engine.store.chunks().collect()}
    W.apply_batch(engine, spark.read.schema(W.EVENTS).json(str(events)))
    rows = engine.store.chunks().collect()
    assert {r.file for r in rows} == {"src/__init__.py", "README.md", "new.py"} and all(len(r.embedding) == 32 for r in rows)
    assert len(before & {r.chunk_id for r in rows}) == 2  # what didn't change keeps its id
    version = engine.store.version
    W.watch(engine, str(events), str(tmp / "ck"), once=True).awaitTermination()
    assert engine.store.version == version  # a replay changes nothing
    status = engine.status()
    assert status["marker"] == "Match" and status["drift"] == 0 and status["files"] == 3
    assert all(ok for _, ok, _ in engine.check())

    harder = Engine(spark, config.Config(**{**c.__dict__, "dimensions": 16}))
    with pytest.raises(MarkerError):
        harder.search("x")
    harder.index()
    assert harder.store.version == 1 and len(harder.store.chunks().first().embedding) == 16
    with pytest.raises(MarkerError):
        Engine(spark, config.Config(**{**c.__dict__, "project_id": "other"})).index()
    with pytest.raises(ValueError):
        harder.store.clear()
    harder.store.clear(confirm=True)
    assert harder.store.version == 0


def test_walk_and_ignore_rules(project):
    root, *_ = project
    rules = path_filter(str(root), exclude=["skipme/"])
    assert {p for p, *_ in walk(rules)} == {"README.md", "nul.txt", "src/__init__.py", "src/deep/q.go"}
    assert rules.check("src/__init__.py") and not rules.check("ig.log") and not rules.check("src") and not rules.check(".hid/b.py")
    ignore = IgnoreRules({"": "*.log\n!keep.log\n/build\ndocs/*.txt\nlogs/\na/**/z\n", "sub": "only.py\n"})
    for path, want in {"x/y.log": True, "x/keep.log": False, "build/a": True, "x/build": False, "docs/a.txt": True, "docs/x/a.txt": False, "logs/a": True, "x/logs/a": True, "a/b/c/z": True, "a/z": True, "sub/only.py": True, "only.py": False}.items():
        assert ignore.ignores(path) == want, path


def test_config_fingerprints(project):
    _, path, _ = project
    c = config.load(str(path))
    assert c.collection_name.startswith("my_project_") and c.search.rrf_k == 60 and c.chunking.of("go").strategy == "tree-sitter" and c.chunking.of("zig").strategy == "lines"
    other = config.Config(**{**c.__dict__, "languages": ["go"]})
    assert other.hard_fingerprint == c.hard_fingerprint and other.soft_fingerprint != c.soft_fingerprint
    path.write_text("[project]\nid = 'a'\nroot = '/'\n")
    with pytest.raises(ValueError):
        config.load(str(path))


def test_batcher_and_adaptive_embedding():
    b = Batcher(10)
    assert b.budget == 1024 and Batcher(10**9).budget == 256_000
    for _ in range(5):
        b.success(1000, 0.1)
    assert b.budget == 1280 and 15 <= b.timeout(0) <= 270
    before = b.limit
    b.failure(1200, 60)
    assert b.limit < before and b.limit <= 600 and b.rate == 20
    assert b.pack(["x" * 5000, "y"], 0) == 1
    calls = []

    def embed(texts, timeout):
        calls.append(len(texts))
        if sum(map(len, texts)) > 900:
            raise ModelError("input is too large")
        return HashEmbedder(8)(texts)

    out = embed_all(["a" * 300] * 6 + ["b" * 5000] + ["c"], embed, Batcher(1024))
    assert [v is None for v in out] == [False] * 6 + [True, False] and max(calls) > 1
    with pytest.raises(ModelError):
        embed_all(["a"], lambda t, s: (_ for _ in ()).throw(ModelError("connection refused")), Batcher(), wait=lambda: True)
    assert ModelError("HTTP 503").kind == "Ambiguous" and ModelError("?").kind == "PermanentBad"


def test_server_shapes():
    class Fake:
        def search(self, query, limit, lang, path):
            raise RuntimeError("no index")

        def read_chunks(self, file, start, end):
            return [{"file": file, "start_line": 1, "end_line": 2, "lang": "go", "name": None, "content": "x  y"}] if file == "a" else []

    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}, {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "nope"}, {"jsonrpc": "2.0", "id": 4, "method": "ping"},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "code_search", "arguments": {"query": "x"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "code_read_chunk", "arguments": {"file": "a"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "code_read_chunk", "arguments": {"file": "a", "start_line": 3, "end_line": 2}}},
    ]
    out = io.StringIO()
    Server(Fake()).run(io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nnot json\n[]\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines()) if r["id"]}
    errors = sorted(r["error"]["code"] for r in map(json.loads, out.getvalue().splitlines()) if r["id"] is None)
    assert errors == [-32700, -32600]
    assert got[1]["result"]["protocolVersion"] == "2024-11-05" and len(got[2]["result"]["tools"]) == 2 and got[3]["error"]["code"] == -32601 and got[4]["result"] == {}
    assert got[5]["result"]["isError"] and "x  y" in got[6]["result"]["content"][0]["text"] and got[7]["error"]["code"] == -32602
    text = render_chunks([{"file": "a", "start_line": i, "end_line": i, "lang": "go", "content": "z" * 15} for i in range(3)], 20)
    assert text.count("z") == 20 and "omitted" in text and "NOTE" in text
    assert "dense=" not in cli.format_hit(1, {"file": "a", "start_line": 1, "end_line": 2, "lang": "go", "score": 0.5, "dense_score": None, "preview": " a \n b"})
