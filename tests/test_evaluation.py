import json

import pytest
from pyspark.sql import functions as F

from corpusloom import evaluation
from corpusloom.functions import code_text as T
from corpusloom.operators import changes, evaluate
from corpusloom.streaming.watch import debounced

SET = """
[[query]]
q = "a"
files = ["x.py", "y.py"]
symbol = "load"
category = "symbol"
[[query]]
q = "b"
files = ["z.py"]
[[query]]
q = "c"
files = ["w.py"]
category = "symbol"
symbol = "run"
"""


class FakeOutcome:
    def __init__(self, hits):
        self.hits, self.elapsed_ms = hits, 7


class FakeEngine:
    def __init__(self, spark):
        self.spark, self.n = spark, 0

    def search(self, q, limit, lang, path, rerank):
        self.n += 1
        hit = lambda f, n, d=0.5, s=None: {"file": f, "name": n, "dense_score": d, "sparse_score": s}
        wander = [hit("o", "o")] if self.n > 3 else []
        return FakeOutcome({"a": [hit("o", "o"), hit("y.py", "K::load", 0.5, 2.0)], "b": [*wander, hit("z.py", None, None, 1.0)], "c": []}[q])


def test_report_sweep_and_baseline(spark, tmp_path):
    path = tmp_path / "q.toml"
    path.write_text(SET)
    queries = evaluation.load_queries(spark, str(path))
    got = evaluation.report(evaluation.judged(evaluation.run(FakeEngine(spark), queries, 2), queries))
    assert [r["mrr"] for r in got["runs"]] == [0.5, 0.3333] and got["runs"][0]["recall_1"] == 0.3333 and got["runs"][0]["recall_3"] == 0.6667
    assert got["spread"]["mrr"]["low"] == 0.3333 and got["unstable"] == [1] and got["symbol_hit_rate"] == 0.5
    assert got["found_via"] == {"both": 2, "sparse": 2, "missed": 2}
    assert {c["category"]: c["n"] for c in got["categories"]} == {"symbol": 4, "other": 2}
    worse = {"spread": {"mrr": {"median": 0.6, "low": 0.55, "high": 0.65}}}
    assert evaluation.compare(got, worse)[0]["within_spread"] is False
    path.write_text("[[query]]\nq = 'a'\n")
    with pytest.raises(ValueError):
        evaluation.load_queries(spark, str(path))


@pytest.mark.parametrize(
    "text, want",
    [("HTTPServer", ["http", "server"]), ("bm25", ["bm25"]), ("__init__", ["init"]), ("____", []), ("parseHTMLDoc_v2", ["parse", "html", "doc", "v2"]), ("a" * 41 + " b", ["b"]), ("über_Straße", ["über", "straße"]), ("", [])],
)
def test_tokens(spark, text, want):
    assert spark.range(1).select(T.code_tokens(F.lit(text)).alias("t")).first()["t"] == want


def test_symbols_and_uuid(spark):
    import uuid

    one = spark.range(1)
    named = lambda q, n: one.select(T.query_names_symbol(F.lit(q), F.lit(n)).alias("x")).first()["x"]
    assert named("fix Store::open now", "Store::open") and named("load_file", "Reader.load_file") and named("Reader", "Reader")
    assert not named("open the file", "Store::open") and not named("reader", "Reader") and not named("load", "load_file")
    assert one.select(T.uuid5(F.lit("a|1-2|é")).alias("u")).first()["u"] == str(uuid.uuid5(uuid.NAMESPACE_OID, "a|1-2|é"))


def test_metrics_and_changes_on_empty_tables(spark):
    rows = spark.createDataFrame([], "query_id int, rank int, category string")
    assert evaluate.metrics(rows).first()["n"] == 0
    files = spark.createDataFrame([], "file string, file_sha256 string")
    assert changes.manifest_diff(files, files).count() == 0 and changes.vanished(files, spark.createDataFrame([("a",)], "path string")).count() == 0
    tracked = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a/b",), ("x",)], "file string")
    assert {r.file for r in changes.vanished(tracked, spark.createDataFrame([("a/b",), ("",), (None,)], "path string")).collect()} == {"a/b/c", "a/b"}


def test_debounce_in_a_stream(spark, tmp_path):
    folder = tmp_path / "e"
    folder.mkdir()
    times = ["00:00:00.000", "00:00:00.300", "00:00:02.000", "00:01:00.000"]
    (folder / "1.json").write_text("\n".join(json.dumps({"path": "a", "ts": f"2026-01-01T{t}"}) for t in times))
    stream = spark.readStream.schema("path string, ts timestamp").json(str(folder))
    query = debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("bursts").collect()) == [1, 2]
