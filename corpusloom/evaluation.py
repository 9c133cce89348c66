"""Retrieval quality from a file of queries."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .engine import Engine
from .functions.code_text import modality
from .operators import evaluate

QUERIES = "query_id int, q string, category string, files array<string>, symbol string, lang string, path string"
ROWS = "run int, query_id int, rank int, file string, name string, dense_score double, sparse_score double, elapsed_ms long"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """``[[query]]`` tables with q and files; the category defaults to ``other``."""
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("query", [])
    if not rows:
        raise ValueError("no [[query]] in the file")
    out = []
    for i, r in enumerate(rows):
        if not r.get("q") or not r.get("files"):
            raise ValueError(f"query {i} needs q and files")
        out.append((i, r["q"], r.get("category", "other"), list(r["files"]), r.get("symbol"), r.get("lang"), r.get("path")))
    return spark.createDataFrame(out, QUERIES)


def run(engine: Engine, queries: DataFrame, runs: int = 1, limit: int = 10, rerank: bool = True) -> DataFrame:
    """Hits of every query and run, ranks from 1; a query without hits has one row with a null rank.

    Queries of an evaluation set are few and are searched one after the other, so that
    their latency means something.
    """
    rows: list[tuple] = []
    for n in range(runs):
        for q in queries.orderBy("query_id").collect():
            found = engine.search(q["q"], limit, q["lang"], q["path"], rerank)
            hits = [(n, q["query_id"], i, h["file"], h["name"], h["dense_score"], h["sparse_score"], found.elapsed_ms) for i, h in enumerate(found.hits, 1)]
            rows += hits or [(n, q["query_id"], None, None, None, None, None, found.elapsed_ms)]
    return engine.spark.createDataFrame(rows, ROWS)


def judged(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """For each run and query the first hit of an expected file: rank, name, how it was found."""
    expected = queries.select("query_id", "category", "symbol", F.explode("files").alias("file"))
    first = F.min_by(F.struct("rank", "name", modality(F.col("dense_score"), F.col("sparse_score")).alias("found_via")), "rank")
    good = hits.join(expected, ["query_id", "file"]).groupBy("run", "query_id").agg(first.alias("h"))
    asked = hits.groupBy("run", "query_id").agg(F.max("elapsed_ms").alias("elapsed_ms"))
    rows = asked.join(queries.select("query_id", "category", "symbol"), "query_id").join(good, ["run", "query_id"], "left")
    return rows.select("run", "query_id", "category", "symbol", "elapsed_ms", "h.rank", "h.name", "h.found_via")


def report(rows: DataFrame) -> dict[str, Any]:
    """Metrics of each run, by category and by leg, their spread over runs and the queries that wander."""
    per_run = [r.asDict() for r in evaluate.metrics(rows, ["run"]).orderBy("run").collect()]
    times = {r["run"]: r for r in evaluate.latency(rows, "elapsed_ms", ["run"]).collect()}
    for r in per_run:
        r |= {"p50": times[r["run"]]["p50"], "p95": times[r["run"]]["p95"]}
    long = [(r["run"], k, float(v)) for r in per_run for k, v in r.items() if k not in ("run", "n")]
    spread = evaluate.spread(rows.sparkSession.createDataFrame(long, "run int, metric string, value double"))
    return {
        "runs": per_run,
        "spread": {r["metric"]: {"median": r["median"], "low": r["low"], "high": r["high"]} for r in spread.collect()},
        "categories": [r.asDict() for r in evaluate.metrics(rows, ["category"]).orderBy("category").collect()],
        "found_via": {r["found_via"]: r["n"] for r in rows.groupBy(F.coalesce("found_via", F.lit("missed")).alias("found_via")).agg(F.count("*").alias("n")).collect()},
        "symbol_hit_rate": evaluate.symbol_hit_rate(rows).first()["symbol_hit_rate"],
        "unstable": [r["query_id"] for r in evaluate.unstable(rows.withColumn("rank", F.col("rank").cast("long"))).orderBy("query_id").collect()],
    }


def compare(now: dict[str, Any], baseline: dict[str, Any]) -> list[dict[str, Any]]:
    """Change of each metric's median against a baseline's, and whether it lies within the baseline's range."""
    out = []
    for metric, new in now["spread"].items():
        old = baseline["spread"].get(metric)
        if old:
            out.append({"metric": metric, "before": old["median"], "after": new["median"], "delta": new["median"] - old["median"], "within_spread": old["low"] <= new["median"] <= old["high"]})
    return out


def evaluate_set(engine_of: Callable[[Config], Engine], config: Config, path: str, sweep: dict[str, list] | None = None, repeat: int = 1, limit: int = 10, rerank: bool = True, out: str | None = None, baseline: str | None = None) -> list[dict[str, Any]]:
    """One report for the configuration, or for each value of one search knob; written as JSON where ``out`` names a file."""
    knobs = [(k, v) for k, values in (sweep or {}).items() for v in values] or [(None, None)]
    reports = []
    for knob, value in knobs:
        settings = config if knob is None else replace(config, search=replace(config.search, **{knob: value}))
        engine = engine_of(settings)
        queries = load_queries(engine.spark, path)
        got = report(judged(run(engine, queries, repeat, limit, rerank), queries)) | {"knob": knob, "value": value}
        if baseline:
            with open(baseline) as f:
                got["against"] = compare(got, json.load(f)[0])
        reports.append(got)
    if out:
        with open(out, "w") as f:
            json.dump(reports, f, indent=2)
    return reports
