"""Quality metrics of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def first_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Qrels (query_id, files, ...) with the 1-based rank of the first hit (query_id, rank, file) of an expected file, or null."""
    expected = qrels.select("query_id", F.explode("files").alias("file")).distinct()
    found = hits.join(expected, ["query_id", "file"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return qrels.join(found, "query_id", "left")


def metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N, MRR and recall at 1, 3, 5 and 10; misses count as 0."""
    recall = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in KS]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"), *recall)


def symbol_hit_rate(rows: DataFrame) -> DataFrame:
    """Share of labelled rows whose first hit bears the symbol, alone or as a qualified tail."""
    hit = (F.col("name") == F.col("symbol")) | F.endswith("name", F.concat(F.lit("::"), "symbol"))
    return rows.filter("symbol is not null").agg(F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 4).alias("symbol_hit_rate"))


def latency(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Median, and the element at index ``min(n - 1, int(.95 n))`` in order."""
    ordered = F.array_sort(F.collect_list(column))
    at = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * 0.95).cast("int"))
    return rows.groupBy(*(by or [])).agg(F.median(column).alias("p50"), F.get(ordered, at).alias("p95"))


def spread(runs: DataFrame) -> DataFrame:
    """A10: median and range of each metric over repeated runs (metric, value)."""
    return runs.groupBy("metric").agg(F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def unstable(runs: DataFrame) -> DataFrame:
    """Queries whose rank differs between runs (query_id, run, rank); a miss sorts as 99."""
    ranks = F.array_sort(F.collect_set(F.coalesce("rank", F.lit(99).cast("long"))))
    return runs.groupBy("query_id").agg(ranks.alias("ranks")).filter(F.size("ranks") > 1)


def against_baseline(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of each metric against a baseline, and whether it lies within the baseline's range."""
    old = baseline.select("metric", F.col("median").alias("before"), "low", "high")
    both = now.select("metric", F.col("median").alias("after")).join(old, "metric")
    return both.select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"), F.col("after").between(F.col("low"), F.col("high")).alias("within_spread"))


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """The exponentially weighted mean of a series, as an ordered fold."""
    series = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    fold = F.aggregate(F.slice(series, 2, F.size(series)), F.get(series, 0), lambda acc, v: (1 - alpha) * acc + alpha * v)
    return rows.groupBy(*by).agg(fold.alias("ewma"))
