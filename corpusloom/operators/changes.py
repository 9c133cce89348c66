"""Snapshots and their differences as joins (J3-J8, P5, U2-U4, K2, K4, K5, ST2-ST4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, status) with new, changed, unchanged or removed; both sides have (file, file_sha256)."""
    old = manifest.select("file", F.col("file_sha256").alias("old"))
    both = files.select("file", F.col("file_sha256").alias("new")).join(old, "file", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("file", status.alias("status"))


def stale(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Known files that a walk did not see."""
    return manifest.select("file").distinct().join(seen.select("file"), "file", "left_anti")


def intersection(manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    """Manifest rows of files that the other store holds as well."""
    return manifest.join(indexed.select("file"), "file", "left_semi")


def drift(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(file, only_in) of files that only one store holds."""
    a, b = dense.select("file").distinct(), sparse.select("file").distinct()
    left = a.join(b, "file", "left_anti").withColumn("only_in", F.lit("dense"))
    return left.unionByName(b.join(a, "file", "left_anti").withColumn("only_in", F.lit("sparse")))


def reuse_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """New chunks with the old vector of equal content in the same file; null must be embedded."""
    old = vectors.groupBy("file", "chunk_sha").agg(F.max_by("embedding", "chunk_id").alias("embedding"))
    return chunks.join(old, ["file", "chunk_sha"], "left")


def upsert(table: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """K2, K3: rows replace those of equal key; repeated new rows count once."""
    fresh = rows.dropDuplicates([key])
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def delete(table: DataFrame, keys: DataFrame, key: str = "file") -> DataFrame:
    """K4, K5: rows whose key is not among the deleted ones."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def vanished(tracked: DataFrame, paths: DataFrame) -> DataFrame:
    """Tracked files that vanish with the given paths: the path itself, or everything below it.

    Every tracked file is exploded into itself and its ancestors, which turns the prefix
    test into an equi join; whole path components must agree.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = tracked.select("file").distinct().select("file", F.explode(above).alias("path"))
    return rows.join(paths.select("path").filter("path <> ''").distinct(), "path", "left_semi").select("file").distinct()


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """ST3, U4: the last event of every key, whatever came before it."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return events.groupBy(key).agg(last).select(key, "s.*")


def debounce(events: DataFrame, by: list[str], ts: str, seconds: float) -> DataFrame:
    """ST2, W8: (by, session, first, last, n): runs of events no further apart than a quiet period."""
    order = Window.partitionBy(*by).orderBy(ts)
    gap = (F.col(ts).cast("double") - F.lag(ts).over(order).cast("double")) > seconds
    marked = events.withColumn("session", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def pack(rows: DataFrame, by: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Greedy batches of at most ``budget`` bytes, at least one item each, as a fold over each group in order."""
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{rows.schema[order].dataType.simpleString()},batch:int>>").alias("out"))

    def step(acc, x):
        fresh = (acc["batch"] < 0) | (acc["used"] + x["s"] > budget)
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(fresh, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), F.array_append(acc["out"], F.struct(x["o"].alias("o"), batch.alias("batch"))).alias("out"))

    folded = rows.groupBy(*by).agg(F.aggregate(items, start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select(*by, F.explode("out").alias("e")).select(*by, F.col("e.o").alias(order), F.col("e.batch").alias("batch"))
