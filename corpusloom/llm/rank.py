"""Problem 7: one ranking from scores of different scales.

Within each group every score becomes its empirical percentile, ties averaged,
``(average rank - 1/2) / n``; the percentile is mapped through the inverse normal
distribution and the items are ordered by the weighted mean of those values.

A missing or NaN score counts as the lowest present one of its group. A score that
a whole group lacks has no say there. Groups where no score is present keep all
items at mean 0. Items whose means agree to nine places are ordered by key. Rows repeated under
one (group, key) count once, with the largest of each score. Rows with a null
group or key are left out. Only the named columns are read, so others may clash.

Groups of more than ``hot_rows`` rows never meet in one task: their ranks come
from counts per distinct value, prefix-summed over ranges of values and then within
each range; a value shared by many hits is salted. Both ways give the same numbers.
The list of such groups is sent to every task only if it has at most ``SMALL`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_within, cut_lineage

HOT_ROWS = 200_000
HOT_TIES, SALTS, RANGES, SMALL = 50_000, 32, 64, 100_000
#: Means are compared after rounding to so many places, else the order of the sum would part ties.
PLACES = 9

# P. J. Acklam's rational approximation of the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
LOW = 0.02425


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {c!r}D)", coefficients[1:], f"{coefficients[0]!r}D")


def with_probit(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add columns that map percentile columns, 0 < p < 1, through the inverse normal distribution.

    ``pairs`` maps new names to percentile columns. The powers' bases are columns of
    their own, which keeps the expressions small for the optimizer.
    """
    df = df.withColumns({f"_r{k}": F.expr(f"({p} - 0.5D) * ({p} - 0.5D)") for k, p in enumerate(pairs.values())} | {f"_t{k}": F.expr(f"sqrt(-2D * ln(least({p}, 1D - {p})))") for k, p in enumerate(pairs.values())})
    out = {}
    for k, (name, p) in enumerate(pairs.items()):
        tail = f"sign(0.5D - {p}) * {_horner(C, f'_t{k}')} / {_horner(D, f'_t{k}')}"
        out[name] = F.expr(f"case when least({p}, 1D - {p}) < {LOW}D then {tail} else ({p} - 0.5D) * {_horner(A, f'_r{k}')} / {_horner(B, f'_r{k}')} end")
    return df.withColumns(out)


def _percentile(n_below: Column, ties: Column, n: Column) -> Column:
    return (n_below + (ties + F.lit(1)) / F.lit(2.0) - F.lit(0.5)) / n


def _mean(scores: list[str], weights: list[float], has: Column) -> Column:
    """Weighted mean of the z columns of the scores that have a say."""
    total = reduce(lambda a, b: a + b, [F.when(has[s], F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights)])
    parts = reduce(lambda a, b: a + b, [F.when(has[s], F.col(f"_z_{s}") * float(w)).otherwise(0.0) for s, w in zip(scores, weights)])
    return F.when(total > 0, parts / total).otherwise(0.0)


def _distinct(rows: DataFrame, scores: list[str]) -> DataFrame:
    return rows.groupBy("group", "key").agg(*[F.max(s).alias(s) for s in scores])


def _cold(rows: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    """Groups that fit a task: windows over one shuffle by group."""
    hits = _distinct(rows.repartition("group"), scores)
    group = Window.partitionBy("group")
    hits = hits.select("*", F.count("*").over(group).alias("n"), *[F.min(s).over(group).alias(f"_min_{s}") for s in scores])
    has = {s: F.col(f"_min_{s}").isNotNull() for s in scores}
    hits = hits.withColumns({s: F.coalesce(s, f"_min_{s}") for s in scores})
    for s in scores:
        by = Window.partitionBy("group").orderBy(s)
        ties = F.count("*").over(by.rangeBetween(Window.currentRow, Window.currentRow))
        hits = hits.withColumns({f"_below_{s}": F.rank().over(by) - 1, f"_ties_{s}": ties})
    hits = hits.withColumns({f"_p_{s}": _percentile(F.col(f"_below_{s}"), F.col(f"_ties_{s}"), F.col("n")) for s in scores})
    hits = with_probit(hits, {f"_z_{s}": f"_p_{s}" for s in scores})
    fused = hits.withColumn("fused", _mean(scores, weights, has))
    best = group.orderBy(F.desc(F.round("fused", PLACES)), "key")
    return fused.select("group", "key", "n", "fused", F.row_number().over(best).cast("long").alias("place"))


def _running(counts: DataFrame, keys: list[str], order: list[str], n: str) -> DataFrame:
    """``counts`` with ``below``: the sum of ``n`` over the rows of the same keys that come earlier by ``order``.

    Rows are range-partitioned by keys and order, so a group lies in consecutive partitions
    of like size, whatever its values; a table of one row per group and partition links them.
    """
    ranged = counts.repartitionByRange(RANGES, *keys, *order).withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the ranges are drawn from a sample: both uses below must see the same ones
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_p").agg(F.sum(n).alias("_t")).select(*keys, "_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return rows.join(totals, [*keys, "_p"]).withColumn("below", F.col("_before") + F.col("_inside")).drop("_p", "_before", "_inside")


def _hot(rows: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    """Groups of any size: ranks from counts per distinct value."""
    hits = _distinct(rows, scores)
    stats = hits.groupBy("group").agg(F.count("*").alias("n"), *[F.min(s).alias(f"_min_{s}") for s in scores])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.coalesce(s, f"_min_{s}").alias("v")) for k, s in enumerate(scores)]))
    long = cut_lineage(hits.join(broadcast_within(stats, SMALL), "group").select("group", "key", "n", each.alias("_e")).select("group", "key", "n", "_e.*"))
    counts = long.filter("v is not null").groupBy("group", "s", "v").agg(F.count("*").alias("ties"))
    ranks = _running(counts, ["group", "s"], ["v"], "ties")
    # a value that most hits share, as the lowest one put in for nulls: salted on one side, repeated on the other
    ranks = ranks.withColumn("_salt", F.explode(F.when(F.col("ties") > HOT_TIES, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    many = broadcast_within(cut_lineage(counts.filter(F.col("ties") > HOT_TIES).select("group", "s", "v", F.lit(True).alias("_many"))), SMALL)
    salt = F.when(F.col("_many"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(-1)
    long = long.join(many, ["group", "s", "v"], "left").withColumn("_salt", salt).drop("_many").join(ranks, ["group", "s", "v", "_salt"], "left")
    long = with_probit(long.withColumn("_p", _percentile(F.col("below"), F.col("ties"), F.col("n"))), {"_z": "_p"})
    wide = long.groupBy("group", "key", "n").agg(*[F.max(F.when(F.col("s") == k, F.col("_z"))).alias(f"_z_{s}") for k, s in enumerate(scores)])
    fused = wide.select("group", "key", "n", _mean(scores, weights, {s: F.col(f"_z_{s}").isNotNull() for s in scores}).alias("fused"))
    placed = _running(fused.select("*", (-F.round("fused", PLACES)).alias("_v"), F.lit(1).alias("_one")), ["group"], ["_v", "key"], "_one")
    return placed.select("group", "key", "n", "fused", (F.col("below") + 1).alias("place"))


def fuse(hits: DataFrame, group: str, key: str, scores: list[str], weights: list[float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, key, n, fused, place) of every distinct item; place 1 belongs first and n counts the group."""
    weights = [1.0] * len(scores) if weights is None else weights
    if not scores or len(weights) != len(scores) or min(weights) < 0:
        raise ValueError("fuse needs scores and as many weights, none negative")
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double") + 0.0).alias(f"s{k}") for k, s in enumerate(scores)]
    rows = hits.select(F.col(group).alias("group"), F.col(key).alias("key"), *clean).filter("group is not null and key is not null")
    names = [f"s{k}" for k in range(len(scores))]
    hot = cut_lineage(rows.groupBy("group").count().filter(F.col("count") > hot_rows).select("group"))  # a small share of rows / hot_rows
    hot = broadcast_within(hot, SMALL)
    cold = _cold(rows.join(hot, "group", "left_anti"), names, weights)
    out = cold if hot.isEmpty() else cold.unionByName(_hot(rows.join(hot, "group", "left_semi"), names, weights))
    return out.withColumnsRenamed({"group": group, "key": key})
