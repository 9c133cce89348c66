"""Problem 6: the k most similar vectors of every vector, by a block matrix join.

Vectors are scaled to unit length and quantised to int8, with the length of the
rounding error kept. Rows are dealt to blocks by a hash of their id, and each pair of
blocks is a tile that one task multiplies: the int8 products give every similarity
within a bound from the two errors, so pairs that cannot be among a row's k best of
its tile, or cannot reach ``min_similarity``, are dropped for certain. The survivors
are recomputed from the float vectors and merged to the k best. Nothing is
approximated: recall is 1 up to float rounding.

Similarity is the cosine. Vectors that are null, zero, of another length than ``dim``
or hold null, NaN or infinite values have no neighbours and are none. Rows repeated
under one id count once (the first of the least vector). Equal vectors are searched
once and share what is found; of a group of copies only the k + 1 least ids can be
neighbours, since ties go to the smaller id. A vector is no neighbour of itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

BLOCK, STRIP = 8192, 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the rounding errors of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale.astype(np.float32), np.linalg.norm(x - codes * scale[:, None], axis=1).astype(np.float32)


def survivors(a: tuple, b: tuple, k: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile that may be among the k best of row a and at least ``least`` similar."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    fa, fb = qa.astype(np.float32), (qb.astype(np.float32) * sb[:, None]).T.copy()
    out_i, out_j = [], []
    widest = float(eb.max(initial=0))
    for at in range(0, len(fa), STRIP):
        part, error = fa[at : at + STRIP] * sa[at : at + STRIP, None], ea[at : at + STRIP]
        s = part @ fb  # products of int8 values, exact in float32 before the scaling
        if same:
            s[np.arange(len(s)), at + np.arange(len(s))] = -2
        slack = error + widest * (1 + 2 * error) + 1e-5
        floor = np.full(len(s), least, dtype=np.float32) - slack
        if least < -1 + 1e-9 and s.shape[1] > k:  # no limit: the k-th best lower bound of the row is one
            floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * slack)
        i, j = np.nonzero(s >= floor[:, None])
        if len(i):
            counts = np.bincount(i, minlength=len(s))
            crowded = np.flatnonzero(counts > 4 * k)
            if len(crowded):  # keep what may still be among the k best
                kth = np.partition(s[crowded], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * slack[crowded]
                limit = np.full(len(s), -np.inf)
                limit[crowded] = kth
                keep = s[i, j] >= limit[i]
                i, j = i[keep], j[keep]
        out_i.append(i + at)
        out_j.append(j)
    return np.concatenate(out_i) if out_i else np.zeros(0, int), np.concatenate(out_j) if out_j else np.zeros(0, int)


def valid_vectors(vectors: DataFrame, item_id: str, embedding: str, dim: int) -> DataFrame:
    """(id, v): usable vectors, one of each id."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(item_id).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def most_similar(
    vectors: DataFrame, item_id: str, embedding: str, k: int = 5, dim: int = 64, min_similarity: float = -1.0, queries: DataFrame | None = None, block: int = BLOCK
) -> DataFrame:
    """(item, other, similarity, place) of the up to k most similar others of every vector,
    or of those whose ids are in ``queries`` (a DataFrame with a column of that name)."""
    if k < 1 or dim < 1 or block < 1:
        raise ValueError("k, dim and block must be positive")
    id_type = vectors.schema[item_id].dataType.simpleString()
    rows = cut_lineage(valid_vectors(vectors, item_id, embedding, dim).withColumn("c", F.xxhash64("v")))
    # classes of equal vectors: those of k + 1 least ids suffice as neighbours
    by_class = Window.partitionBy("c").orderBy("id")
    members = rows.select("c", "id", F.row_number().over(by_class).alias("n"))
    lead = members.filter(F.col("n") <= k + 1).groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    single = rows.groupBy("c").agg(F.first("v").alias("v"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes, scale, error = quantise(x)
            yield pa.RecordBatch.from_pydict({"c": batch.column("c"), "q": pa.array([r.tobytes() for r in codes], pa.binary()), "s": pa.array(scale), "e": pa.array(error), "unit": pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))})

    coded = cut_lineage(single.mapInArrow(code, "c bigint, q binary, s float, e float, unit array<double>"))
    n = coded.count()
    blocks = max(1, -(-n // block))
    own = coded.select("c", "q", "s", "e", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    if queries is None:
        wanted, left = None, F.col("own") <= F.col("other")
        dealt = own.select("c", "q", "s", "e", "own", other)
        tiles = dealt.select("c", "q", "s", "e", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), left.alias("first"))
        n_tiles = blocks * (blocks + 1) // 2
    else:
        wanted = members.join(queries.select(F.col(item_id).alias("id")).distinct(), "id", "left_semi")
        asked = own.join(wanted.select("c").distinct(), "c", "left_semi").drop("own")
        across = max(1, -(-asked.count() // block))
        asked = asked.withColumn("i", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(across)).cast("int"))
        first = asked.select("c", "q", "s", "e", "i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), F.lit(True).alias("first"))
        second = own.select("c", "q", "s", "e", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), F.col("own").alias("j"), F.lit(False).alias("first"))
        tiles, n_tiles = first.unionByName(second), blocks * across
    self_join = queries is None
    wanted_k = k if self_join else k + 1  # a query meets itself among the rows

    def multiply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # at most two blocks
        c, side = table.column("c").to_numpy(), table.column("first").to_numpy()
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), dtype=np.int8).reshape(-1, dim)
        s, e = table.column("s").to_numpy(), table.column("e").to_numpy()
        diagonal = self_join and key[0].as_py() == key[1].as_py()
        a = np.flatnonzero(side)
        b = a if diagonal else np.flatnonzero(~side)
        found_a, found_b = [], []
        for x, y in ((a, b), (b, a))[: 2 if self_join and not diagonal else 1]:
            if len(x) and len(y):
                i, j = survivors((q[x], s[x], e[x]), (q[y], s[y], e[y]), wanted_k, min_similarity, diagonal)
                found_a.append(c[x[i]])
                found_b.append(c[y[j]])
        ca = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        cb = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        differ = ca != cb
        yield pa.RecordBatch.from_pydict({"a": pa.array(ca[differ], pa.int64()), "b": pa.array(cb[differ], pa.int64())})

    near = tiles.repartition(min(n_tiles, 4096), "i", "j").groupBy("i", "j").applyInArrow(multiply, "a bigint, b bigint")
    unit = coded.select("c", "unit")
    near = near.join(unit.select(F.col("c").alias("a"), F.col("unit").alias("ua")), "a").join(unit.select(F.col("c").alias("b"), F.col("unit").alias("ub")), "b")
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scored = near.select("a", "b", dot.alias("similarity")).filter(F.col("similarity") >= min_similarity)
    # k classes beside its own hold the k best others of any member
    kept = scored.withColumn("_n", F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("similarity")))).filter(F.col("_n") <= k).drop("_n")
    around = kept.join(lead.withColumnRenamed("c", "b"), "b").select(F.col("a").alias("c"), F.explode(F.slice("ids", 1, k)).alias("other"), "similarity")
    twins = lead.filter(F.size("ids") > 1).select("c", F.explode("ids").alias("other"), F.lit(1.0).alias("similarity"))
    place = Window.partitionBy("c").orderBy(F.desc("similarity"), "other")
    lists = around.unionByName(twins).withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k + 1).drop("_n")
    asked_for = members if wanted is None else wanted
    pairs = asked_for.select("c", F.col("id").alias("item")).join(lists, "c").filter(F.col("item") != F.col("other"))
    rank = Window.partitionBy("item").orderBy(F.desc("similarity"), "other")
    out = pairs.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k)
    return out.select(F.col("item").cast(id_type).alias("item"), F.col("other").cast(id_type).alias("other"), "similarity", "place")
