"""Problem 4: near-duplicate records with small edits.

Texts become sets of shingles of ``shingle`` consecutive words. Document
frequencies over all texts are held in a count-min sketch of fixed size; they give
each shingle the weight ``(1 + ln(tf) / 4) * (1 + idf / 4)`` with an idf scaled to [0, 1],
so rare shingles weigh up to a quarter more. Improved consistent weighted sampling
(Ioffe 2010) draws ``bands * rows`` samples from each text; texts that agree on all
samples of at least two bands are candidates (at a weighted similarity of 0.5 that finds
99.9 % of the pairs, and at 0.6 all but one in a million). As the links wanted are those
of plain Jaccard, the weights are damped: a plain similarity of 0.5 is a weighted one of
at least 0.44 where no shingle repeats, of which 0.8 % are expected to be lost. Candidates
are verified exactly, by the Jaccard similarity of their shingle sets.

Exact copies are first reduced to one text, known by its 64-bit hash, and links name
the least id of its copies. A bucket of more than ``star``
texts is split by the texts' other bands; what is still crowded then is compared in
blocks of about ``star`` texts, each pair of blocks in a group of its own, so that no
bucket meets in one task and none is cut off. Results don't depend on partitioning.

Null texts, null ids and texts shorter than a shingle match nothing but exact copies
of themselves when they have any word. Repeated rows of one id count once. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import words
from ..session import cut_lineage

SHINGLE, BANDS, ROWS, STAR = 3, 32, 2, 64
SKETCH_DEPTH, SKETCH_WIDTH = 3, 1 << 18
POOL, LEVELS = 1 << 13, 16
#: How far frequency within a text and rarity among texts move a shingle's weight away from 1.
DAMP = 0.25
_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts given as concatenated word hashes: (text number, shingle, times in the text), sorted."""
    total = len(hashes)
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    gram = np.zeros(total - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            gram = mixed(gram * _M + hashes[j : total - k + 1 + j] + np.uint64(j))
    whole = doc[: total - k + 1] == doc[k - 1 :]
    doc, gram = doc[: total - k + 1][whole], gram[whole]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(new)
    return doc[at], gram[at], np.diff(np.append(at, len(doc)))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Flattened values and list sizes of an array<long> column without nulls."""
    col = batch.column(column)
    offsets = col.offsets.to_numpy()
    return col.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).view(np.uint64), np.diff(offsets)


def _cells(gram: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mixed(gram + np.uint64(d + 1) * _M) % np.uint64(SKETCH_WIDTH)).astype(np.int64) for d in range(SKETCH_DEPTH)]


def frequency_sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """Count-min sketch of how many texts hold each shingle; its size doesn't grow with the data."""
    rows, width = 64, SKETCH_DEPTH * SKETCH_WIDTH // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((SKETCH_DEPTH, SKETCH_WIDTH), dtype=np.int64)
        some = False
        for batch in batches:
            some = True
            _, gram, _ = shingles(*_flat(batch, "h"), shingle)
            for d, cell in enumerate(_cells(gram)):
                sketch[d] += np.bincount(cell, minlength=SKETCH_WIDTH)
        if some:
            flat = sketch.reshape(rows, width)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(rows), pa.int32()), "counts": pa.array([x.tobytes() for x in flat], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select("h").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    sketch = np.zeros((rows, width), dtype=np.int64)
    for r in parts.toLocalIterator():  # 64 rows, together 6 MB
        sketch[r.part] = np.frombuffer(r.counts, dtype=np.int64)
    return sketch.reshape(SKETCH_DEPTH, SKETCH_WIDTH)


def sample_tables(samples: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) draws r and ln c, and uniform beta, for each sample and each slot of a pool that shingles hash into."""
    rng = np.random.default_rng(seed)
    shape = (samples, POOL)
    return rng.gamma(2, 1, shape).astype(np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, dtype=np.float32)


@lru_cache(maxsize=2)
def _tables(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sample_tables(samples, seed)


def _weight_levels() -> np.ndarray:
    return np.linspace(1.0, 2.5, LEVELS)


def draw(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray, samples: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """ICWS: (text numbers, their samples as hashes of the chosen shingle)."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((len(first), samples), dtype=np.uint64)
    if not len(first):
        return doc[:0], out
    levels = _weight_levels()
    level = np.clip(np.rint((weight - levels[0]) / (levels[1] - levels[0])), 0, len(levels) - 1).astype(np.int64)
    used, level = np.unique(level, return_inverse=True)
    logw = np.log(levels[used]).astype(np.float32)
    r, lnc, beta = _tables(samples, seed)
    sizes = np.diff(np.append(first, len(doc)))
    position = np.arange(len(doc))
    for s in range(samples):
        # ln a for every pool slot and used weight: ln c - r (floor(ln w / r + beta) - beta + 1)
        lna = lnc[s] - r[s] * (np.floor(logw[:, None] / r[s] + beta[s]) - beta[s] + 1)
        slot = ((gram >> np.uint64(s % 40)) * _M >> np.uint64(51)).astype(np.int64)
        a = lna[level, slot]
        low = np.minimum.reduceat(a, first)
        hit = np.where(a == np.repeat(low, sizes), position, len(doc))
        out[:, s] = gram[np.minimum.reduceat(hit, first)]
    return doc[first], out


def band_keys(texts: DataFrame, shingle: int, bands: int, rows: int, sketch: np.ndarray, n_texts: int) -> DataFrame:
    """(id, keys): a hash for each band of every text."""
    share = texts.sparkSession.sparkContext.broadcast(sketch)  # fixed size

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        for batch in batches:
            doc, gram, times = shingles(*_flat(batch, "h"), shingle)
            df = np.min([table[d][cell] for d, cell in enumerate(_cells(gram))], axis=0) if len(gram) else np.zeros(0)
            idf = np.log((1 + n_texts) / (1 + df)) / np.log(1 + n_texts) if n_texts else np.zeros(0)
            weight = (1 + DAMP * np.log(times)) * (1 + DAMP * np.clip(idf, 0, 1))
            which, samples = draw(doc, gram, weight, bands * rows)
            with np.errstate(over="ignore"):
                keys = np.zeros((len(which), bands), dtype=np.uint64)
                for j in range(rows):
                    keys = mixed(keys * _M + samples[:, j::rows])
                keys += np.arange(bands, dtype=np.uint64)[None, :] * _M
            offsets = pa.array(np.arange(len(which) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))], names=["id", "keys"])

    return texts.select("id", "h").mapInArrow(sign, "id bigint, keys array<bigint>")


def _pairs(buckets: DataFrame, star: int) -> DataFrame:
    """Pairs a < b of the ids that share a key, in blocks: a key's ids never meet all at once."""
    sizes = buckets.groupBy("key").agg(F.ceil(F.count("*") / (star + 1)).cast("int").alias("n")).filter("n > 1")
    small = buckets.join(sizes, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    later = F.transform("ids", lambda a, i: F.struct(a.alias("a"), F.slice(F.col("ids"), i + 2, F.size("ids")).alias("bs")))
    out = small.select(F.explode(later).alias("p")).select(F.col("p.a").alias("a"), F.explode("p.bs").alias("b"))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    tiles = buckets.join(sizes, "key").select("key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    tiles = tiles.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("id"))).alias("us"), F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("id"))).alias("vs")
    )
    pairs = tiles.select("us", F.explode("vs").alias("v")).select(F.explode("us").alias("u"), "v").filter(F.col("u") != F.col("v"))
    return out.unionByName(pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))


def candidates(signed: DataFrame, star: int = STAR) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of rows (id, keys): those that agree on two bands."""
    rows = signed.select("id", F.explode("keys").alias("key")).repartition("key")  # one exchange for all three uses
    full = rows.groupBy("key").count().filter(F.col("count") > star + 1).select("key")
    small = rows.join(full, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    later = F.transform("ids", lambda a, i: F.struct(a.alias("a"), F.slice(F.col("ids"), i + 2, F.size("ids")).alias("bs")))
    out = small.select(F.explode(later).alias("p")).select(F.col("p.a").alias("a"), F.explode("p.bs").alias("b")).groupBy("a", "b").count().filter("count > 1")
    # a crowded bucket is split by each other band's key, which asks for the second band as well
    crowded = rows.join(full, "key", "left_semi").join(signed, "id").select("id", "key", F.explode("keys").alias("k2")).filter(F.col("key") != F.col("k2"))
    return out.select("a", "b").unionByName(_pairs(crowded.select("id", F.xxhash64("key", "k2").alias("key")), star)).distinct()


def near_duplicates(records: DataFrame, record_id: str, text: str, threshold: float, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, star: int = STAR):
    """(classes, links): ``classes`` has (id, rep) of every record, copies of a text sharing a representative;
    ``links`` has (a, b, similarity), a < b, of representatives whose shingle sets have Jaccard similarity >= threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    raw = records.select(F.col(record_id).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null").select("id", F.xxhash64("text").alias("t"), "text")
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")
    texts = raw.select(F.col("t").alias("id"), hashed)
    sketch = frequency_sketch(texts, shingle)
    signed = cut_lineage(band_keys(texts, shingle, bands, rows, sketch, raw.count()).dropDuplicates(["id"]))
    pairs = cut_lineage(candidates(signed, star))
    need = pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, gram, _ = shingles(*_flat(batch, "h"), shingle)
            sizes = np.bincount(doc, minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(gram.view(np.int64)))], names=["id", "set"]
            )

    held = raw.join(need, "t", "left_semi").select(F.col("t").alias("id"), hashed).mapInArrow(sets, "id bigint, set array<bigint>").dropDuplicates(["id"])
    held = cut_lineage(held)
    left = pairs.join(held.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(held.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = cut_lineage(both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12))
    ids = raw.select("id", "t").distinct()
    reps = ids.groupBy("t").agg(F.min("id").alias("rep"))
    classes = ids.join(reps, "t").select("id", "rep")
    named = links.join(reps.select(F.col("t").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("t").alias("b"), F.col("rep").alias("rb")), "b")
    return classes, named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "similarity")


def pairs_between(classes: DataFrame, links: DataFrame, places: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids in different places.

    For a link between different texts, every copy of either text is paired with one
    copy of the other that lies elsewhere; copies of one text are paired with its first
    copy, or with the first one elsewhere. The size is linear in copies, not square.
    """
    where = places.groupBy("id").agg(F.min("place").alias("place"))
    members = classes.join(where, "id").select("rep", "id", "place")
    # two copies in different places stand for a text: one of them lies elsewhere than any given copy
    first = members.groupBy("rep").agg(F.min(F.struct("id", "place")).alias("one"))
    second = members.join(first, "rep").filter(F.col("place") != F.col("one.place")).groupBy("rep").agg(F.min(F.struct("id", "place")).alias("two"))
    stand = first.join(second, "rep", "left")
    elsewhere = F.when(F.col("place") != F.col("one.place"), F.col("one.id")).otherwise(F.col("two.id"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("_to")).union(links.select(F.col("b").alias("rep"), F.col("a").alias("_to")))
    across = both.join(stand.withColumnRenamed("rep", "_to"), "_to").join(members, "rep").select("id", elsewhere.alias("other"))
    copies = members.join(stand, "rep").select("id", elsewhere.alias("other"))
    pairs = across.unionByName(copies).filter("other is not null and id <> other")
    return pairs.select(F.least("id", "other").alias(a), F.greatest("id", "other").alias(b)).distinct()


def groups(classes: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group, n_links): connected components, named by their least representative.

    Labels move along links and then along labels, so that their way halves each round;
    every round is written to the shared folder.
    """
    edges = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    labels = classes.select(F.col("rep").alias("u")).distinct().withColumn("label", F.col("u"))
    for _ in range(rounds):
        least = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(least, "u", "left").select("u", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = moved.select(F.col("u").alias("label"), F.col("label").alias("next"))
        moved = cut_lineage(moved.join(jump, "label").select("u", "old", F.least("label", "next").alias("label")))
        labels = moved.select("u", "label")
        if moved.filter("old <> label").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    n = edges.groupBy("u").count()
    out = classes.join(labels.withColumnRenamed("u", "rep"), "rep").join(n.withColumnRenamed("u", "rep"), "rep", "left")
    return out.select("id", F.col("label").alias("group"), F.coalesce("count", F.lit(0)).alias("n_links"))
