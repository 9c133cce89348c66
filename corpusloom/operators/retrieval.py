"""BM25, cosine search and their fusion into one ranking.

Corpus tables have chunk_id, file, lang, kind, name and content; ties always go to the
smaller chunk_id, after scores are rounded to nine places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code_text import code_tokens, is_bare_symbol_query, query_names_symbol, query_words, snippet, truncated
from ..session import keep

K1, B = 1.2, 0.75
BOOST = {"content": 1.0, "name": 3.0}


@dataclass(frozen=True)
class SearchSettings:
    """Knobs of a search, with the reference values as defaults."""

    dense_k: int = 30
    sparse_k: int = 30
    rerank_top_n: int = 30
    rrf_k: int = 60
    rerank_weight: float = 2.0
    symbol_boost: float = 1.0

    def __post_init__(self) -> None:
        if self.rerank_weight < 0:
            raise ValueError("a negative rerank weight would let the tail overtake the head")


@dataclass(frozen=True)
class Postings:
    """The inverted index: ``terms`` (field, tok, chunk_id, tf, positions), ``lengths`` (field, chunk_id, dl), ``stats`` (field, n, avgdl)."""

    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame


def build_postings(corpus: DataFrame, fields: tuple[str, ...] = ("content", "name")) -> Postings:
    """A3: terms with positions, field lengths and corpus statistics."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), code_tokens(F.coalesce(F.col(f), F.lit(""))).alias("toks")) for f in fields]))
    docs = corpus.select("chunk_id", each.alias("e")).select("chunk_id", "e.field", "e.toks")
    lengths = docs.select("field", "chunk_id", F.size("toks").alias("dl"))
    terms = docs.select("field", "chunk_id", F.posexplode("toks").alias("pos", "tok")).groupBy("field", "tok", "chunk_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Postings(terms, lengths, stats)


def query_postings(corpus: DataFrame, query: str, fields: tuple[str, ...] = ("content", "name")) -> Postings:
    """Postings of one query's tokens, where no stored ones are at hand: the corpus is read and tokenised once.

    Field lengths and statistics are those of the whole corpus; what is kept of a text is
    its lengths and the places of the query's tokens.
    """
    wanted = [r.tok for r in query_terms(query, corpus).select("tok").distinct().collect()]  # of one query
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), code_tokens(F.coalesce(F.col(f), F.lit(""))).alias("toks")) for f in fields]))
    docs = corpus.select("chunk_id", each.alias("e")).select("chunk_id", "e.field", "e.toks")
    places = F.filter(F.transform("toks", lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))), lambda x: x["tok"].isin(wanted))
    held = keep(docs.select("chunk_id", "field", F.size("toks").alias("dl"), places.alias("hits")))
    hits = held.select("field", "chunk_id", F.explode("hits").alias("h")).select("field", "chunk_id", "h.pos", "h.tok")
    terms = hits.groupBy("field", "tok", "chunk_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    stats = held.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Postings(terms, held.select("field", "chunk_id", "dl"), stats)


def query_terms(query: str, df: DataFrame) -> DataFrame:
    """(word, at, tok) of a query: its words in order and their tokens; a word of several tokens is a phrase."""
    one = df.sparkSession.range(1).select(F.posexplode(query_words(F.lit(query))).alias("word", "toks"))
    return one.select("word", F.size("toks").alias("n_toks"), F.posexplode("toks").alias("at", "tok"))


def bm25(postings: Postings, query: str, k: int, corpus: DataFrame | None = None, lang: str | None = None) -> DataFrame:
    """R2: (chunk_id, sparse_score, sparse_rank) of the top ``k``; words are OR-ed, a word of several tokens is a phrase.

    ``lang`` filters below the top-k. Postings are cut down to the query's tokens first.
    """
    wanted = query_terms(query, postings.terms)
    hits = postings.terms.join(F.broadcast(wanted), "tok")  # a query's tokens: a handful
    if lang is not None:
        hits = hits.join(corpus.filter(F.col("lang") == lang).select("chunk_id"), "chunk_id", "left_semi")
    df = postings.terms.join(F.broadcast(wanted.select("tok").distinct()), "tok", "left_semi").groupBy("field", "tok").agg(F.count("*").alias("df"))
    hits = hits.join(F.broadcast(df), ["field", "tok"]).join(F.broadcast(postings.stats), "field")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per = hits.groupBy("field", "word", "chunk_id").agg(
        F.max("n_toks").alias("n_toks"), F.count_distinct("at").alias("have"), F.sum(idf).alias("idf"), F.max("avgdl").alias("avgdl"),
        # a phrase starts where every token, moved back by its place in the word, stands
        F.collect_list(F.transform("positions", lambda p: p - F.col("at"))).alias("starts"),
    )
    tf = F.size(F.aggregate(F.slice("starts", 2, F.size("starts")), F.col("starts")[0], lambda a, x: F.array_intersect(a, x)))
    per = per.filter(F.col("have") == F.col("n_toks")).withColumn("tf", tf).filter("tf > 0").join(postings.lengths, ["field", "chunk_id"])
    boost = F.when(F.col("field") == "name", BOOST["name"]).otherwise(BOOST["content"])
    part = boost * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = per.groupBy("chunk_id").agg(F.sum(part).alias("sparse_score"))
    return _ranked(scored, "sparse_score", "sparse_rank", k)


def _ranked(scored: DataFrame, score: str, rank: str, k: int) -> DataFrame:
    """The top ``k`` by score with their 0-based ranks; the sort runs over k rows."""
    top = scored.orderBy(F.desc(F.round(score, 9)), "chunk_id").limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(F.round(score, 9)), "chunk_id")) - 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(embedding: str, dim: int) -> Column:
    """Vectors of the right length without NaN and not all zero."""
    v = F.col(embedding)
    return (F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def dense(vectors: DataFrame, query: DataFrame, k: int, dim: int, lang: str | None = None) -> DataFrame:
    """(chunk_id, dense_score, dense_rank) of the exact top ``k`` by cosine; ``query`` is one row with ``q``."""
    rows = vectors.filter(usable("embedding", dim))
    if lang is not None:
        rows = rows.filter(F.col("lang") == lang)
    scored = rows.join(F.broadcast(query.select("q").limit(1)), F.lit(True)).select("chunk_id", cosine(F.col("embedding"), F.col("q")).alias("dense_score"))
    return _ranked(scored, "dense_score", "dense_rank", k)


def depth(k: int, path: str | None) -> int:
    """How deep the legs go, deeper where a path is filtered after the fusion."""
    return min(10 * k, 500) if path else k


def rrf(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion over a full outer join of the legs."""
    both = dense_hits.join(sparse_hits, "chunk_id", "full_outer")
    vote = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    return both.withColumn("rrf", vote("dense_rank") + vote("sparse_rank"))


def symbol_boost(candidates: DataFrame, query: str, boost: float = 1.0, k: int = 60) -> DataFrame:
    """Candidates named by the query gain what a first place is worth."""
    if boost <= 0:
        return candidates
    named = query_names_symbol(F.lit(query), F.col("name"))
    return candidates.withColumn("rrf", F.col("rrf") + F.when(named, F.lit(boost / (k + 1))).otherwise(0.0))


def fuse_votes(head: DataFrame, weight: float = 2.0, k: int = 60) -> DataFrame:
    """The reranker votes with its rank; equal scores keep the fused order."""
    by = Window.orderBy(F.desc(F.round("rerank_score", 9)), "rrf_rank")
    return head.withColumn("rerank_rank", F.row_number().over(by) - 1).withColumn("score", F.col("rrf") + weight / (k + F.col("rerank_rank") + 1))


def token_overlap(query: str) -> Callable[[Column], Column]:
    """A deterministic stand-in for a reranker: the share of the query's distinct tokens that a text holds."""
    tokens = F.array_distinct(code_tokens(F.lit(query)))
    return lambda text: F.size(F.array_intersect(tokens, code_tokens(text))) / F.greatest(F.size(tokens), F.lit(1))


def merge(
    corpus: DataFrame, dense_hits: DataFrame, sparse_hits: DataFrame, query: str, settings: SearchSettings = SearchSettings(), path: str | None = None, lang: str | None = None,
) -> DataFrame:
    """Fused candidates with their chunks, best first (column rrf_rank)."""
    fused = rrf(dense_hits, sparse_hits, settings.rrf_k)
    rows = corpus.join(F.broadcast(fused), "chunk_id")  # at most 1000 candidates
    if path:
        rows = rows.filter(F.col("file").contains(path))
    if lang is not None:
        rows = rows.filter(F.col("lang") == lang)
    rows = symbol_boost(rows, query, settings.symbol_boost, settings.rrf_k)
    order = Window.orderBy(F.desc(F.round("rrf", 9)), "chunk_id")
    return rows.withColumn("rrf_rank", F.row_number().over(order) - 1)


def head_and_tail(merged: DataFrame, rerank: Callable[[Column], Column] | None, settings: SearchSettings, limit: int, max_document_chars: int = 8000) -> DataFrame:
    """The head is reordered by the reranker's votes, the tail follows by fused score."""
    if rerank is None:
        out = merged.withColumns({"rerank_score": F.lit(None).cast("double"), "score": F.col("rrf"), "segment": F.lit(0)})
    else:
        head = merged.filter(F.col("rrf_rank") < settings.rerank_top_n).withColumn("rerank_score", rerank(truncated(F.coalesce("content", F.lit("")), max_document_chars)).cast("double"))
        head = fuse_votes(head, settings.rerank_weight, settings.rrf_k).drop("rerank_rank").withColumn("segment", F.lit(0))
        tail = merged.filter(F.col("rrf_rank") >= settings.rerank_top_n).withColumns({"rerank_score": F.lit(None).cast("double"), "score": F.col("rrf"), "segment": F.lit(1)})
        out = head.unionByName(tail)
    return out.withColumn("preview", F.coalesce("content", F.lit(""))).orderBy("segment", F.desc(F.round("score", 9)), "rrf_rank").limit(limit)


def skip_rerank(merged: DataFrame, query: str) -> bool:
    """A bare symbol query whose first candidate is that symbol needs no reranker."""
    first = merged.filter("rrf_rank = 0").select((is_bare_symbol_query(F.lit(query)) & query_names_symbol(F.lit(query), F.col("name"))).alias("skip")).take(1)
    return bool(first and first[0]["skip"])


def hydrate(head: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full content for candidates that only carry a snippet."""
    content = chunks.select("chunk_id", F.col("content").alias("_content"))
    return content.join(F.broadcast(head), "chunk_id", "right").withColumn("content", F.coalesce("_content", "snippet")).drop("_content")


def read_chunks(chunks: DataFrame, file: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chunks of a file that overlap a range of lines."""
    rows = chunks.filter(F.col("file") == file)
    if start is not None:
        rows = rows.filter(F.col("end_line") >= start)
    if end is not None:
        rows = rows.filter(F.col("start_line") <= end)
    return rows.orderBy("start_line", "end_line").limit(10_000)


def output_budget(rows: DataFrame, by: list[str], order: list[str], text: str, budget: int = 20_000) -> DataFrame:
    """How many characters of each text still fit a budget that runs down in order."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("allowed", F.least(F.length(text), F.greatest(F.lit(0), budget - before)).cast("long"))


def snippets(chunks: DataFrame) -> DataFrame:
    """The dense store's payload: chunks with a snippet in place of their content."""
    return chunks.withColumn("snippet", snippet(F.col("content"))).drop("content")
