"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read, spread
from . import docpairs, handwritten, invalid, leak, mix, neardup, neighbours, rank, repeat, split

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, together with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LANGUAGE_SQL = """coalesce(nullif(lower(trim(lang)), ''), case lower(regexp_extract(file, '\\.([^./]+)$', 1))
 when 'py' then 'python' when 'rs' then 'rust' when 'go' then 'go' when 'ts' then 'typescript' when 'js' then 'javascript'
 when 'java' then 'java' when 'md' then 'markdown' when 'json' then 'json' when 'toml' then 'toml' when 'yaml' then 'yaml'
 when 'sh' then 'shell' end)"""

OVER_SQL = f"""
with c as (select chunk_id, text, {LANGUAGE_SQL} as language from chunks),
l as (select c.chunk_id, c.text, coalesce(o.max_chunk_lines, d.max_chunk_lines) as max_lines, coalesce(o.max_chunk_chars, d.max_chunk_chars) as max_bytes
      from c left join (select * from chunk_limits where lang <> 'default') o on o.lang = c.language
      cross join (select * from chunk_limits where lang = 'default') d)
select distinct chunk_id from l
where strlen(text) > max_bytes
   or length(text) - length(replace(text, chr(10), '')) + case when text = '' or suffix(text, chr(10)) then 0 else 1 end > max_lines"""


@query(OVER_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut, from the pieces they were cut into."""
    return _pieces(spark, d).select("chunk_id").distinct()


@query()
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece with its place in lines and bytes."""
    return _pieces(spark, d)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chunks(read(spark, d, "chunks", "chunk_id", "file", "lang", "start_line", "text"), read(spark, d, "chunk_limits"))


COMPONENTS = ["dense_score", "sparse_score", "rerank_score", "score"]


def _horner_sql(cs, x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit_sql(p: str) -> str:
    low, high, q = f"sqrt(-2.0e0 * ln({p}))", f"sqrt(-2.0e0 * ln(1.0e0 - {p}))", f"({p} - 0.5e0)"
    return (
        f"case when {p} < {rank.LOW} then {_horner_sql(rank.C, low)} / {_horner_sql(rank.D, low)} "
        f"when {p} > {1 - rank.LOW} then -({_horner_sql(rank.C, high)} / {_horner_sql(rank.D, high)}) "
        f"else {q} * {_horner_sql(rank.A, f'({q} * {q})')} / {_horner_sql(rank.B, f'({q} * {q})')} end"
    )


def _fuse_sql() -> str:
    clean = ", ".join(f"max(case when not isnan({s}) then {s}::double end) as {s}" for s in COMPONENTS)
    lows = ", ".join(f"min({s}) over (partition by search_id) as low_{s}" for s in COMPONENTS)
    filled = ", ".join(f"coalesce({s}, low_{s}) as f_{s}, low_{s}" for s in COMPONENTS)
    percent = ", ".join(
        f"(rank() over (partition by search_id order by f_{s}) - 1 + (count(*) over (partition by search_id, f_{s}) + 1) / 2.0e0 - 0.5e0) / n as p_{s}, low_{s}" for s in COMPONENTS
    )
    z = ", ".join(f"case when low_{s} is null then 0.0e0 else {_probit_sql(f'p_{s}')} end as z_{s}, case when low_{s} is null then 0.0e0 else 1.0e0 end as w_{s}" for s in COMPONENTS)
    total, weight = (" + ".join(f"{c}_{s}" for s in COMPONENTS) for c in "zw")
    return f"""
with d as (select search_id, result_id, {clean} from search_results where search_id is not null and result_id is not null group by all),
m as (select *, count(*) over (partition by search_id) as n, {lows} from d),
f as (select search_id, result_id, n, {filled} from m),
p as (select search_id, result_id, n, {percent} from f),
z as (select search_id, result_id, n, {z} from p),
fused as (select search_id, result_id, n, case when {weight} > 0 then ({total}) / ({weight}) else 0.0e0 end as fused from z)
"""


FIRST_SQL = _fuse_sql() + """
select search_id, result_id from (select *, row_number() over (partition by search_id order by round(fused, 9) desc, result_id) as place from fused)
where place = 1 and n >= 5"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return rank.fuse(read(spark, d, "search_results", "search_id", "result_id", *COMPONENTS), "search_id", "result_id", COMPONENTS)


@query(FIRST_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The hit that belongs first in each search of at least five hits."""
    return _fused(spark, d).filter("place = 1 and n >= 5").select("search_id", "result_id")


@query(_fuse_sql() + "select search_id, result_id, n, round(fused, 6) as fused from fused")
def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The fused score of every hit."""
    return _fused(spark, d).select("search_id", "result_id", "n", F.round("fused", 6).alias("fused"))


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"""
with i as (select distinct item_id, {WORDS_SQL} as w from eval_items where text is not null),
p as (select distinct item_id, array_to_string(w[k : k + 12], ' ') as passage from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i where len(w) >= 13)),
d as (select doc_id, {WORDS_SQL} as w from documents where text is not null),
q as (select doc_id, array_to_string(w[k : k + 12], ' ') as passage from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13))
select distinct doc_id, item_id from q join p using (passage)""")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a literal passage of a test item, and the item."""
    return _leaks(spark, d).filter("errors = 0").select("doc_id", "item_id")


@query()
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Literal and slightly edited passages."""
    return _leaks(spark, d)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(spread(read(spark, d, "documents", "doc_id", "text")), read(spark, d, "eval_items", "item_id", "text"))


SHARES_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
g as (select doc_id, k, array_to_string(w[k : k + 4], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5)),
a as (select doc_id, k from (select *, min(k) over (partition by doc_id, gram) as first from g) where k > first),
c as (select doc_id, count(distinct k + o) as n from a cross join (select unnest([0, 1, 2, 3, 4]) as o) group by doc_id),
s as (select d.doc_id, coalesce(len(w), 0) as n_words, case when len(w) > 0 then coalesce(n, 0) / len(w)::double else 0.0 end as share from d left join c using (doc_id))
"""


@query(SHARES_SQL + "select doc_id from s where share >= 0.3 - 1e-12")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least three tenths of the words are repeated."""
    rows = repeat.repetition(spread(read(spark, d, "documents", "doc_id", "text")), share=0.3)
    return rows.filter(F.col("suspect") & (F.col("repeated_share") >= 0.3 - 1e-12)).select("doc_id").distinct()


@query(SHARES_SQL + "select doc_id, n_words, round(share, 6) as repeated_share from s")
def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The repeated share of every document."""
    rows = repeat.repeated_shares(spread(read(spark, d, "documents", "doc_id", "text")))
    return rows.select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions whose documentation says something."""
    return p2_pairs(spark, d).select("chunk_id")


@query()
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code with its documentation."""
    return docpairs.doc_pairs(read(spark, d, "chunks", "chunk_id", "file", "lang", "kind", "name", "text"))


def _near(spark: SparkSession, d: str):
    rows = read(spark, d, "chunks", "chunk_id", "kind", "text").filter(F.col("kind").isin(docpairs.KINDS))
    return neardup.near_duplicates(rows, "chunk_id", "text", 0.5, 3)


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of functions of different files with at least half of their three-word shingles in common.

    Different texts that are linked come out for every copy of either text, against
    one copy of the other; copies of one text come out against their representative.
    """
    classes, links = _near(spark, d)
    place = read(spark, d, "chunks", "chunk_id", "repo", "file", "kind").filter(F.col("kind").isin(docpairs.KINDS))
    return neardup.pairs_between(classes, links, place.select(F.col("chunk_id").alias("id"), F.struct("repo", "file").alias("place")), "chunk_a", "chunk_b")


@query()
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every function with the id of its group of near-duplicates and its number of links."""
    return neardup.groups(*_near(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judge(spread(read(spark, d, "files", "file_id", "repo", "relative_path", "text")))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody of the repository wrote by hand."""
    return _judged(spark, d).filter("reason is not null").select("file_id")


@query()
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many files of each language each reason sorts out."""
    return _judged(spark, d).groupBy("lang", "reason").agg(F.count("*").alias("n"))


@query()
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mixture with how often it is used."""
    return _mix(spark, d)[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source with a target."""
    return _mix(spark, d)[1]


@query()
def p9_exact(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share in the largest mixture in which no source reaches its cap."""
    return _mix(spark, d, None)[1]


def _mix(spark: SparkSession, d: str, total: str | None = mix.ALL_TOKENS):
    return mix.mix(spread(read(spark, d, "documents", "doc_id", "text", "lang", "source", "doc_type")), read(spark, d, "mix_targets"), total=total, domain="doc_type")


@query("""
with v as (select item_id, min(embedding::double[]) as e from embed_items where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by item_id),
p as (select a.item_id as item, b.item_id as other, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.item_id <> b.item_id),
t as (select *, row_number() over (partition by item order by s desc, other) as place from p)
select distinct least(item, other) as item_a, greatest(item, other) as item_b from t where place <= 5 and s >= 0.85""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items of which one is among the other's five most similar, at a cosine of 0.85 or more."""
    near = neighbours.most_similar(read(spark, d, "embed_items", "item_id", "embedding"), "item_id", "embedding", 5, 64, 0.85)
    return near.select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()


@query("""
with v as (select item_id, min(embedding::double[]) as e from embed_items where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by item_id),
p as (select a.item_id as item, b.item_id as other, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.item_id <> b.item_id where a.item_id % 50 = 0),
t as (select *, row_number() over (partition by item order by round(s, 9) desc, other) as place from p)
select item, other, round(s, 6) as similarity, place::int as place from t where place <= 5""")
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar items of every item whose id is divisible by 50, against all items."""
    items = read(spark, d, "embed_items", "item_id", "embedding")
    asked = items.filter(F.col("item_id") % 50 == 0).select("item_id")
    return neighbours.most_similar(items, "item_id", "embedding", 5, 64, queries=asked).withColumn("similarity", F.round("similarity", 6))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are no valid program of the language of their extension."""
    return invalid.invalid_files(_sources(spark, d)).select("file_id").distinct()


@query()
def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares of such files per repository and language."""
    return invalid.rates(_sources(spark, d))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "files", "file_id", "repo", "relative_path", "text"))
