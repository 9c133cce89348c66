"""Queries of the core operators and their SQL; keys begin with the operator they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import code_text as T
from ..functions.words import extension
from ..operators import changes, chunk, evaluate, retrieval
from ..sources import policy
from ..tables import read, spread

QUERIES: dict = {}
SQL: dict = {}

QUERY, PHRASE = "prune cache retry_layer", "retry_layer merge:batch"
K, DIM = 30, 64

TOKENS = r"""list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_]+|_+', ' ', 'g'),
 '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), ' '), lambda x: x <> '' and strlen(x) <= 40), lambda x: lower(x))"""

CORPUS_SQL = """c as (select chunk_id, any_value(file) as file, max(coalesce(lower(lang), '')) as lang, any_value(kind) as kind, any_value(name) as name, any_value(text) as content,
 min(start_line) as start_line, min(end_line) as end_line from chunks group by chunk_id)"""
VECTORS_SQL = """v as (select i.chunk_id, c.lang, i.e from (select chunk_id, max(embedding::double[]) as e from embed_items where len(embedding) = 64
 and len(list_filter(embedding, lambda x: isnan(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by chunk_id) i join c using (chunk_id)),
q as (select e as q from v order by chunk_id limit 1)"""


def query(sql: str | None = None):
    """Register a query under its function's name, together with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table with one row of each chunk."""
    rows = spread(read(spark, d, "chunks", "chunk_id", "file", "lang", "kind", "name", "text", "start_line", "end_line"))
    pick = [F.any_value(c, ignoreNulls=True).alias(a) for c, a in (("file", "file"), ("kind", "kind"), ("name", "name"), ("text", "content"))]
    return rows.groupBy("chunk_id").agg(F.max(F.coalesce(F.lower("lang"), F.lit(""))).alias("lang"), *pick, F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"))


def vectors(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """(chunk_id, lang, embedding) of chunks with a usable vector."""
    items = read(spark, d, "embed_items", "chunk_id", "embedding").filter(retrieval.usable("embedding", DIM))
    return items.groupBy("chunk_id").agg(F.max(F.col("embedding").cast("array<double>")).alias("embedding")).join(chunks.select("chunk_id", "lang"), "chunk_id")


def _query_vector(v: DataFrame) -> DataFrame:
    return v.orderBy("chunk_id").limit(1).select(F.col("embedding").alias("q"))


# ---- functions


@query("select doc_id, len(" + TOKENS.format("text") + ") as n_tokens, len(list_distinct(" + TOKENS.format("text") + ")) as n_distinct from documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """F4."""
    t = T.code_tokens(F.col("text"))
    return spread(read(spark, d, "documents", "doc_id", "text")).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("select doc_id, sha256(text) as sha, substring(text, 1, 200) as snippet, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) as preview from documents")
def file_and_chunk_sha(spark: SparkSession, d: str) -> DataFrame:
    """F1, F3, F9."""
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", T.sha256_hex(F.col("text")).alias("sha"), T.snippet(F.col("text")).alias("snippet"), T.preview(F.col("text"), 240).alias("preview"))


@query("""select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((('0x' || substr(h, 17, 1))::int) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid
from (select chunk_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(file || '|' || start_line || '-' || end_line || '|' || chunk_sha)) as h from chunks where file is not null and chunk_sha is not null)""")
def chunk_uuid(spark: SparkSession, d: str) -> DataFrame:
    """F2."""
    rows = read(spark, d, "chunks", "chunk_id", "file", "start_line", "end_line", "chunk_sha").filter("file is not null and chunk_sha is not null")
    return rows.select("chunk_id", T.chunk_uuid(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("chunk_sha")).alias("uuid"))


@query(r"""with q as (select distinct query_text, list_filter(list_transform(regexp_split_to_array(query_text, '[^\p{L}\p{N}_:.]+'), lambda x: regexp_replace(x, '^[:.]+|[:.]+$', '', 'g')), lambda x: x <> '') as t from search_results where query_text is not null)
select query_text, len(t) as n_tokens, len(t) between 1 and 2 and len(list_filter(t, lambda x: not regexp_matches(x, '_|::|\.|^.+\p{Lu}'))) = 0 as bare from q""")
def bare_symbol_queries(spark: SparkSession, d: str) -> DataFrame:
    """F6, F7."""
    rows = read(spark, d, "search_results", "query_text").filter("query_text is not null").distinct()
    return rows.select("query_text", F.size(T.symbol_tokens(F.col("query_text"))).cast("long").alias("n_tokens"), T.is_bare_symbol_query(F.col("query_text")).alias("bare"))


@query(r"""with q as (select result_id, any_value(name) as name, any_value(query_text) as query_text from search_results where name is not null and query_text is not null group by result_id),
t as (select result_id, name, list_filter(list_transform(regexp_split_to_array(query_text, '[^\p{L}\p{N}_:.]+'), lambda x: regexp_replace(x, '^[:.]+|[:.]+$', '', 'g')), lambda x: x <> '') as t,
 contains(name, '::') or contains(name, '.') as qualified, regexp_extract(regexp_extract(name, '(?s)(?:.*::)?(.*)', 1), '(?s)(?:.*\.)?(.*)', 1) as tail from q)
select result_id, len(list_filter(t, lambda x: (lower(x) = lower(name) and (qualified or regexp_matches(x, '_|::|\.|^.+\p{Lu}') or (x = name and regexp_matches(x, '^\p{Lu}'))))
 or (qualified and regexp_matches(x, '_|::|\.|^.+\p{Lu}') and lower(x) = lower(tail)))) > 0 as named from t""")
def named_symbols(spark: SparkSession, d: str) -> DataFrame:
    """F8."""
    rows = read(spark, d, "search_results", "result_id", "name", "query_text").filter("name is not null and query_text is not null")
    rows = rows.groupBy("result_id").agg(F.any_value("name").alias("name"), F.any_value("query_text").alias("query_text"))
    return rows.select("result_id", T.query_names_symbol(F.col("query_text"), F.col("name")).alias("named"))


ERRORS = ["HTTP 500 from host", "Connection refused", "input is too large for it", "HTTP 404", "operation timed out", "loading model", "odd thing", "exceeds the context size", "broken pipe", "HTTP 422: input length 9"]


@query("with m as (select event_id, ([" + ", ".join(f"'{e}'" for e in ERRORS) + """])[(event_id % 10) + 1] as message from events), l as (select event_id, lower(message) as m from m)
select event_id, case when regexp_matches(m, 'too large to process|exceeds context|exceeds the context|input is too large|input is too long|input length|token limit') then 'WorkloadTooBig'
 when regexp_matches(m, 'loading model|connection refused') then 'ServerDown' when regexp_matches(m, 'http 40[0134]|http 415|http 422') then 'PermanentBad'
 when regexp_matches(m, 'timed out|timeout|connection closed|connection reset|broken pipe|http 50[0234]') then 'Ambiguous' else 'PermanentBad' end as class from l""")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    """F16, F17."""
    rows = read(spark, d, "events", "event_id")
    message = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (F.col("event_id") % 10 + 1).cast("int"))
    return rows.select("event_id", T.classify_error(message).alias("class"))


@query(r"""select repo, absolute_path, regexp_replace(repo, '[^A-Za-z0-9_-]+', '_', 'g') || '_' || substr(sha256(encode(repo) || '\x00'::blob || encode(absolute_path)), 1, 8) as collection from files where repo is not null and absolute_path is not null""")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    """F10, F11, F14."""
    rows = read(spark, d, "files", "repo", "absolute_path").filter("repo is not null and absolute_path is not null")
    return rows.select("repo", "absolute_path", T.collection_name(F.col("repo"), F.col("absolute_path")).alias("collection"))


# ---- sources


@query("select file_id, regexp_extract(relative_path, '[^/.][^/]*\\.([^./]+)$', 1) as ext, case regexp_extract(relative_path, '[^/.][^/]*\\.([^./]+)$', 1) "
       + " ".join(f"when '{e}' then '{lang}'" for lang, exts in policy.EXTENSIONS.items() for e in exts.split()) + " else 'text' end as language, "
       + "lower(regexp_extract(relative_path, '[^/.][^/]*\\.([^./]+)$', 1)) not in (" + ", ".join(f"'{b}'" for b in policy.BINARY) + ") and size_bytes <= 2097152 as admitted, "
       + "regexp_extract(relative_path, '[^/.][^/]*\\.([^./]+)$', 1) in ('py', 'pyi', 'rs') as listed from files")
def ext_policy(spark: SparkSession, d: str) -> DataFrame:
    """S2-S5."""
    ext = policy.extension(F.col("relative_path"))
    rows = read(spark, d, "files", "file_id", "relative_path", "size_bytes").withColumn("ext", ext)
    return rows.select("file_id", "ext", policy.language_from_ext(F.col("ext")).alias("language"), policy.admits(F.col("ext"), F.col("size_bytes")).alias("admitted"), policy.admits(F.col("ext"), F.col("size_bytes"), ["python", "rust"]).alias("listed"))


@query("select file_id, length(text) as n_chars from files where text is not null and position(chr(0) in text) = 0")
def read_text(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every file back as text."""
    rows = read(spark, d, "files", "file_id", "text").select("file_id", policy.text_of(F.encode("text", "UTF-8")).alias("t"))
    return rows.filter("t is not null").select("file_id", F.length("t").cast("long").alias("n_chars"))


@query("select repo, file, max(file_sha256) as file_sha256 from chunks where file is not null and file_sha256 is not null group by repo, file")
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the store with a hash."""
    rows = read(spark, d, "chunks", "repo", "file", "file_sha256").filter("file is not null and file_sha256 is not null")
    return rows.groupBy("repo", "file").agg(F.max("file_sha256").alias("file_sha256"))


# ---- chunking


@query(r"""with f as (select file_id, any_value(text) as text from files where relative_path like '%.md' and text is not null and text <> '' group by file_id),
l as (select file_id, unnest(string_split(regexp_replace(text, '\n\z', ''), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\n\z', ''), chr(10)), 1) - 1 as i from f),
b as (select file_id, i, regexp_replace(line, '\r\z', '') as line from l),
c as (select *, regexp_matches(line, '^\s*```') as fence from b),
o as (select *, sum(fence::int) over (partition by file_id order by i) % 2 as open from c),
s as (select *, sum((i > 0 and open = 0 and not fence and regexp_matches(line, '^\s*##?[ \t]'))::int) over (partition by file_id order by i) as section from o),
g as (select file_id, section, min(i) + 1 as start_line, max(i) + 1 as end_line, string_agg(line, chr(10) order by i) as text from s group by file_id, section)
select file_id, start_line, end_line, text from g where regexp_matches(text, '\S')""")
def chunk_headings(spark: SparkSession, d: str) -> DataFrame:
    """C3, C6, W3."""
    rows = read(spark, d, "files", "file_id", "relative_path", "text").filter("relative_path like '%.md' and text is not null").groupBy("file_id").agg(F.any_value("text").alias("text"))
    out = chunk.heading_sections(rows.select(F.col("file_id").alias("file"), "text")).withColumnRenamed("file", "file_id")
    return out.select("file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text")


RULES = chunk.ChunkRules(chunk.ChunkRule("lines", 40, 6, 1500), {**{x: chunk.ChunkRule("tree-sitter", 40, 6, 4000) for x in ("python", "rust", "go", "java", "typescript", "javascript")}, "markdown": chunk.ChunkRule("headings", 40, 6, 1500)})


@query()
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file cut by the rule of its language."""
    ext = policy.extension(F.col("relative_path"))
    rows = spread(read(spark, d, "files", "repo", "relative_path", "text")).distinct()
    files = rows.select(F.concat_ws(":", "repo", "relative_path").alias("file"), policy.language_from_ext(ext).alias("lang"), "text")
    return chunk.chunk_files(files, RULES)


@query()
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line windows of every document."""
    rows = spread(read(spark, d, "documents", "doc_id", "text"))
    return chunk.chunk_files(rows.select(F.col("doc_id").cast("string").alias("file"), F.lit(None).cast("string").alias("lang"), "text"), chunk.ChunkRules(chunk.ChunkRule("lines", 8, 2, 400)))


# ---- retrieval


def _bm25_sql(words: list[list[str]], lang: str | None = None, k: int = K) -> str:
    parts = []
    for n, word in enumerate(words):
        first = word[0]
        joins = "".join(f" join p p{i} on p{i}.chunk_id = p0.chunk_id and p{i}.field = p0.field and p{i}.tok = '{t}' and p{i}.pos = p0.pos + {i}" for i, t in enumerate(word) if i)
        idf = " + ".join(f"(select ln(1 + (n - df + 0.5) / (df + 0.5)) from df join st using (field) where df.field = p0.field and df.tok = '{t}')" for t in word)
        parts.append(f"select {n} as word, p0.field, p0.chunk_id, count(*) as tf, any_value({idf}) as idf from p p0{joins} where p0.tok = '{first}' group by p0.field, p0.chunk_id")
    wanted = ", ".join(f"'{t}'" for w in words for t in w)
    only = f" where chunk_id in (select chunk_id from c where lang = '{lang}')" if lang else ""
    return f"""
tk as (select chunk_id, 'content' as field, {TOKENS.format("coalesce(content, '')")} as t from c union all select chunk_id, 'name', {TOKENS.format("coalesce(name, '')")} from c),
st as (select field, count(*) as n, avg(len(t)) as avgdl from tk group by field),
p as (select field, chunk_id, tok, pos from (select field, chunk_id, unnest(t) as tok, generate_subscripts(t, 1) as pos from tk) where tok in ({wanted})),
df as (select field, tok, count(distinct chunk_id) as df from p group by field, tok),
w as ({" union all ".join(parts)}),
s as (select w.chunk_id, sum(case when w.field = 'name' then 3 else 1 end * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) as sparse_score
 from w join tk using (field, chunk_id) join st using (field){only} group by w.chunk_id),
sparse as (select *, row_number() over (order by round(sparse_score, 9) desc, chunk_id) - 1 as sparse_rank from s qualify sparse_rank < {k})"""


WORDS = [["prune"], ["cache"], ["retry", "layer"]]
DENSE_SQL = f"""dense as (select chunk_id, list_cosine_similarity(e, q) as dense_score, row_number() over (order by round(list_cosine_similarity(e, q), 9) desc, chunk_id) - 1 as dense_rank from v, q qualify dense_rank < {K})"""


@query(f"with {CORPUS_SQL}, {_bm25_sql(WORDS)} select chunk_id, round(sparse_score, 6) as sparse_score, sparse_rank from sparse")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Two fields, phrases, OR of words."""
    return _rounded(retrieval.bm25(retrieval.query_postings(corpus(spark, d), QUERY), QUERY, K), "sparse")


@query(f"with {CORPUS_SQL}, {_bm25_sql(WORDS, 'python')} select chunk_id, round(sparse_score, 6) as sparse_score, sparse_rank from sparse")
def bm25_topk_lang(spark: SparkSession, d: str) -> DataFrame:
    """The language filter lies below the top-k."""
    c = corpus(spark, d)
    return _rounded(retrieval.bm25(retrieval.query_postings(c, QUERY), QUERY, K, c, "python"), "sparse")


@query(f"with {CORPUS_SQL}, {_bm25_sql([['retry', 'layer'], ['merge'], ['batch']])} select chunk_id, round(sparse_score, 6) as sparse_score, sparse_rank from sparse")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    """A colon parts words, an underscore makes a phrase."""
    return _rounded(retrieval.bm25(retrieval.query_postings(corpus(spark, d), PHRASE), PHRASE, K), "sparse")


def _rounded(hits: DataFrame, leg: str) -> DataFrame:
    return hits.select("chunk_id", F.round(f"{leg}_score", 6).alias(f"{leg}_score"), F.col(f"{leg}_rank").cast("long").alias(f"{leg}_rank"))


@query(f"with {CORPUS_SQL}, {VECTORS_SQL}, {DENSE_SQL} select chunk_id, round(dense_score, 6) as dense_score, dense_rank from dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """R1, J12."""
    v = vectors(spark, d, corpus(spark, d))
    return _rounded(retrieval.dense(v, _query_vector(v), K, DIM), "dense")


@query(f"with {CORPUS_SQL}, {VECTORS_SQL}, r as (select * from v where lang = 'python'), {DENSE_SQL.replace('from v, q', 'from r, q')} select chunk_id, round(dense_score, 6) as dense_score, dense_rank from dense")
def dense_topk_lang(spark: SparkSession, d: str) -> DataFrame:
    """R1, P1."""
    v = vectors(spark, d, corpus(spark, d))
    return _rounded(retrieval.dense(v, _query_vector(v), K, DIM, "python"), "dense")


def _legs(spark: SparkSession, d: str, k: int = K):
    c = corpus(spark, d)
    v = vectors(spark, d, c)
    return c, retrieval.dense(v, _query_vector(v), k, DIM), retrieval.bm25(retrieval.query_postings(c, QUERY), QUERY, k)


def _fused_sql(k: int = K) -> str:
    return f"""with {CORPUS_SQL}, {VECTORS_SQL}, {DENSE_SQL.replace(f"dense_rank < {K}", f"dense_rank < {k}")}, {_bm25_sql(WORDS, k=k)},
f as (select chunk_id, dense_score, sparse_score, coalesce(1.0 / (60 + dense_rank + 1), 0) + coalesce(1.0 / (60 + sparse_rank + 1), 0) as rrf from dense full join sparse using (chunk_id)),
m0 as (select c.*, dense_score, sparse_score, rrf from f join c using (chunk_id)),
m as (select *, row_number() over (order by round(rrf, 9) desc, chunk_id) - 1 as rrf_rank from m0)"""


@query(_fused_sql() + " select chunk_id, file, round(dense_score, 6) as dense_score, round(sparse_score, 6) as sparse_score, round(rrf, 9) as score, case when dense_score is not null and sparse_score is not null then 'both' when dense_score is not null then 'dense' else 'sparse' end as found_via from m where rrf_rank < 10")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The flagship search."""
    c, dense, sparse = _legs(spark, d)
    out = retrieval.head_and_tail(retrieval.merge(c, dense, sparse, "", retrieval.SearchSettings(symbol_boost=0)), None, retrieval.SearchSettings(), 10)
    return out.select("chunk_id", "file", F.round("dense_score", 6).alias("dense_score"), F.round("sparse_score", 6).alias("sparse_score"), F.round("score", 9).alias("score"), T.modality(F.col("dense_score"), F.col("sparse_score")).alias("found_via"))


@query(_fused_sql(300).replace("from m0)", "from m0 where contains(file, 'src/'))") + " select chunk_id, file, round(rrf, 9) as score from m where rrf_rank < 10")
def rrf_path_filter(spark: SparkSession, d: str) -> DataFrame:
    """Legs ten times as deep, the path filtered after ranks are given."""
    c, dense, sparse = _legs(spark, d, retrieval.depth(K, "src/"))
    merged = retrieval.merge(c, dense, sparse, "", retrieval.SearchSettings(symbol_boost=0), path="src/")
    return retrieval.head_and_tail(merged, None, retrieval.SearchSettings(), 10).select("chunk_id", "file", F.round("score", 9).alias("score"))


_OVERLAP_SQL = "len(list_intersect(['prune', 'cache', 'retry', 'layer'], " + TOKENS.format("substring(coalesce(content, ''), 1, 8000)") + ")) / 4.0"


@query(_fused_sql() + f""", h as (select *, {_OVERLAP_SQL} as rerank_score from m where rrf_rank < 10),
v2 as (select *, rrf + 2.0 / (60 + row_number() over (order by round(rerank_score, 9) desc, rrf_rank) - 1 + 1) as score, 0 as segment from h),
a as (select chunk_id, segment, rerank_score, score, rrf_rank from v2 union all select chunk_id, 1, null, rrf, rrf_rank from m where rrf_rank >= 10)
select chunk_id, round(rerank_score, 6) as rerank_score, round(score, 9) as score from a order by segment, round(score, 9) desc, rrf_rank limit 15""")
def rerank_vote(spark: SparkSession, d: str) -> DataFrame:
    """The head reordered by a reranker's votes, the tail behind it."""
    c, dense, sparse = _legs(spark, d)
    settings = retrieval.SearchSettings(rerank_top_n=10, symbol_boost=0)
    out = retrieval.head_and_tail(retrieval.merge(c, dense, sparse, "", settings), retrieval.token_overlap(QUERY), settings, 15)
    return out.select("chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 9).alias("score"))


@query("with " + CORPUS_SQL + ", x as (select file from c where kind = 'method' order by file limit 1) select chunk_id, start_line, end_line from c join x using (file) where end_line >= 5 and start_line <= 60")
def read_chunks_range(spark: SparkSession, d: str) -> DataFrame:
    """R13, P4."""
    c = corpus(spark, d)
    file = c.filter("kind = 'method'").agg(F.min("file")).first()[0] or ""
    return retrieval.read_chunks(c, file, 5, 60).select("chunk_id", "start_line", "end_line")


@query(f"with {CORPUS_SQL} select chunk_id, greatest(0, least(length(content), 20000 - coalesce(sum(length(content)) over (partition by file order by start_line, end_line, chunk_id rows between unbounded preceding and 1 preceding), 0)))::bigint as allowed from c")
def output_budget(spark: SparkSession, d: str) -> DataFrame:
    """W4, K11."""
    return retrieval.output_budget(corpus(spark, d), ["file"], ["start_line", "end_line", "chunk_id"], "content").select("chunk_id", "allowed")


# ---- snapshots

# The current snapshot is the whole file table. In the old one there was no TOML yet, Markdown
# had other contents, and every shell script had a backup copy.
EXT_SQL = "lower(regexp_extract({}, '[.]([^./]+)$', 1))"
NOW_SQL = "n as (select repo || ':' || relative_path as relative_path, file_id, any_value(file_sha256) as file_sha256 from files group by all)"
OLD = f"select relative_path as file, case when {EXT_SQL.format('relative_path')} = 'md' then sha256(coalesce(file_sha256, '') || 'x') else file_sha256 end as file_sha256 from n where {EXT_SQL.format('relative_path')} <> 'toml'"


def _snapshots(spark: SparkSession, d: str):
    files = read(spark, d, "files", "repo", "relative_path", "file_id", "file_sha256").groupBy(F.concat(F.col("repo"), F.lit(":"), F.col("relative_path")).alias("file"), "file_id").agg(F.any_value("file_sha256").alias("file_sha256"))
    kind = extension(F.col("file"))
    edited = F.when(kind == "md", F.sha2(F.concat(F.coalesce("file_sha256", F.lit("")), F.lit("x")), 256)).otherwise(F.col("file_sha256"))
    gone = files.filter(kind == "sh").select(F.concat(F.col("file"), F.lit("~")).alias("file"), "file_sha256")
    old = files.filter(kind != "toml").select("file", edited.alias("file_sha256")).unionByName(gone)
    return files.select("file", "file_sha256"), old


SNAPSHOT_SQL = f"""{NOW_SQL}, g as (select distinct repo || ':' || relative_path || '~' as file, file_id, file_sha256 from files where {EXT_SQL.format("relative_path")} = 'sh'),
o as ({OLD} union all select file, any_value(file_sha256) from g group by file)"""


@query(f"with {SNAPSHOT_SQL} select coalesce(n.relative_path, o.file) as file, case when o.file is null then 'new' when n.relative_path is null then 'removed' when n.file_sha256 = o.file_sha256 then 'unchanged' else 'changed' end as status from n full join o on n.relative_path = o.file")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """J3, P5."""
    return changes.manifest_diff(*_snapshots(spark, d))


@query(f"with {SNAPSHOT_SQL} select distinct file from o where file not in (select relative_path from n)")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    now, old = _snapshots(spark, d)
    return changes.stale(old, now)


@query(f"with {SNAPSHOT_SQL} select relative_path as file, 'dense' as only_in from n where relative_path not in (select file from o) union all select distinct file, 'sparse' from o where file not in (select relative_path from n)")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    """J5, U3."""
    return changes.drift(*_snapshots(spark, d))


@query(f"with {SNAPSHOT_SQL} select o.file, o.file_sha256 from o where file in (select relative_path from n)")
def store_intersection(spark: SparkSession, d: str) -> DataFrame:
    """J4, U2."""
    now, old = _snapshots(spark, d)
    return changes.intersection(old, now)


@query(f"with {SNAPSHOT_SQL}, p as (select distinct regexp_extract(file, '^(.*)/[^/]+$', 1) as path from o where file like '%~'), t as (select distinct file from o) select distinct file from t join p on file = path or starts_with(file, path || '/')")
def vanished_prefix(spark: SparkSession, d: str) -> DataFrame:
    """J8, ST4: every file below the folders in which a file vanished."""
    old = _snapshots(spark, d)[1]
    return changes.vanished(old, old.filter("file like '%~'").select(F.regexp_extract("file", "^(.*)/[^/]+$", 1).alias("path")).distinct())


@query(f"with {CORPUS_SQL}, k as (select distinct chunk_id, chunk_sha, file from chunks), w as (select chunk_id, max(embedding::double[]) as e from embed_items where len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0 group by chunk_id), h as (select distinct file, chunk_sha from k join w using (chunk_id)) select k.chunk_id, h.file is not null as reused from k left join h on k.file = h.file and k.chunk_sha = h.chunk_sha")
def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """J7, S10."""
    keys = read(spark, d, "chunks", "chunk_id", "chunk_sha", "file").distinct()
    items = read(spark, d, "embed_items", "chunk_id", "embedding").filter(retrieval.usable("embedding", DIM)).groupBy("chunk_id").agg(F.max(F.col("embedding").cast("array<double>")).alias("embedding"))
    return changes.reuse_vectors(keys, items.join(keys, "chunk_id")).select("chunk_id", F.col("embedding").isNotNull().alias("reused"))


@query(f"with {CORPUS_SQL} select chunk_id, case when right(chunk_id, 1) = '0' then 'edited' else name end as name from c union all select 'new-' || chunk_id, name from c where right(chunk_id, 1) = '1'")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """K2, K3."""
    c = corpus(spark, d).select("chunk_id", "name")
    edited = c.filter(F.endswith("chunk_id", F.lit("0"))).select("chunk_id", F.lit("edited").alias("name"))
    new = c.filter(F.endswith("chunk_id", F.lit("1"))).select(F.concat(F.lit("new-"), F.col("chunk_id")).alias("chunk_id"), "name")
    return changes.upsert(c, edited.unionByName(new).unionByName(edited))


@query(f"with {CORPUS_SQL} select chunk_id from c where file not in (select file from c where kind = 'struct' and file is not null) or file is null")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """K4, K5."""
    c = corpus(spark, d).select("chunk_id", "file", "kind")
    return changes.delete(c, c.filter("kind = 'struct'")).select("chunk_id")


# ---- events and batches


@query("""with e as (select *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts) > 3600.0 as gap from events),
s as (select *, sum(coalesce(gap, false)::int) over (partition by user_id order by ts rows unbounded preceding) as session from e)
select user_id, session, count(*) as n, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from s group by user_id, session""")
def event_debounce(spark: SparkSession, d: str) -> DataFrame:
    """ST2, W8: bursts of a user's events."""
    rows = changes.debounce(read(spark, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", 3600.0)
    return rows.select("user_id", "session", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def event_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """ST3, U4."""
    return changes.latest_state(read(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@query("""with recursive i as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as r from documents where source is not null),
b as (select source, doc_id, r, n_chars as used, 0 as batch from i where r = 1 union all
 select i.source, i.doc_id, i.r, case when b.used + i.n_chars > 8000 then i.n_chars else b.used + i.n_chars end, case when b.used + i.n_chars > 8000 then b.batch + 1 else b.batch end from b join i on i.source = b.source and i.r = b.r + 1)
select source, doc_id, batch from b""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches for an embedding server."""
    return changes.pack(read(spark, d, "documents", "source", "doc_id", "n_chars").filter("source is not null"), ["source"], "doc_id", "n_chars", 8000)


# ---- evaluation

QRELS_SQL = """h as (select search_id, result_id, any_value(file) as file, any_value(name) as name, max(coalesce(score, -1e30)) as score, any_value(kind) as kind, any_value(lang) as lang, any_value(query_text) as q, max(dense_score) as ds, max(sparse_score) as ss from search_results group by all),
r as (select *, row_number() over (partition by search_id order by score desc, result_id) as rank from h),
e as (select search_id, min(file) as file from h group by search_id),
f as (select e.search_id, min(r.rank) as rank from e join r on r.search_id = e.search_id and r.file = e.file group by e.search_id),
x as (select e.search_id, f.rank, coalesce(min(lower(h.lang)), 'none') as category from e left join f using (search_id) join h on h.search_id = e.search_id group by all)"""
METRICS_SQL = ", ".join(["count(*) as n", "round(avg(coalesce(1.0 / rank, 0)), 4) as mrr", *[f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 4) as recall_{k}" for k in evaluate.KS]])


def _eval_rows(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "search_results", "search_id", "result_id", "file", "score", "lang").groupBy("search_id", "result_id").agg(F.any_value("file").alias("file"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(-1e30))).alias("score"), F.any_value("lang").alias("lang"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("score"), "result_id"))).withColumnRenamed("search_id", "query_id")
    qrels = hits.groupBy(F.col("search_id").alias("query_id")).agg(F.array(F.min("file")).alias("files"), F.coalesce(F.min(F.lower("lang")), F.lit("none")).alias("category"))
    return evaluate.first_hits(ranked, qrels)


@query(f"with {QRELS_SQL} select {METRICS_SQL} from x")
def eval_mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    """A4, A5, J11."""
    return evaluate.metrics(_eval_rows(spark, d))


@query(f"with {QRELS_SQL} select category, {METRICS_SQL} from x group by category")
def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return evaluate.metrics(_eval_rows(spark, d), ["category"])


@query("with h as (select result_id, max(dense_score) as ds, max(sparse_score) as ss from search_results group by result_id) select case when ds is not null and ss is not null then 'both' when ds is not null then 'dense' when ss is not null then 'sparse' else 'unknown' end as found_via, count(*) as n from h group by 1")
def eval_found_via(spark: SparkSession, d: str) -> DataFrame:
    """A9, F18."""
    hits = read(spark, d, "search_results", "result_id", "dense_score", "sparse_score").groupBy("result_id").agg(F.max("dense_score").alias("ds"), F.max("sparse_score").alias("ss"))
    return hits.groupBy(T.modality(F.col("ds"), F.col("ss")).alias("found_via")).agg(F.count("*").alias("n"))


@query("select event_type as metric, median(value) as median, min(value) as low, max(value) as high from events group by event_type")
def eval_spread(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return evaluate.spread(read(spark, d, "events", "event_type", "value").withColumnRenamed("event_type", "metric"))


@query("with o as (select event_type, list_sort(list(value)) as v from events group by event_type) select event_type, list_aggregate(v, 'median') as p50, v[least(len(v) - 1, floor(len(v) * 0.95)::int) + 1] as p95 from o")
def eval_latency(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    return evaluate.latency(read(spark, d, "events", "event_type", "value"), "value", ["event_type"])


@query("with u as (select user_id, list_sort(list_distinct(list(coalesce(event_id % 4, 99)))) as ranks from events group by user_id) select user_id as query_id, ranks from u where len(ranks) > 1")
def eval_unstable(spark: SparkSession, d: str) -> DataFrame:
    """A11."""
    return evaluate.unstable(read(spark, d, "events", "user_id", "event_id").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 4).alias("rank")))


@query("select count(*) as chunks, count(distinct chunk_id) as points, count(distinct repo || ':' || file) as files, count_if(kind is null) as plain, count_if(name is not null) as named from chunks")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2."""
    rows = read(spark, d, "chunks", "chunk_id", "repo", "file", "kind", "name")
    return rows.agg(F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("points"), F.count_distinct(F.concat("repo", F.lit(":"), "file")).alias("files"), F.count_if(F.col("kind").isNull()).alias("plain"), F.count_if(F.col("name").isNotNull()).alias("named"))


@query("""with recursive s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r from events),
f as (select user_id, r, value::double as v from s where r = 1 union all select s.user_id, s.r, 0.7 * f.v + 0.3 * s.value from f join s on s.user_id = f.user_id and s.r = f.r + 1)
select user_id, round(arg_max(v, r), 6) as ewma from f group by user_id""")
def ewma_throughput(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    rows = read(spark, d, "events", "user_id", "ts", "event_id", "value").withColumn("o", F.struct("ts", "event_id"))
    return evaluate.smoothed(rows, ["user_id"], "o", "value").select("user_id", F.round("ewma", 6).alias("ewma"))


# ---- further scalar operators and lookups


@query(f"with {CORPUS_SQL} select chunk_id, substring(content, 1, 300) as document, substring(content, 1, 160) as message, case when length(content) > 200 then 'content' else 'snippet' end as source from c where kind is null")
def text_caps(spark: SparkSession, d: str) -> DataFrame:
    """what a reranker and a log see of a text."""
    c = corpus(spark, d).filter("kind is null")
    source = F.when(F.length("content") > 200, "content").otherwise("snippet")
    return c.select("chunk_id", T.truncated(F.col("content"), 300).alias("document"), T.short_error(F.col("content")).alias("message"), source.alias("source"))


@query(f"with {CORPUS_SQL}, {VECTORS_SQL}, {DENSE_SQL}, s as (select d.chunk_id, substring(c.content, 1, 200) as snippet from dense d join c using (chunk_id)) select s.chunk_id, s.snippet, coalesce(x.content, s.snippet) as content from s left join (select * from c where kind is not null) x using (chunk_id)")
def hydrate_content(spark: SparkSession, d: str) -> DataFrame:
    """Full content for dense hits, the snippet where the other store lacks the chunk."""
    c = corpus(spark, d)
    v = vectors(spark, d, c)
    head = retrieval.dense(v, _query_vector(v), K, DIM).select("chunk_id")
    head = retrieval.snippets(c.select("chunk_id", "content")).join(F.broadcast(head), "chunk_id", "left_semi")  # at most K rows
    return retrieval.hydrate(head, c.filter("kind is not null")).select("chunk_id", "snippet", "content")


SYMBOL = "PruneCache"
_NAMED_SQL = rf"(lower('{SYMBOL}') = lower(name)) or ((contains(name, '::') or contains(name, '.')) and lower('{SYMBOL}') = lower(regexp_extract(regexp_extract(name, '(?s)(?:.*::)?(.*)', 1), '(?s)(?:.*\.)?(.*)', 1)))"


@query(f"with {CORPUS_SQL}, {_bm25_sql([['prune', 'cache']])}, r as (select c.*, coalesce(1.0 / (60 + sparse_rank + 1), 0) + case when coalesce({_NAMED_SQL}, false) then 1.0 / 61 else 0 end as rrf from sparse join c using (chunk_id)) select chunk_id, round(rrf, 9) as score from r order by round(rrf, 9) desc, chunk_id limit 10")
def symbol_boost(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's exact name outweighs a first place."""
    c = corpus(spark, d)
    sparse = retrieval.bm25(retrieval.query_postings(c, SYMBOL), SYMBOL, K)
    dense = spark.createDataFrame([], "chunk_id string, dense_score double, dense_rank int")
    merged = retrieval.merge(c, dense, sparse, SYMBOL)
    return retrieval.head_and_tail(merged, None, retrieval.SearchSettings(), 10).select("chunk_id", F.round("score", 9).alias("score"))


@query(f"with {QRELS_SQL}, g as (select search_id, arg_min(name, rank) as name, count(*) as n from r where name is not null group by search_id), y as (select search_id, name, regexp_extract(name, '(?s)(?:.*::)?(.*)', 1) as symbol from g) select round(avg(coalesce((name = symbol or suffix(name, '::' || symbol))::int, 0)), 4) as symbol_hit_rate from y")
def eval_symbol_hits(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    hits = read(spark, d, "search_results", "search_id", "result_id", "name", "score").groupBy("search_id", "result_id").agg(F.any_value("name").alias("name"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(-1e30))).alias("score"))
    first = hits.filter("name is not null").groupBy("search_id").agg(F.min_by("name", F.struct(-F.col("score"), "result_id")).alias("name"))
    return evaluate.symbol_hit_rate(first.withColumn("symbol", F.regexp_extract("name", "(?s)(?:.*::)?(.*)", 1)))


@query("with s as (select event_type as metric, median(value) as after from events where event_id >= (select (min(event_id) + max(event_id)) / 2.0e0 from events) group by event_type), b as (select event_type as metric, median(value) as before, min(value) as low, max(value) as high from events where event_id < (select (min(event_id) + max(event_id)) / 2.0e0 from events) group by event_type) select metric, before, after, after - before as delta, after between low and high as within_spread from s join b using (metric)")
def eval_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the events stands for a new run, the earlier one for its baseline; every event is used."""
    rows = read(spark, d, "events", "event_id", "event_type", "value").withColumnRenamed("event_type", "metric")
    rows = rows.join(F.broadcast(rows.agg(((F.min("event_id") + F.max("event_id")) / F.lit(2.0)).alias("middle"))), F.lit(True))
    return evaluate.against_baseline(evaluate.spread(rows.filter("event_id >= middle")), evaluate.spread(rows.filter("event_id < middle")))


@query("select distinct user_id, event_type from events")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    """U4."""
    return read(spark, d, "events", "user_id", "event_type").dropDuplicates()
