"""Problem 1: generated, minified or vendored source files and data dumps in code.

Each file of a programming language is looked at in four ways.

* Its path: directories of third-party code or build output, and names that tools
  give to what they write.
* Its leading comment, lexed from the text before any code: a note by a generator or
  of a copy from elsewhere, or a copyright of others than the repository. The same
  words in strings, or in comments further down, say nothing.
* Its shape: minified code (long lines, hardly any white space) and data dumps (most
  tokens are literals or separators).
* Its fingerprints: token streams, with names and literals kept and layout and
  comments dropped, are hashed in runs of ``run`` tokens and winnowed by windows of
  ``window`` runs (Schleimer et al. 2003). A file of which at least ``share`` of the
  fingerprints occur in ``min_repos`` or more repositories is a copy.

Files of other languages (json, toml, yaml, shell, markdown) never count. Null or
empty texts are judged by path alone; a null path gives language and path no say. A
null repository counts as one of its own. Repeated rows of a file count once for
each (file_id, text). Only the named columns are read. A fingerprint that a third of
all files share is combined within each task before it is counted, and salted by file
where files are joined with the common fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import extension

CODE = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "js": "javascript", "java": "java"}
RUN, WINDOW, MIN_REPOS, SHARE = 8, 24, 8, 0.8
SALTS = 16

VENDOR_DIR = r"(?:^|/)(?:vendor|vendored|third_party|third-party|thirdparty|external|externals|node_modules|bower_components|site-packages|deps|Godeps|Pods)/"
VENDOR_TREE = r"(?:^|/)contrib/[\w.-]+-\d+(?:\.[\dx]+)*/"
BUILD_DIR = r"(?:^|/)(?:_generated|__generated__|generated|generated-sources|generated-src|autogen)/"
TOOL_NAME = r"(?:^|/)(?:zz_generated\.[^/]*|[^/]*\.(?:gen|generated|g)\.[A-Za-z]+|[^/]*_generated\.[A-Za-z]+|[^/]*\.pb\.(?:go|ts|js)|[^/]*_pb2(?:_grpc)?\.pyi?|[^/]*_pb\.(?:js|ts)|[^/]*[.-]min\.m?js|[^/]*\.bundle\.m?js)\z"

#: Notes in a leading comment, matched at the start of one of its lines.
TOOL_NOTE = (
    r"(?i)^(?:code generated by \S+|@generated\b|<auto-?generated\b|auto-?generated (?:by|from) \S+|do not edit!? +output of|generated from the \S+ schema"
    r"|generated by \S+[.;,] *do not (?:edit|modify)|this (?:file|source|code) (?:was|is|has been) (?:automatically |auto-?)?(?:created|generated|produced|written) by \S+"
    r"|machine-(?:written|generated) by \S+|automatically generated by \S+|erzeugt von \S+|g[ée]n[ée]r[ée] par \S+|generado por \S+)"
)
COPY_NOTE = (
    r"(?i)^(?:vendored from \S+|third-party code:|copied (?:verbatim |unchanged )?from the \S+ (?:project|library|repository)|upstream: \S+@\d"
    r"|@license \S+ v?\d|@preserve\b|\S+ v?\d+(?:\.\d+)+ - https?://\S+|\S+ v\d+(?:\.\d+)+\s*\z|bundled copy of \S+|imported (?:unchanged )?from \S+ \d)"
)
HOLDER = r"(?i)^(?:SPDX-FileCopyrightText:\s*(?:\d{4}\s+)?(.+?)\s+contributors|\(c\)\s*\d{4}\s+(.+?)\s+project\b.*|copyright\s+(?:\(c\)\s*)?\d{4}\s+the\s+(.+?)\s+authors\b.*)\s*\z"

#: The comments before any code, and what marks their lines.
LEAD = {
    "python": r"^(?:\s*#[^\n]*)+",
    "c": r"^(?:\s*(?://[^\n]*|/\*[\s\S]*?\*/))+",
}
#: A number or string with the separator after it, as data dumps repeat them.
LITERAL = r"""(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[,;\]})]\s*|b?"(?:[^"\\\n]|\\.)*+"\s*[,;\]})]\s*|"[A-Za-z0-9+/=]{40,}"\s*|'(?:[^'\\\n]|\\.)*+'\s*[,;\]})]\s*"""
_LINE_MARK = r"(?m)^[ \t]*(?:/{2,}!?|/\*+!?|\*+/?|#+!?)[ \t]?|\*/[ \t]*\r?$|\r$"

# Comments match without a group, so that findall() gives '' for them and the token for the rest.
_TOKEN = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|([^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\s\w])")
_TOKEN_HASH = re.compile(r"#[^\n]*|(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w])")


def path_reason(path: Column) -> Column:
    """'vendored' or 'generated' or 'minified' where the path tells, else null."""
    return (
        F.when(path.rlike(VENDOR_DIR) | path.rlike(VENDOR_TREE), "vendored")
        .when(path.rlike(r"(?:[.-]min|\.bundle)\.m?js\z"), "minified")
        .when(path.rlike(BUILD_DIR) | path.rlike(TOOL_NAME), "generated")
    )


def lead_lines(text: Column, lang: Column) -> Column:
    """Lines of the comments that precede any code, without comment marks."""
    lead = F.when(lang == "python", F.regexp_extract(text, LEAD["python"], 0)).otherwise(F.regexp_extract(text, LEAD["c"], 0))
    return F.transform(F.split(F.regexp_replace(lead, _LINE_MARK, ""), "\n"), lambda x: F.trim(x))


def note_reason(lines: Column, repo: Column) -> Column:
    """What the lines of a leading comment tell."""
    said = lambda p: F.exists(lines, lambda x: x.rlike(p))
    holder = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, HOLDER, k), F.lit("")) for k in (1, 2, 3)])
    foreign = F.exists(lines, lambda x: F.coalesce(F.lower(holder(x)) != F.lower(repo), F.lit(False)))
    return F.when(said(TOOL_NOTE), "generated").when(said(COPY_NOTE) | foreign, "vendored")


def shape_reason(text: Column) -> Column:
    """'minified' or 'data' from shares of the characters, on texts of some length."""
    n = F.length(text)
    white = 1 - F.length(F.regexp_replace(text, r"\s+", "")) / n
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    literal = 1 - F.length(F.regexp_replace(text, LITERAL, "")) / n
    return F.when(n >= 200, F.when((white < 0.06) & (n / lines >= 100), "minified").when((n >= 400) & (literal > 0.6), "data"))


def fingerprints(tokens: list[int], run: int, window: int) -> np.ndarray:
    """Winnowed distinct hashes of the runs of a token stream."""
    h = np.array(tokens, dtype=np.uint64)
    if len(h) < run:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(h) - run + 1, dtype=np.uint64)
        for k in range(run):
            acc = acc * np.uint64(0x100000001B3) + h[k : len(h) - run + 1 + k]
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    if len(acc) <= window:
        return np.unique(acc.min(keepdims=True)).view(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(acc, window)
    return np.unique(view.min(axis=1)).view(np.int64)


class _Hashes(dict):
    """Token -> 64-bit hash, remembered for the first 2^18 tokens."""

    def __missing__(self, token: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(token)
        if len(self) < 1 << 18:
            self[token] = h
        return h


def _token_hashes(text: str, lang: str, hashes: _Hashes) -> list[int]:
    return [hashes[t] for t in (_TOKEN_HASH if lang == "python" else _TOKEN).findall(text) if t]


def copied(files: DataFrame, run: int = RUN, window: int = WINDOW, min_repos: int = MIN_REPOS, share: float = SHARE) -> DataFrame:
    """Keys of files most of whose fingerprints recur across repositories, from rows (key, repo, lang, text)."""
    kind = files.schema["key"].dataType.simpleString()

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            marks = [fingerprints(_token_hashes(t, lang, cache), run, window) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            offsets = np.r_[0, np.cumsum([len(m) for m in marks])].astype(np.int32)
            flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("repo"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "repo", "marks"])

    marks = files.select("key", "repo", "lang", "text").mapInArrow(fingerprint, f"key {kind}, repo long, marks array<bigint>")
    rows = marks.select("key", "repo", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    # distinct (mark, repo) is combined before the shuffle; only marks of enough repositories go on
    common = rows.select("mark", "repo").distinct().groupBy("mark").count().filter(F.col("count") >= min_repos).select("mark")
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(common, ["mark", "salt"], "left_semi").groupBy("key").agg((F.count("*") / F.max("n")).alias("s")).filter(F.col("s") >= share).select("key")


def judge(files: DataFrame, **knobs) -> DataFrame:
    """(file_id, lang, reason) of every distinct file; ``reason`` is null for hand-written ones."""
    by_extension = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    rows = files.select("file_id", "repo", "relative_path", "text").filter("file_id is not null")
    rows = rows.withColumn("lang", F.try_element_at(by_extension, extension(F.col("relative_path"))))
    code = rows.filter("lang is not null")
    lines = code.withColumn("lines", lead_lines(F.col("text"), F.col("lang")))
    told = F.coalesce(path_reason(F.col("relative_path")), note_reason(F.col("lines"), F.col("repo")), shape_reason(F.col("text")))
    own = lines.select("file_id", "lang", told.alias("reason"))
    keyed = code.filter("text is not null").select(F.col("file_id").alias("key"), F.coalesce(F.xxhash64("repo"), F.xxhash64("file_id")).alias("repo"), "lang", "text")
    copies = copied(keyed, **knobs).select(F.col("key").alias("file_id"), F.lit(None).cast("string").alias("lang"), F.lit("copied").alias("reason"))
    other = rows.filter("lang is null").select("file_id", "lang", F.lit(None).cast("string").alias("reason"))
    both = own.unionByName(copies).unionByName(other)
    return both.groupBy("file_id").agg(F.max("lang").alias("lang"), F.min("reason").alias("reason"))
