"""Problem 2: functions paired with their documentation.

The text of each function is lexed inside the JVM into token rows. Windows over
one function's tokens give the nesting depth before each token, the place where its
code begins (the first code at depth 0 that is neither comment, attribute nor
annotation, nor within an annotation's brackets) and, in Python, where its header
ends. Comments above that place are islands between gaps (blank lines, in Go);
lag windows attach a string to the header it follows.

Documentation is the docstring in Python; ``///``, ``/** */`` and ``#[doc]`` above
the function in Rust; the ``//`` lines directly above it in Go, directives
excepted; the last ``/** */`` above it in Java, TypeScript and JavaScript. Other
comments, and whatever lies within the function, don't count.

A pair comes out when the documentation has ``min_words`` words besides those of
the function's name and parameters, tags with their argument and to-do markers.
Rows of other kinds or languages, null or empty texts and null ids give none. A
null name excludes no words. Rows repeated under one chunk_id count once. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import language_of, words

KINDS = ["fn", "method", "impl_method"]
MIN_WORDS = 4

_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'
_TICK = r"'(?:[^'\\\n]++|\\[\s\S])*+'"
_C_COMMON = r"/\*[\s\S]*?\*/|//[^\n]*|"
_RUN = r"[^\s/\"'`#@(){}\[\]\n][^/\"'`#@(){}\[\]\n]*+"
#: Token patterns; what none of them matches is skipped.
PATTERNS = {
    "rust": _C_COMMON + r"r#*\"[\s\S]*?\"#*|" + _STRING + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|#!?\[(?:[^\]\"]++|" + _STRING + r")*+\]|[(){}\[\]]|\n[ \t\r]*\n|" + _RUN + r"|[/'`#@]",
    "go": _C_COMMON + _STRING + r"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|[(){}\[\]]|\n[ \t\r]*\n|" + _RUN + r"|[/'`#@]",
    "java": _C_COMMON + r'"""[\s\S]*?"""|' + _STRING + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'|@[\w.]++|[(){}\[\]]|" + _RUN + r"|[/'`#@]",
    "typescript": _C_COMMON + _STRING + "|" + _TICK + r"|`(?:[^`\\]++|\\[\s\S])*+`|@[\w.]++|[(){}\[\]]|" + _RUN + r"|[/'`#@]",
    "python": (
        r'[rRuUbBfF]{0,2}(?:"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|" + r'"(?:[^"\\\n]++|\\[\s\S])*+"|' + _TICK + ")"
        r"|#[^\n]*|\n|[(){}\[\]:]|(?:async[ \t]+)?def\b|[^\s\"'#(){}\[\]:][^\"'#(){}\[\]:\n]*+|[\"']"
    ),
}
PATTERNS["javascript"] = PATTERNS["typescript"]

_TAG = r"@(?:param|arg|argument|prop|property|throws|exception|see|template|typeparam|type|typedef|link|linkplain)[ \t]+(?:\{[^}]*\}[ \t]*)?[\w$.#:\[\]]+|[@\\]\w+|:(?:param|parameter|arg|argument|type|raises|raise|except|exception|var|ivar|cvar|return|returns|rtype|keyword|kwarg)(?:[ \t]+[\w*., ]+)?:"
_TODO = r"(?i)\b(?:TODO|FIXME|XXX|TBD)\b(?:\([^)]*\))?|\b(?-i:HACK|WIP)\b"


def _subwords(names: Column) -> Column:
    """Every name of an array in lower case, whole and cut at underscores and humps."""
    cut = lambda x: F.split(F.lower(F.regexp_replace(F.regexp_replace(x, r"(\p{Ll}|\p{N})(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")), "_")
    return F.array_union(F.transform(names, F.lower), F.flatten(F.transform(names, cut)))


def _parameters(text: Column, name: str, lang: Column) -> Column:
    """Names of the parameters in the first brackets after the function's name."""
    quoted = F.concat(F.lit(r"\b\Q"), F.col(name), F.lit(r"\E\s*(?:<[^(]*>|\[[^(]*\])?\s*\(([^)]*)\)"))
    inside = F.split(F.call_function("regexp_extract", text, quoted, F.lit(1)), ",")
    first, last = r"^[\s.*&]*(?:mut\s+)?(\w+)", r"(\w+)\s*\z"
    return F.when(lang == "java", F.transform(inside, lambda x: F.regexp_extract(x, last, 1))).otherwise(F.transform(inside, lambda x: F.regexp_extract(x, first, 1)))


def documentation(chunks: DataFrame) -> DataFrame:
    """(chunk_id, lang, doc) of every function row with documentation; ``doc`` keeps its markers."""
    lang = language_of(F.col("lang"), F.col("file"))
    rows = chunks.filter(F.col("kind").isin(KINDS)).select("chunk_id", lang.alias("lang"), "text").filter(F.col("lang").isin(list(PATTERNS)) & F.col("chunk_id").isNotNull())
    rows = rows.dropDuplicates(["chunk_id"])
    lexed = F.lit(None).cast("array<string>")
    for name, pattern in PATTERNS.items():
        lexed = F.when(F.col("lang") == name, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(lexed)
    tok = rows.select("chunk_id", "lang", F.posexplode(lexed).alias("pos", "tok"))

    t = F.col("tok")
    python = F.col("lang") == "python"
    comment = F.when(python, t.startswith("#")).otherwise(t.startswith("//") | t.startswith("/*"))
    string = t.rlike(r"(?s)^[rRuUbBfF]{0,2}[\"'].*[\"']\z")
    kind = (
        F.when(comment, "comment").when(F.btrim(t, F.lit(" \t\r\n")) == "", "gap").when(t.isin("(", "[", "{"), "open").when(t.isin(")", "]", "}"), "close")
        .when(~python & t.startswith("#"), "attribute").when(~python & t.startswith("@"), "annotation").when(string, "string")
        .when(python & t.endswith("def"), "def").when(python & (t == ":"), "colon").otherwise("code")
    )
    tok = tok.withColumn("cls", kind)
    by = Window.partitionBy("chunk_id").orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("chunk_id")
    step = F.when(F.col("cls") == "open", 1).when(F.col("cls") == "close", -1).otherwise(0)
    tok = tok.select(
        "*",
        F.coalesce(F.sum(step).over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.sum(F.when(F.col("cls") == "gap", 1).otherwise(0)).over(before), F.lit(0)).alias("island"),
        F.coalesce(F.sum(F.when(F.col("cls") == "def", 1).otherwise(0)).over(before), F.lit(0)).alias("defs"),
        F.last(F.when(~F.col("cls").isin("comment", "gap"), F.col("pos")), ignorenulls=True).over(before).alias("follows"),
        F.lead("cls").over(by).alias("next"),
    )
    flat = F.col("depth") == 0
    begins = F.when(python, (F.col("cls") == "colon") & flat & (F.col("defs") > 0)).otherwise((F.col("cls") == "code") & flat)
    tok = tok.select("*", F.min(F.when(begins, F.struct("pos", "island"))).over(whole).alias("at"))
    docstring = (F.col("cls") == "string") & (F.col("follows") == F.col("at.pos")) & F.coalesce(F.col("next").isin("gap", "comment"), F.lit(True)) & ~t.rlike(r"^[rRuU]*[bBfF]")
    above = F.col("pos") < F.col("at.pos")
    lang_is = lambda *x: F.col("lang").isin(*x)
    doc = (
        (python & docstring)
        | (lang_is("rust") & above & (t.rlike(r"^///(?!/)|^/\*\*(?![*/])") | t.rlike(r"^#\[\s*doc\s*=")))
        | (lang_is("go") & above & t.startswith("//") & (F.col("island") == F.col("at.island")) & ~t.rlike(r"^//(?:[a-z0-9]+:[a-z0-9]|line |extern |export |nolint)|^// \+build"))
        | (lang_is("java", "typescript", "javascript") & above & t.rlike(r"^/\*\*(?!/)"))
    )
    content = F.when(lang_is("rust") & t.startswith("#"), F.regexp_replace(t, r"^#\[\s*doc\s*=", "")).when(python, F.regexp_replace(t, r"^[rRuU]+(?=[\"'])", "")).otherwise(t)
    found = tok.filter(doc).groupBy("chunk_id", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", content.alias("tok")))).alias("d"))
    parts = F.transform("d", lambda x: x["tok"])
    return found.select("chunk_id", "lang", F.when(lang_is("java", "typescript", "javascript"), F.element_at(parts, -1)).otherwise(F.array_join(parts, "\n")).alias("doc"))


def doc_pairs(chunks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(chunk_id, lang, name, doc, code, n_words) of functions whose documentation says something."""
    docs = documentation(chunks.select("chunk_id", "file", "lang", "kind", "text"))
    docs = docs.withColumn("said", words(F.regexp_replace(F.regexp_replace("doc", _TAG, " "), _TODO, " ")))
    named = chunks.filter(F.col("kind").isin(KINDS)).select(
        F.col("chunk_id").alias("_id"), F.coalesce("name", F.lit("")).alias("_name"), "name", "text",
        F.regexp_extract(F.coalesce("name", F.lit("")), r"([\w$]*)\W*\z", 1).alias("_tail"), language_of(F.col("lang"), F.col("file")).alias("_lang"),
    )
    parameters = F.when(F.col("_tail") == "", F.array().cast("array<string>")).otherwise(_parameters(F.col("text"), "_tail", F.col("_lang")))
    own = _subwords(F.concat(F.array("_tail", "_name"), parameters))
    # worked out below the join, so that no filter over words works it out again for each of them
    source = named.select("_id", "name", F.col("text").alias("code"), own.alias("own"))
    pairs = docs.join(source, F.col("chunk_id") == F.col("_id"))
    pairs = pairs.withColumn("n_words", F.size(F.filter("said", lambda w: ~F.array_contains(F.col("own"), w))))
    return pairs.filter(F.col("n_words") >= min_words).select("chunk_id", "lang", "name", "doc", "code", "n_words").dropDuplicates(["chunk_id"])
