"""Identity, tokens, snippets and symbol predicates of code text, as column expressions.

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN_BYTES = 40
#: Fixed value: the OID namespace of RFC 4122.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def sha256_hex(text: Column) -> Column:
    """hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def uuid5(name: Column) -> Column:
    """UUIDv5 of a name in the OID namespace, from SHA-1 and bit operations."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(name, "UTF-8"))), 1, 32)
    high = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int")
    variant = F.lower(F.lpad(F.hex(high.bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))), 2, "0"))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def chunk_uuid(path: Column, start: Column, end: Column, chunk_sha: Column) -> Column:
    """the stable id of a chunk."""
    return uuid5(F.concat(path, F.lit("|"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("|"), chunk_sha))


def code_tokens(text: Column) -> Column:
    """identifiers cut at underscores and humps, lower-cased; parts over 40 bytes are dropped."""
    spaced = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_]+|_+", " ")
    spaced = F.regexp_replace(spaced, r"([\p{IsLowercase}\p{N}])(\p{IsUppercase})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{IsUppercase})(\p{IsUppercase}\p{IsLowercase})", "$1 $2")
    return F.transform(F.filter(F.split(spaced, " +"), lambda x: (x != "") & (F.octet_length(x) <= MAX_TOKEN_BYTES)), F.lower)


def query_words(query: Column) -> Column:
    """the words of a query, each as its tokens; operator characters mean nothing."""
    words = F.filter(F.split(F.translate(query, ":", " "), r"\s+"), lambda w: w != "")
    return F.filter(F.transform(words, code_tokens), lambda w: F.size(w) > 0)


def snippet(text: Column) -> Column:
    """the first 200 characters."""
    return F.substring(text, 1, 200)


def preview(text: Column, cap: int) -> Column:
    """white space collapsed, cut to ``cap`` characters (240 on a terminal, 600 for a model)."""
    return F.substring(F.btrim(F.regexp_replace(text, r"\s+", " ")), 1, cap)


def truncated(text: Column, cap: int) -> Column:
    """texts over ``cap`` characters cut to it."""
    return F.substring(text, 1, cap)


def short_error(message: Column) -> Column:
    """at most 160 characters of a message."""
    return F.substring(message, 1, 160)


def looks_like_identifier(token: Column) -> Column:
    """an underscore, ``::``, a dot or a capital after the first character."""
    return token.rlike(r"_|::|\.|^.+\p{Lu}")


def symbol_tokens(query: Column) -> Column:
    """Tokens of a query for symbol lookup: split at what identifiers don't hold, trimmed of ``:`` and ``.``."""
    parts = F.split(query, r"[^\p{IsAlphabetic}\p{N}_:.]+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[:.]+|[:.]+$", "")), lambda x: x != "")


def is_bare_symbol_query(query: Column) -> Column:
    """one or two tokens, all of them identifier-like."""
    tokens = symbol_tokens(query)
    return F.size(tokens).between(1, 2) & F.forall(tokens, looks_like_identifier)


def query_names_symbol(query: Column, name: Column) -> Column:
    """F8: whether a token of the query is the symbol's full name, or its tail where the name is qualified."""
    qualified = name.contains("::") | name.contains(".")
    tail = F.regexp_extract(F.regexp_extract(name, r"(?s)(?:.*::)?(.*)", 1), r"(?s)(?:.*\.)?(.*)", 1)

    def names(token: Column) -> Column:
        marked = looks_like_identifier(token)
        exact = (token == name) & token.rlike(r"^\p{Lu}")
        full = (F.lower(token) == F.lower(name)) & (qualified | marked | exact)
        return full | (qualified & marked & (F.lower(token) == F.lower(tail)))

    return F.coalesce(F.exists(symbol_tokens(query), names), F.lit(False))


def slug(text: Column) -> Column:
    """runs of characters outside ``[A-Za-z0-9_-]`` become one underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_")


def collection_name(project: Column, root: Column) -> Column:
    """slug of the project and eight hex digits that tell roots apart."""
    return F.concat(slug(project), F.lit("_"), F.substring(project_fingerprint(project, root), 1, 8))


def project_fingerprint(project: Column, root: Column) -> Column:
    """hash of project id and root."""
    return F.sha2(F.concat(project, F.lit("\u0000"), root), 256)


# What error messages of model servers say, in the order in which the rules apply.
TOO_BIG = ["too large to process", "exceeds context", "exceeds the context", "input is too large", "input is too long", "input length", "token limit"]
SERVER_DOWN = ["loading model", "connection refused"]
PERMANENT = ["http 400", "http 401", "http 403", "http 404", "http 415", "http 422"]
AMBIGUOUS = ["timed out", "timeout", "connection closed", "connection reset", "broken pipe", "http 500", "http 502", "http 503", "http 504"]


def classify_error(message: Column) -> Column:
    """The first rule whose words occur in the lower-cased message; unknown errors are permanent."""
    low = F.lower(message)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return (
        F.when(any_of(TOO_BIG), "WorkloadTooBig").when(any_of(SERVER_DOWN), "ServerDown").when(any_of(PERMANENT), "PermanentBad")
        .when(any_of(AMBIGUOUS), "Ambiguous").otherwise("PermanentBad")
    )


def modality(dense: Column, sparse: Column) -> Column:
    """which legs found a hit."""
    return F.when(dense.isNotNull() & sparse.isNotNull(), "both").when(dense.isNotNull(), "dense").when(sparse.isNotNull(), "sparse").otherwise("unknown")
