"""Words, shingles and language names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters, digits and underscores in any script.
NOT_WORD = r"[^\p{L}\p{N}_]+"

#: Extension -> language name, for rows whose language is null.
EXT_LANGUAGE = {
    "py": "python", "rs": "rust", "go": "go", "ts": "typescript", "js": "javascript", "java": "java",
    "md": "markdown", "json": "json", "toml": "toml", "yaml": "yaml", "sh": "shell",
}


def words(text: Column) -> Column:
    """Lower-cased words of ``text``; null gives null, a text without words an empty array."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def extension(path: Column) -> Column:
    """Lower-cased part after the last dot of the last path component, or ''."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def language_by_extension(path: Column) -> Column:
    """Language name told by the extension, null when it is unknown."""
    pairs = [F.lit(x) for kv in EXT_LANGUAGE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def language_of(lang: Column, path: Column) -> Column:
    """``lang`` in lower case, or what the extension of ``path`` tells where it is null or blank."""
    given = F.lower(F.trim(lang))
    return F.coalesce(F.when(given != "", given), language_by_extension(path))


def line_count(text: Column) -> Column:
    """Lines split at ``\\n``; a final newline opens no further line and '' has none."""
    return F.when(text == "", 0).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    )
