"""Line windows, sentences and headings (C1-C7, C20, W3), and the choice of a strategy per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import syntax

SCHEMA = "file string, start_line long, end_line long, kind string, name string, text string"
STRATEGIES = ("lines", "headings", "tree-sitter")
_SENTENCE = re.compile(r".*?[.!?](?:[ \t\n]+|\Z)|.+\Z", re.S)


@dataclass(frozen=True)
class ChunkRule:
    """How one language is cut; sizes are lines, and bytes of UTF-8."""

    strategy: str = "lines"
    max_lines: int = 80
    overlap: int = 15
    max_bytes: int = 20_000

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown chunking strategy {self.strategy!r}")
        if self.max_lines < 1 or self.max_bytes < 1 or not 0 <= self.overlap < self.max_lines:
            raise ValueError("chunk sizes must be positive and the overlap below max_lines")


@dataclass(frozen=True)
class ChunkRules:
    """A default rule and rules of single languages."""

    default: ChunkRule = ChunkRule()
    per_language: dict[str, ChunkRule] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for lang, rule in self.per_language.items():
            if rule.strategy == "tree-sitter" and lang not in syntax.LANGUAGES:
                raise ValueError(f"no syntax chunking for {lang!r}")

    def of(self, lang: str | None) -> ChunkRule:
        return self.per_language.get(lang or "", self.default)


def split_lines(text: str) -> list[str]:
    """Lines at ``\\n`` without a trailing ``\\r``; no phantom last line, none at all in ''."""
    return [x[:-1] if x.endswith("\r") else x for x in text.removesuffix("\n").split("\n")] if text else []


def lines_of(text: Column) -> Column:
    """C3 as a column expression."""
    cut = F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def sentences(text: str, max_bytes: int) -> list[str]:
    """Whole sentences packed up to a limit; one over the limit stays whole."""
    out, size = [], 0
    for part in _SENTENCE.findall(text):
        n = len(part.encode())
        if out and size + n <= max_bytes:
            out[-1] += part
            size += n
        else:
            out.append(part)
            size = n
    return out


def line_chunks(text: str, rule: ChunkRule, first: int = 1) -> list[tuple[int, int, str]]:
    """C4: windows of lines with overlap as (start, end, text); an overlong line is cut into sentences of the same line."""
    lines = split_lines(text)
    sizes = [len(x.encode()) for x in lines]
    out, i = [], 0
    while i < len(lines):
        if sizes[i] > rule.max_bytes:
            out += [(first + i, first + i, s) for s in sentences(lines[i], rule.max_bytes)]
            i += 1
            continue
        end, size = i, 0
        while end < len(lines) and end - i < rule.max_lines:
            more = sizes[end] + 1  # each line counts with its end, the first as well
            if end > i and size + more > rule.max_bytes:
                break
            size += more
            end += 1
        out.append((first + i, first + end - 1, "\n".join(lines[i:end])))
        if end >= len(lines):
            break
        n = end - i
        i += n - rule.overlap if n > rule.overlap else n
    return out


def heading_chunks(text: str, rule: ChunkRule) -> list[tuple[int, int, str]]:
    """Sections between level 1 and 2 headings outside fences; oversized ones are packed line by line."""
    lines = split_lines(text)
    cuts, fenced = [0], False
    for i, line in enumerate(lines):
        bare = line.lstrip()
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and i > 0 and re.match(r"##?[ \t]", bare):
            cuts.append(i)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(lines)]):
        section = "\n".join(lines[a:b])
        if not section.strip():
            continue
        if len(section.encode()) <= rule.max_bytes:
            out.append((a + 1, b, section))
        else:
            out += line_chunks(section, ChunkRule("lines", max(len(lines), 1), 0, rule.max_bytes), a + 1)
    return out


def chunk_text(text: str, lang: str | None, rules: ChunkRules) -> list[tuple[int, int, str | None, str | None, str]]:
    """Chunks (start, end, kind, name, text) by the rule of the language."""
    rule = rules.of(lang)
    if rule.strategy == "headings":
        return [(a, b, None, None, t) for a, b, t in heading_chunks(text, rule)]
    if rule.strategy == "tree-sitter" and lang in syntax.LANGUAGES:
        out = []
        for a, b, kind, name, t in syntax.parse(text, lang):
            if len(t.encode()) <= rule.max_bytes:
                out.append((a, b, kind, name, t))
            else:  # C9: cut by lines under the same name
                out += [(x, y, kind, name, part) for x, y, part in line_chunks(t, rule, a)]
        if out or not text.strip():
            return out
    return [(a, b, None, None, t) for a, b, t in line_chunks(text, rule)]


def chunk_files(files: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Every row (file, lang, text) cut by the rule of its language; null texts give no chunks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *c) for f, lang, text in zip(pdf["file"], pdf["lang"], pdf["text"]) for c in chunk_text(text, lang, rules)]
            yield pd.DataFrame(rows, columns=["file", "start_line", "end_line", "kind", "name", "text"])

    return files.select("file", "lang", "text").filter("text is not null").mapInPandas(cut, SCHEMA)


def heading_sections(files: DataFrame) -> DataFrame:
    """C6, W3 in SQL terms: fences and headings become running sums, sections become groups."""
    lines = files.select("file", F.posexplode(lines_of(F.col("text"))).alias("i", "line"))
    bare = F.regexp_replace("line", r"(?U)^\s+", "")
    order = Window.partitionBy("file").orderBy("i")
    lines = lines.withColumn("fence", F.when(bare.startswith("```"), 1).otherwise(0)).withColumn("bare", bare)
    lines = lines.withColumn("open", F.sum("fence").over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    cut = (F.col("i") > 0) & (F.col("open") == 0) & (F.col("fence") == 0) & F.col("bare").rlike(r"^##?[ \t]")
    lines = lines.withColumn("section", F.sum(cut.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy("file", "section").agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), text.alias("text"))
    return out.filter(F.regexp_replace("text", r"(?U)\s", "") != "").drop("section")
