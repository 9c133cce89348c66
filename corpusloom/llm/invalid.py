"""Problem 3: source files that do not parse.

Files are lexed in Arrow batches. A file gives rows of three kinds: its distinct pairs of
adjacent token classes, all its brackets in order, and its statements. A statement is the
token classes between two ends of statements inside one bracket, one character each, with
inner brackets reduced to their marks. Its distinct shapes are listed once for a file;
those that windows read stand in their order besides. The lexer only says which tokens
stand together; it judges nothing. The checks do, over these rows:

* **Pairs** are anti-joined with those that the grammar of the language permits, derived
  from which classes can end an operand, begin one, stand between two or before one, and
  which keywords take part in declarations.
* **Nesting.** A running sum over the rows of all brackets of a file gives each one's depth;
  windows over one depth must see every opening bracket followed by the closing one of
  its kind, and no depth may fall below one.
* **Productions.** Each statement must match a production of its language for the kind of
  bracket around it. Windows over the statements of a block see clauses with the statement
  they belong to (``else``, ``catch``, ``finally``, ``while`` of ``do``), and statements
  that end in the brace of a value with what must follow. Windows over the lines of a
  Python file see headers with their deeper lines, and clauses at the same indent; a fold
  over its indents sees ways back to no open block. Keys of TOML tables are counted.

No parser stands in the way of a row; the tests compare with the parsers of the standard
library. Names, types and numbers of arguments are not looked at, and what a macro of Rust
holds between braces only by its pairs.

The extension tells the language. Null texts and other languages never count, empty
files are valid. A file whose rows differ counts if one of them does; repeated rows count
once. Only the named columns are read. A text is lexed in one task; its rows are spread
and may spill.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import add

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import extension
from ..session import keep
from . import grammar as g

def pair_table(spark: SparkSession) -> DataFrame:
    """(lang, pair): the codes of the permissible pairs of every language; its size is fixed."""
    rows = [(lang, g.CODES[a] + g.CODES[b]) for lang in [*g.KEYWORDS, "json"] for a, b in sorted(g.permissible_pairs(lang)) if a in g.CODES and b in g.CODES]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "pair"]))


class _Classes(dict):
    """Token -> the code of its class, '' where it says nothing; remembered for the first 2^17 tokens."""

    def __init__(self, lang: str):
        words = [*g.KEYWORDS[lang].split(), *g.LITERALS[lang].split()] if lang in g.KEYWORDS else []
        super().__init__({t: g.CODES[t] for t in [*words, *g.operators(lang), *g.OPEN, *g.CLOSE]})
        if lang == "json":
            self.update({t: g.CODES["l"] for t in ("true", "false", "null")})
        # words that are keywords only here and there
        self.update({"java": {"yield": g.CODES["return"]}, "rust": {"await": g.CODES["n"]}}.get(lang, {}))
        self.lang, self.number = lang, re.compile(g.NUMBER.get(lang, r".*"), re.S)

    def __missing__(self, token: str) -> str:
        found = self.tell(token)
        found = "\n" if found == "\n" else g.CODES[found] if found else ""
        if len(self) < 1 << 17:
            self[token] = found
        return found

    def tell(self, t: str) -> str:
        lang, c = self.lang, t[0]
        if c == "\n":
            return "\n"
        if t == "\\\n" or lang == "python" and c == "#" or c == "@" and len(t) > 1 or lang == "rust" and c == "#" and len(t) > 1:
            return ""
        if c == "/" and len(t) > 1:
            return g.FAULT if t == "/*" else "" if t[1] in "/*" else "0"
        if c.isalpha() or c in "_$":
            if t[-1] in "\"'" and len(t) > 1:
                return "c" if t[-1] == "'" and lang == "rust" else "s"
            return "s" if t[-1] == "#" else g.FAULT if lang == "json" else "n"
        if c.isdigit() or c in ".-" and len(t) > 1:
            return "0" if self.number.fullmatch(t) else g.FAULT
        if c in "\"'`":
            if len(t) == 1:
                return g.FAULT
            if c == "'" and lang in ("rust", "go", "java"):
                return "c" if t[-1] == "'" else "'" if lang == "rust" else g.FAULT
            return "s"
        return g.FAULT


def _set(tokens) -> str:
    return "[" + "".join(g.CODES[t] for t in tokens if t in g.CODES) + "]"


_C = g.CODES
_OPENS, _CLOSES = {_C[t]: t for t in g.OPEN}, {_C[t] for t in g.CLOSE}
#: Line ends that end no statement.
_IDLE = {
    "go": re.compile(rf"(?<!{_set(g.GO_ENDS)})\n"),
    "javascript": re.compile(rf"(?<!{_set(g.SCRIPT_ENDS)})\n|\n(?={_set(g.SCRIPT_GOES_ON)})"),
    "typescript": re.compile(rf"(?<!{_set([*g.SCRIPT_ENDS, '!', '>'])})\n|\n(?={_set(g.SCRIPT_GOES_ON)})"),
}
_STOPS = re.compile(rf"([{''.join([*_OPENS, *_CLOSES])}{_C[';']}{_C[',']}\n])")
_BRACES = re.compile(f"[{_C['{']}{_C['}']}{_C[';']}]")
_TELLING = {lang: re.compile(_set(k for k in ks)) for lang, ks in g.OPENERS.items()}
_KIND = {lang: {_C[k]: kind for k, kind in ks.items()} for lang, ks in g.OPENERS.items()}
_CUTS = {"top", "block", "members", "switch", "items", "fields", "match", "any", "enum", "types", "specs"}
_PLAIN = {"paren", "value", "for", "macro"}
#: Brackets whose statements the windows read, by language; of all others only the distinct shapes are judged.
_BLOCKS = {"top", "block", "members", "switch", "items", "any"}
_ORDERED = {"python": {"top"}, "go": {"top"}, "json": set(), "toml": {"top", "header"}} | dict.fromkeys(["rust", "java", *g.SCRIPT], _BLOCKS)
_is = lambda code, words: code in {_C[t] for t in words.split()}
_VALUE = {_C[t] for t in "= , ( [ : ? return ] && || ?? + == += := in of yield await default".split()}
_AFTER = {_C[t] for t in ") else do try finally ; }".split()} | {""}


def holds(lang: str, opener: str, outer: str, p1: str, p2: str, kw: str, fresh: bool) -> str:
    """What a bracket holds, from what the one around it holds, the codes before it and the last telling keyword of its statement."""
    told = _KIND.get(lang, {}).get(kw)
    if lang == "json":
        return "object" if opener == "{" else "array"
    if lang == "python":
        if opener == "(":
            return "params" if p2 == _C["def"] or _is(kw, "def async") else "call" if p2 == _C["class"] or _is(p1, "n ) ]") else "group"
        return "index" if opener == "[" else "set"
    if opener != "{":
        if opener == "(" and lang == "go" and _is(p1, "import var const type"):
            return "specs"
        return "for" if opener == "(" and _is(p1, "for try await") else "any" if opener == "[" and lang == "rust" else "paren"
    if lang == "java":
        if outer == "enum":
            return "members"
        if _is(p1, "= ] , ( [") or outer == "value" and p1 == _C["{"]:
            return "value"
        if p1 == _C["->"]:
            return "block"
        if told and not (kw == _C["new"] and p1 != _C[")"]):
            return told
        return "block" if _is(p1, ") else do try finally static ; } :") or not p1 or p1 == _C["{"] else "any"
    if lang == "rust":
        if p1 == _C["!"] or p1 == _C["n"] and p2 == _C["!"]:
            return "macro"
        if _is(p1, "=> || | = && else"):
            return "block"
        return told or ("value" if p1 == _C["::"] else "block" if _is(p1, "{ ; }") or not p1 else "any")
    if lang == "go":
        if _is(p1, "interface struct"):
            return "fields"
        if p1 == _C["n"] and p2 == _C["]"] or _is(p1, "= := , ( : return &"):
            return "value"
        return told or ("value" if _is(p1, "} n") and not fresh else "any")
    if p1 == _C["=>"]:
        return "block"
    if told and _is(kw, "class interface enum namespace module type switch"):
        return told
    return "block" if outer == "switch" and p1 == _C[":"] else "value" if p1 in _VALUE else "block" if p1 in _AFTER else told or "any"


class _Level:
    """An open bracket: what it holds, its number and the statement begun in it."""

    __slots__ = ("holds", "grp", "run", "parts", "indent")

    def __init__(self, holds: str, grp: int):
        self.holds, self.grp, self.run, self.parts, self.indent = holds, grp, 0, [], 0


def _keyword(lang: str, parts: list[str]) -> str:
    """The last keyword of a statement so far, behind any brace, that tells what a brace opens."""
    said = _BRACES.split("".join(parts))[-1]
    told = _TELLING[lang].findall(said) if lang in _TELLING else []
    if lang == "rust":  # ``impl`` also begins a type, which opens nothing
        told = [t for t in told if t != _C["impl"] or said[:1] == t or said[:2] in (_C["unsafe"] + t, _C["pub"] + t)]
    return told[-1] if told else ""


_SOFT = re.compile(r"(?m)^[ \t]*(?:match|case|type)\b")
#: After a type in braces a type goes on with one of these.
_TYPE_ON = {_C[t] for t in "> | & [ , = )".split()}
#: A pattern in braces goes on with one of these.
_PATTERN_ON = {_C[t] for t in "=> if | . ?".split()}
#: Names of members may be keywords.
_MEMBER = re.compile(f"(?<={_set(['.', '?.'])}){_set(g.KEYWORDS['typescript'].split())}")


def lex(text: str, lang: str, pattern: re.Pattern, classes: _Classes) -> tuple[str, str, set[tuple], list[tuple]]:
    """(distinct pairs of codes, all brackets in order, distinct (holds, shape) of statements, ordered statements (lvl, grp, run, holds, shape, indent)).

    Levels and groups only say which tokens stand together; whether brackets nest is
    for the windows to tell.
    """
    tokens = pattern.findall("\n" + text)
    codes = [classes[t] for t in tokens]
    indents = []
    if lang == "python":
        indents = [len(t[t.rfind("\n") + 1 :].expandtabs(8)) for t in tokens if t[0] == "\n"]
        if _SOFT.search(text):  # words that are keywords at a line's begin only
            for k, t in enumerate(tokens[:-2]):
                if t[0] == "\n" and tokens[k + 1] in ("match", "case", "type"):
                    word, after = tokens[k + 1], tokens[k + 2]
                    name = after in "= . : , ) += -= == != -> |".split() or after[0] == "\n" or word == "match" and after in "([" or word == "type" and codes[k + 2] != _C["n"]
                    codes[k + 1] = _C["n"] if name else _C[word]
    elif lang == "java":
        codes = [_C["class"] if t == "record" and codes[k + 1 : k + 2] == [_C["n"]] else c for k, (t, c) in enumerate(zip(tokens, codes))] if "record" in text else codes
    stream = "".join(codes)
    if lang in g.SCRIPT:
        stream = _MEMBER.sub(_C["n"], stream)
    if lang in _IDLE:
        stream = _IDLE[lang].sub("", stream)
    elif lang != "python":
        stream = stream.replace("\n", "")
    level, stack, out, seen, brackets, flat = _Level("top", 0), [], [], set(), [], []
    groups, line, prev, prev2 = 0, 0, "", ""
    rust, python, brace, script = lang == "rust", lang == "python", lang not in ("python", "json"), lang in g.SCRIPT
    comma, fault, ordered = _C[","], _C[g.FAULT], _ORDERED[lang]
    semicolon, close_brace, ends = _C[";"], _C["}"], lang in ("rust", "java", *g.SCRIPT)
    pieces = _STOPS.split(stream)  # what stands between stops, and the stops

    def cut() -> None:
        if level.parts:
            shape = "".join(level.parts)
            # what holds expressions only has no production: its pairs are judged, and separators in it
            if level.holds not in _PLAIN or semicolon in shape or shape[-1] == comma or fault in shape:
                seen.add((level.holds, shape))
                if level.holds in ordered:
                    out.append((len(stack), level.grp, level.run, level.holds, shape, level.indent))
            level.parts = []
        level.run += 1

    for k in range(0, len(pieces) - 1, 2):
        part, stop = pieces[k], pieces[k + 1]
        if part:
            level.parts.append(part)
            flat.append(part)
            prev, prev2 = part[-1], part[-2] if len(part) > 1 else prev
        if stop == "\n":
            if python:
                if not stack:
                    cut()
                    level.indent = indents[line] if line < len(indents) else 0
                    flat.append(_C["^"])
                line += 1
            else:
                if level.holds in _CUTS:
                    cut()
                    flat.append("\n")
                elif lang == "go" and level.holds in ("paren", "value"):
                    level.parts.append("\n")
                    flat.append("\n")
                elif level.holds != "paren" and not (lang == "javascript" and level.holds == "value"):
                    flat.append("\n")
            continue
        flat.append(stop)
        if stop in _OPENS:
            kw = ""
            if python:
                kw = level.parts[0][:1] if level.parts and not stack else ""
            elif stop == _C["{"] and level.parts:
                kw = _keyword(lang, level.parts)
            kind = holds(lang, _OPENS[stop], level.holds, prev, prev2, kw, not level.parts)
            brackets.append(_OPENS[stop])
            level.parts.append(stop)
            stack.append(level)
            groups += 1
            level = _Level(kind, groups)
        elif stop in _CLOSES:
            brackets.append(_CLOSE_OF[stop])
            if level.parts and level.parts[-1] == "\n" and brace:
                level.parts[-1] = g.CODES[g.FAULT]  # a value ends with its line: its comma is missing
            cut()
            if stack:
                level = stack.pop()
            level.parts.append(stop)
            if stop == close_brace and ends and level.holds in _CUTS:
                after = pieces[k + 2][:1] or (pieces[k + 3] if k + 3 < len(pieces) else "")
                if not (lang == "typescript" and after in _TYPE_ON or level.holds == "match" and after in _PATTERN_ON):
                    cut()
        elif stop == semicolon:
            level.parts.append(stop)
            if ends and level.holds in _CUTS:
                cut()
        else:
            level.parts.append(stop)
            if rust and level.holds in ("fields", "match"):
                cut()
        prev, prev2 = stop, prev
    if pieces[-1]:
        level.parts.append(pieces[-1])
        flat.append(pieces[-1])
    cut()
    while stack:
        level = stack.pop()
        cut()
    whole = "".join(flat) if lang == "python" else _C["^"] + "".join(flat)
    pairs = "".join(p for p in set(map(add, whole, whole[1:])) if "\n" not in p and p[1] != _C["^"])
    return pairs, "".join(brackets), seen, out


_CLOSE_OF = {_C[t]: t for t in g.CLOSE}


def lex_toml(text: str, pattern: re.Pattern) -> tuple[str, str, set[tuple], list[tuple]]:
    """Like ``lex``; shapes keep the keys, so that repeated ones are seen, and ``indent`` numbers the table."""
    level, stack, out, seen, brackets, ordered = _Level("top", 0), [], [], set(), [], _ORDERED["toml"]
    groups, table, before, new = 0, 0, "", True

    def cut() -> None:
        if level.parts:
            shape = " " + " ".join(level.parts) + " "
            seen.add((level.holds, shape))
            if level.holds in ordered:
                out.append((len(stack), level.grp, level.run, level.holds, shape, table))
            level.parts = []
        level.run += 1

    for t in pattern.findall(text):
        c = t[0]
        if c == "#":
            continue
        if c == "\n":
            new = True
            if not stack:
                cut()
            continue
        if c == "[" or c == "{":
            kind = "table" if c == "{" else "header" if new and not stack or before == "[" and len(stack) == 1 and level.holds == "header" and not level.parts else "array"
            table += kind == "header" and not stack
            level.parts.append(c)
            brackets.append(c)
            stack.append(level)
            groups += 1
            level = _Level(kind, groups)
        elif c == "]" or c == "}":
            brackets.append(c)
            cut()
            if stack:
                level = stack.pop()
            level.parts.append(c)
        elif c in "\"'":
            level.parts.append(g.FAULT if len(t) == 1 else "S" if t[:3] in ('"""', "'''") else "s:" + t[1:-1].replace(" ", "\u00b7").replace("\t", "\u00b7"))
        elif c in "=,":
            level.parts.append(c)
        elif _TOML_VALUE.fullmatch(t):
            level.parts.append(("b:" if _TOML_KEY.fullmatch(t) else "v:") + t.replace(" ", "\u00b7"))
        else:
            level.parts.append("k:" + t if _TOML_KEY.fullmatch(t) else g.FAULT)
        before, new = c, False
    cut()
    while stack:
        level = stack.pop()
        cut()
    return "", "".join(brackets), seen, out


_TOML_VALUE, _TOML_KEY = re.compile(g.TOML_VALUE), re.compile(g.TOML_KEY)
_ROWS = "row long, file_id {kind}, lang string, pairs string, brackets string, shapes array<struct<holds:string,shape:string>>, statements array<struct<lvl:int,grp:int,run:int,holds:string,shape:string,indent:int>>"


def lexed(files: DataFrame) -> DataFrame:
    """(row, file_id, lang, pairs, brackets, shapes, statements) of every file, from rows (file_id, lang, text)."""
    kind = files.schema["file_id"].dataType.simpleString()
    kinds = pa.struct([("holds", pa.string()), ("shape", pa.string())])
    item = pa.struct([("lvl", pa.int32()), ("grp", pa.int32()), ("run", pa.int32()), ("holds", pa.string()), ("shape", pa.string()), ("indent", pa.int32())])

    def lists(of: list, item: pa.StructType) -> pa.ListArray:
        flat = [r for o in of for r in o]
        columns = list(zip(*flat)) if flat else [()] * len(item)
        offsets = pa.array([0, *accumulate(map(len, of))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, item)], fields=list(item)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40  # repeated rows of a file keep apart
        tools = {x: (g.token_pattern(x), _Classes(x)) for x in g.LANGUAGES.values()}
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):  # the rows of few files at once
            ids, out = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                row += 1
                ids.append(row)
                text = text.replace("\r\n", "\n")
                out.append(("", "", (), ()) if not text.strip("\ufeff \t\r\n\f") else lex_toml(text, tools[lang][0]) if lang == "toml" else lex(text, lang, *tools[lang]))
            pairs, brackets, shapes, statements = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column("file_id"), batch.column("lang"), pa.array(pairs, pa.string()), pa.array(brackets, pa.string()), lists(shapes, kinds), lists(statements, item)],
                names=["row", "file_id", "lang", "pairs", "brackets", "shapes", "statements"],
            )

    return files.select("file_id", "lang", "text").mapInArrow(rows, _ROWS.format(kind=kind))


def pair_faults(lexed: DataFrame) -> DataFrame:
    """(file_id, lang) of files with an adjacent pair of classes that is not permitted."""
    pairs = lexed.filter("pairs <> ''").select("file_id", "lang", F.explode(F.regexp_extract_all("pairs", F.lit("(?s).."), 0)).alias("pair"))
    return pairs.join(F.broadcast(pair_table(lexed.sparkSession)), ["lang", "pair"], "left_anti").select("file_id", "lang")


def nesting_faults(lexed: DataFrame) -> DataFrame:
    """(row) of files whose brackets do not nest, from windows over the rows of all brackets."""
    # files are spread before they become rows, so that the windows need no exchange of rows
    rows = lexed.filter("brackets <> ''").select("row", "brackets").repartition("row").select("row", F.posexplode(F.split("brackets", "")).alias("n", "what")).filter("what <> ''")
    rows = rows.select("row", "n", F.ascii("what").alias("what"))
    opens = F.col("what").isin([ord(b) for b in g.OPEN])
    order = Window.partitionBy("row").orderBy("n")
    rows = rows.select("row", "n", "what", (F.sum(F.when(opens, 1).otherwise(-1)).over(order) + F.when(opens, 0).otherwise(1)).cast("int").alias("depth"))
    level = Window.partitionBy("row", "depth").orderBy("n")
    partner = F.when(F.col("what") == ord("("), ord(")")).otherwise(F.col("what") + 2)
    rows = rows.select("row", "depth", "what", F.lead("what").over(level).alias("next"))
    return rows.filter((F.col("depth") < 1) | (opens & ~F.col("next").eqNullSafe(partner))).select("row")


def _like(pattern: str) -> Column:
    """Whether the shape matches a pattern over classes."""
    return F.col("shape").rlike(g.coded(pattern))


def _times(token: str) -> Column:
    """How often a class stands in the shape."""
    return F.length("shape") - F.length(F.replace("shape", F.lit(g.CODES[token]), F.lit("")))


def _produced() -> Column:
    """Whether a production covers the shape; shapes of other brackets are left to the pairs.

    One pattern over language, kind and shape: as a chain of cases it becomes a method
    too large for the JVM to compile.
    """
    kinds = [f"{lang} {kind}" for lang, kind in g.PRODUCTIONS]
    pattern = "|".join(f"{kind} (?:{p})" for kind, p in zip(kinds, g.PRODUCTIONS.values()))
    kind = F.concat_ws(" ", "lang", "holds")
    return ~kind.isin(kinds) | F.concat_ws(" ", kind, "plain").rlike(rf"\A(?:{pattern})\z")


def _json_fault() -> Column:
    value = r"(?:s |0 |l |\{ \} |\[ \] )"
    whole = F.concat(F.col("shape"), F.lit(g.CODES[","]))
    pairs = F.regexp_replace(whole, g.coded(f"s : {value}, "), "")
    values = F.regexp_replace(whole, g.coded(f"{value}, "), "")
    return F.when(F.col("holds") == "top", ~_like(f"^{value}$")).when(F.col("holds") == "object", pairs != "").otherwise(values != "")


def _toml_fault() -> Column:
    key, value = r"(?:[kbs]:\S+(?: s:\S+)*)", r"(?:[sbv]:\S+|S|\[ \]|\{ \})"
    whole = F.concat(F.regexp_replace("shape", " , $", " "), F.lit(", "))
    inline = F.regexp_replace(F.concat(F.col("shape"), F.lit(", ")), rf" {key} = {value} ,(?= )", "")
    return (
        F.when(F.col("holds") == "top", ~F.col("shape").rlike(rf"^ (?:\[ \]|{key} = {value}) $"))
        .when(F.col("holds") == "header", ~F.col("shape").rlike(rf"^ (?:\[ \]|{key}) $"))
        .when(F.col("holds") == "table", inline != " ")
        .otherwise(F.regexp_replace(whole, rf" {value} ,(?= )", "") != " ")
    )


def statement_rows(lexed: DataFrame) -> DataFrame:
    """(row, file_id, lang, lvl, grp, run, holds, shape, indent): a row for each ordered statement."""
    return lexed.select("row", "file_id", "lang", F.explode("statements").alias("s")).select("row", "file_id", "lang", "s.*")


def shape_faults(lexed: DataFrame) -> DataFrame:
    """(file_id, lang, holds, shape) of statements that no production covers, each once for a file."""
    lang, shape = F.col("lang"), F.col("shape")
    plain = F.when(lang == "python", F.regexp_replace(shape, g.coded("lambda " + g._x(":") + ": "), g.CODES["not"])).otherwise(shape)
    rows = lexed.select("file_id", "lang", F.explode("shapes").alias("s")).select("file_id", "lang", "s.*").withColumn("plain", plain)
    made = ~_produced()
    for name, pattern in g.NEVER.items():
        made = made | ((lang == name) & F.col("holds").isin("top", "block", "members", "switch") & shape.rlike(pattern))
    made = made | (F.col("holds").isin("paren", "value") & lang.isin("java", "go", *g.SCRIPT) & shape.contains(g.CODES[";"])) | shape.contains(g.CODES[g.FAULT])
    made = made | ((lang == "java") & (F.col("holds") == "paren") & shape.endswith(g.CODES[","]))
    return rows.filter(F.when(lang == "json", _json_fault()).when(lang == "toml", _toml_fault()).otherwise(made)).drop("plain")


def clause_faults(statements: DataFrame) -> DataFrame:
    """Statements that lack the one before or after them which they need, by windows over the statements of a block."""
    lang, shape = F.col("lang"), F.col("shape")
    rows = statements.filter((lang.isin("rust", "java", *g.SCRIPT) & F.col("holds").isin("top", "block", "members", "switch", "items", "any")) | ((lang == "go") & (F.col("holds") == "top")))
    group = Window.partitionBy("row", "grp").orderBy("run")
    rows = rows.withColumn("head", F.substring("shape", 1, 1))
    is_ = lambda column, *tokens: F.col(column).isin([g.CODES[t] for t in tokens])
    # an else takes an if of the run of if and else statements it stands in
    other = is_("head", "else")
    ifs = F.when(lang == "rust", _times("if") + _times("let") - F.when(other, 1).otherwise(0)).otherwise(_times("if") - _times("else"))
    rows = rows.select(
        "*", ifs.alias("ifs"), F.sum(F.when(other | (lang.isin(g.SCRIPT) & (shape == g.CODES[";"])), 0).otherwise(1)).over(group).alias("chain"), F.lead("head").over(group).alias("next_head"),
        F.lead("shape").over(group).alias("next_shape"), F.lag("shape").over(group).alias("last_shape"),
    )
    balance = F.sum("ifs").over(Window.partitionBy("row", "grp", "chain").orderBy("run"))
    java_like = lang.isin("java", *g.SCRIPT)
    blocks = F.col("holds").isin("top", "block", "switch", "any")
    before, after = F.col("last_shape"), F.col("next_shape")
    like = lambda column, pattern: F.coalesce(column.rlike(g.coded(pattern)), F.lit(False))
    lost = other & (F.col("balance") < 0)
    package = (lang == "go") & (F.col("last_shape").isNull() != is_("head", "package"))
    lone_try = java_like & blocks & _like(r"try \{ \} $") & ~F.coalesce(is_("next_head", "catch", "finally"), F.lit(False))
    lone_catch = java_like & blocks & _like(r"^(?:catch (?:\( \) )?|finally )\{ \} $") & ~like(before, r"try (?:\( \) )?\{ \} $|^catch (?:\( \) )?\{ \} $")
    lone_do = java_like & blocks & _like(r"^do \{ \} $") & ~like(after, r"^while \( \) (?:; )?$")
    more, joined = F.lit(False), F.lit(False)
    for name, pattern in g.NEEDS_MORE.items():
        value = (lang == name) & F.col("holds").isin("top", "block", "members", "switch", "items") & shape.endswith(g.CODES["}"]) & shape.rlike(pattern)
        tail = F.lit(False) if name == "java" else F.col("next_head").isNull() & ~_like("^(?:let|(?:pub )?(?:use|const|static)) ")
        more = more | (value & ~F.coalesce(is_("next_head", *g.GOES_ON[name].split()), F.lit(False)) & ~tail & ~_like(r"-> \{ \} $|^(?:if|while|for|match) \S+*= "))
    weak = "( [ { ; - * & .. | < else :: + / from as of ] } in > extends implements".split()
    for name, words in g.GOES_ON.items():
        goes = (lang == name) & F.col("holds").isin("top", "block", "members", "items") & is_("head", *[w for w in words.split() if w not in weak])
        joined = joined | (goes & ~F.coalesce(before.endswith(g.CODES["}"]), F.lit(False)))
    whole = _like(r"(?:;|\}) $")
    open_end = (lang == "java") & F.col("holds").isin("top", "block", "members") & ~whole
    early = (lang == "rust") & (F.col("holds") == "block") & ~whole & F.col("next_head").isNotNull()
    late = (lang == "rust") & F.col("holds").isin("top", "items") & ~whole
    return rows.withColumn("balance", balance).filter(lost | package | lone_try | lone_catch | lone_do | more | joined | open_end | early | late)


def line_faults(statements: DataFrame) -> DataFrame:
    """(file_id, lang) of Python files whose lines do not nest, by windows over their lines."""
    line = statements.filter("lang = 'python' and lvl = 0")
    header = F.col("shape").endswith(g.CODES[":"])
    first = F.regexp_extract("shape", f"^{g.CODES['async']}?(.)", 1)
    what = F.lit("")
    for word in ("if", "elif", "else", "for", "while", "try", "except", "finally"):
        what = F.when(first == g.CODES[word], word).otherwise(what)
    order = Window.partitionBy("row").orderBy("run")
    same = Window.partitionBy("row", "indent").orderBy("run")
    line = line.select("row", "file_id", "lang", "run", "indent", header.alias("flag"), what.alias("what"))
    line = line.select(
        "*", F.lead("indent").over(order).alias("below"), F.lag("indent").over(order).alias("above"), F.lag("flag").over(order).alias("headed"), F.lead("what").over(same).alias("follows"), F.lag("what").over(same).alias("leads"),
    )
    empty = F.col("flag") & ~F.coalesce(F.col("below") > F.col("indent"), F.lit(False))
    deeper = F.coalesce(F.col("indent") > F.col("above"), F.col("indent") > 0) & ~F.coalesce("headed", F.lit(False))
    loose = (F.col("what") == "try") & ~F.coalesce(F.col("follows").isin("except", "finally"), F.lit(False))
    lost = F.lit(False)
    for k, lead in {"except": ["try", "except"], "elif": ["if", "elif"], "else": ["if", "elif", "for", "while", "try", "except"], "finally": ["try", "except", "else"]}.items():
        lost = lost | ((F.col("what") == k) & ~F.coalesce(F.col("leads").isin(lead), F.lit(False)))
    return line.filter(empty | deeper | loose | lost).select("file_id", "lang")


def dedent_faults(lexed: DataFrame) -> DataFrame:
    """(file_id, lang) of Python files that go back to an indent which no open block has: a fold over the indents of a file."""
    line = lexed.filter("lang = 'python'").select("file_id", "lang", F.transform(F.filter("statements", lambda s: s["lvl"] == 0), lambda s: s["indent"]).alias("_l"))
    zero = F.struct(F.array(F.lit(0)).alias("open"), F.lit(False).alias("bad"))

    def step(state: Column, x: Column) -> Column:
        kept = F.filter(state["open"], lambda o: o <= x)
        top = F.element_at(kept, -1)
        back = F.size(kept) < F.size(state["open"])
        return F.struct(F.when(top == x, kept).otherwise(F.concat(kept, F.array(x))).alias("open"), (state["bad"] | (back & (top != x))).alias("bad"))

    return line.filter(F.aggregate("_l", zero, step)["bad"]).select("file_id", "lang")


def repeated_keys(statements: DataFrame) -> DataFrame:
    """(file_id, lang) of TOML files in which a table, or a key of a table, comes twice."""
    single = F.col("shape").rlike(r"^ [kbs]:") & (F.col("holds") == "header") & (F.col("lvl") == 1)
    key = F.when(single, F.concat(F.lit("table"), F.col("shape"))).when((F.col("lvl") == 0) & F.col("shape").contains(" = "), F.concat(F.col("indent").cast("string"), F.substring_index("shape", " = ", 1)))
    rows = statements.filter("lang = 'toml'").withColumn("_k", F.regexp_replace(key, "(?<= )[kbs]:", "")).filter("_k is not null")
    return rows.groupBy("row", "file_id", "lang", "_k").count().filter("count > 1").select("file_id", "lang")


def with_language(files: DataFrame) -> DataFrame:
    """(file_id, repo, lang, text) of the files that count; repeated rows are kept."""
    table = F.create_map(*[F.lit(x) for kv in g.LANGUAGES.items() for x in kv])
    rows = files.select("file_id", "repo", F.try_element_at(table, extension(F.col("relative_path"))).alias("lang"), "text")
    return rows.filter("file_id is not null and lang is not null and text is not null")


def checks(lexed: DataFrame) -> dict[str, DataFrame]:
    """(file_id, lang) of the files that each check flags, files as often as they have faults."""
    statements = statement_rows(lexed)
    together = statement_rows(lexed.filter("lang <> 'toml'").select("row", "file_id", "lang", "statements").repartition("row"))  # for windows, which then need no exchange of rows
    return {
        "pairs": pair_faults(lexed), "nesting": lexed.select("row", "file_id", "lang").join(nesting_faults(lexed).distinct(), "row", "left_semi").select("file_id", "lang"), "productions": shape_faults(lexed).select("file_id", "lang"), "clauses": clause_faults(together).select("file_id", "lang"),
        "lines": line_faults(together), "dedents": dedent_faults(lexed), "keys": repeated_keys(statements),
    }


def invalid_files(files: DataFrame) -> DataFrame:
    """Distinct (file_id, lang) of files that do not parse."""
    found = list(checks(keep(lexed(with_language(files)))).values())
    return reduce(DataFrame.unionByName, found).distinct()


def rates(files: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, share) over distinct files."""
    distinct = with_language(files).groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("lang").alias("lang"))
    bad = invalid_files(files).select("file_id", F.lit(1).alias("bad"))
    counted = distinct.join(bad, "file_id", "left").groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
    return counted.withColumn("share", F.col("n_invalid") / F.col("n_files"))
