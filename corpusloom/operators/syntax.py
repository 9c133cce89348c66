"""Syntax-aware chunks (C8-C19): Python by its own parser, other languages by a scanner.

The scanner blanks out comments and strings, matches braces and reads the declarations
before them. It is an approximation: it knows declarations, not expressions.
"""

from __future__ import annotations

import ast
import re
import warnings

LANGUAGES = {"python", "rust", "dart", "cpp", "typescript", "javascript", "go", "csharp", "java", "kotlin", "swift"}
Item = tuple[int, int, str | None, str | None, str]

_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|r#*\"[\s\S]*?\"#+|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'|'\\[^'\n]*'")
_NOISE_QUOTED = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)*'")

_MODS = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|declare|override|virtual|sealed|open|data|inline|suspend|const|unsafe|extern|readonly|partial|mutating|fileprivate|external|operator|lateinit|inner|enum(?=\s+class)|annotation(?=\s+class)|native|synchronized|strictfp|new|explicit|constexpr|factory|late|convenience|required|indirect|infix|tailrec|base|mixin(?=\s+class)|interface(?=\s+class)|@\w+(?:\([^)]*\))?)\s+)*"
_ARGS = r"\s*(?:<[^{}()]*>)?\s*\("
_NAME = r"([A-Za-z_$][\w$]*)"


def _rules(*rows: tuple[str, str, bool]) -> list[tuple[re.Pattern, str, bool]]:
    return [(re.compile(p, re.M), kind, holds) for p, kind, holds in rows]


#: Per language: (declaration at the start of an item, kind, whether its members are read as well).
RULES = {
    "rust": _rules(
        (rf"{_MODS}fn\s+{_NAME}", "fn", False), (rf"{_MODS}struct\s+{_NAME}", "struct", False), (rf"{_MODS}enum\s+{_NAME}", "enum", False), (rf"{_MODS}trait\s+{_NAME}", "trait", False),
        (rf"{_MODS}union\s+{_NAME}", "union", False), (rf"{_MODS}type\s+{_NAME}", "type", False), (rf"(?:pub(?:\([^)]*\))?\s+)?const\s+{_NAME}", "const", False), (rf"(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?{_NAME}", "static", False),
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:use|extern\s+crate)\b()", "use", False), (rf"macro_rules!\s*{_NAME}", "macro", False), (rf"{_MODS}mod\s+{_NAME}", "mod", True), (r"(?:unsafe\s+)?impl\b()", "impl", True),
        (rf"{_NAME}(?:::\w+)*!\s*[({{\[]", "macro", False),
    ),
    "go": _rules((rf"func\s+{_NAME}", "fn", False), (rf"func\s*\(([^)]*)\)\s*{_NAME}", "method", False), (rf"type\s+{_NAME}\s+struct", "struct", False), (rf"type\s+{_NAME}\s+interface", "interface", False), (rf"type\s+{_NAME}", "type", False)),
    "java": _rules(
        (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}@interface\s+{_NAME}", "annotation", True), (rf"{_MODS}interface\s+{_NAME}", "interface", True), (rf"{_MODS}enum\s+{_NAME}", "enum", True), (rf"{_MODS}record\s+{_NAME}", "record", True),
        (rf"{_MODS}(?:<[^>]*>\s*)?(?:[\w.<>\[\],?&\s]+?\s+)?{_NAME}\s*\(", "method", False),
    ),
    "csharp": _rules(
        (r"namespace\s+[\w.]+()", "namespace", True), (rf"{_MODS}record\s+(?:class\s+|struct\s+)?{_NAME}", "record", True), (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}interface\s+{_NAME}", "interface", True), (rf"{_MODS}struct\s+{_NAME}", "struct", True),
        (rf"{_MODS}enum\s+{_NAME}", "enum", True), (rf"{_MODS}delegate\s+[\w.<>\[\]?,\s]+?\s+{_NAME}\s*\(", "delegate", False), (rf"{_MODS}(?:~)?(?:[\w.<>\[\],?\s]+?\s+)?{_NAME}{_ARGS}", "method", False),
    ),
    "typescript": _rules(
        (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}interface\s+{_NAME}", "interface", False), (rf"{_MODS}type\s+{_NAME}", "type", False), (rf"{_MODS}enum\s+{_NAME}", "enum", False), (rf"{_MODS}function\s*\*?\s*{_NAME}", "fn", False),
        (rf"{_MODS}(?:get\s+|set\s+|\*\s*)?(#?[A-Za-z_$][\w$]*){_ARGS}", "member", False),
    ),
    "kotlin": _rules(
        (rf"{_MODS}enum\s+class\s+{_NAME}", "enum", True), (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}interface\s+{_NAME}", "interface", True), (r"companion\s+object\b()", "companion", True), (rf"{_MODS}object\s+{_NAME}", "object", True),
        (rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{_NAME}\s*\(", "fn", False), (rf"{_MODS}va[lr]\s+{_NAME}", "property", False),
    ),
    "swift": _rules(
        (rf"{_MODS}(?:class\s+func|static\s+func|func)\s+{_NAME}", "fn", False), (rf"{_MODS}(init)[?!]?\s*[(<]", "fn", False), (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}struct\s+{_NAME}", "struct", True), (rf"{_MODS}enum\s+{_NAME}", "enum", True),
        (rf"{_MODS}extension\s+([\w.]+)", "extension", True), (rf"{_MODS}protocol\s+{_NAME}", "protocol", True), (rf"{_MODS}actor\s+{_NAME}", "class", True),
    ),
    "dart": _rules(
        (rf"{_MODS}class\s+{_NAME}", "class", True), (rf"{_MODS}mixin\s+{_NAME}", "mixin", False), (rf"{_MODS}extension\s+{_NAME}", "extension", False), (rf"{_MODS}enum\s+{_NAME}", "enum", False),
        (rf"{_MODS}(?:[\w.<>?,\s]+?\s+)?(?:get\s+|set\s+)?{_NAME}(?:\.\w+)?\s*\(", "fn", False),
    ),
    "cpp": _rules(
        (r"template\s*<()", "template", True), (rf"namespace\s+{_NAME}", "namespace", True), (rf"(?:enum\s+class|enum\s+struct|enum)\s+{_NAME}", "enum", False), (rf"class\s+{_NAME}", "class", True), (rf"struct\s+{_NAME}", "struct", True), (rf"union\s+{_NAME}", "union", True),
        (r"(?:[\w:<>,*&\s~\[\]]+?[\s*&]+)?((?:\w+::)*~?\w+)\s*\(", "fn", False),
    ),
}
RULES["javascript"] = RULES["typescript"]
SEPARATOR = {"rust": "::", "cpp": "::"}
#: Words that begin statements, never declarations.
STATEMENTS = set("if else for while switch return catch do try new throw await yield case when guard defer go select match loop delete typeof sizeof using assert super this import package in of".split())


def _python(text: str) -> list[Item]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
    lines = text.split("\n")
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    out: list[Item] = []
    run: list[ast.stmt] = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)) and (not run or not any(x.strip() for x in lines[run[-1].end_lineno : node.lineno - 1])):
            run.append(node)
        elif run:
            break
    if run:
        a, b = run[0].lineno, run[-1].end_lineno
        out.append((a, b, "imports", None, cut(a, b)))

    def emit(node: ast.stmt, owner: str | None) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            a = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            if isinstance(node, ast.ClassDef):
                out.append((a, node.end_lineno, "class", node.name, cut(a, node.end_lineno)))
                for member in node.body:
                    emit(member, node.name)
            else:
                out.append((a, node.end_lineno, "method" if owner else "fn", f"{owner}.{node.name}" if owner else node.name, cut(a, node.end_lineno)))

    for node in tree.body:
        emit(node, None)
    return out


def _blanked(text: str, lang: str) -> str:
    """The text with the inside of comments and strings replaced by spaces, of equal length."""
    noise = _NOISE_QUOTED if lang in ("javascript", "typescript", "dart") else _NOISE
    keep = lambda m: "".join(c if c == "\n" else " " for c in m.group())
    return noise.sub(keep, text)


def _end_of_item(code: str, at: int, stop: int) -> tuple[int, int, int]:
    """(end, body start, body end) of the item at an offset: up to its matching brace, or to its semicolon or line end."""
    depth = 0
    for i in range(at, stop):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth <= 0:
            level = 0
            for j in range(i, stop):
                level += (code[j] == "{") - (code[j] == "}")
                if level == 0:
                    return j + 1, i + 1, j
            return stop, i + 1, stop
        elif c == ";" and depth <= 0:
            return i + 1, 0, 0
        elif c == "}" and depth <= 0:
            return i, 0, 0
        elif c == "\n" and depth <= 0:
            rest = code[i:stop].lstrip()
            if not rest or not (rest[0] in "{.:=-><,)&|?" or rest.startswith(("where", "extends", "implements", "throws", "with "))) and not code[at:i].rstrip().endswith((",", "=", "(", "&", "|", "->", "+", "=>", ":")):
                return i, 0, 0
    return stop, 0, 0


def _scan(text: str, lang: str) -> list[Item]:
    code, rules, sep = _blanked(text, lang), RULES[lang], SEPARATOR.get(lang, ".")
    out: list[Item] = []
    past = 0  # how far a declaration reached that goes on behind its own line

    def emit(a: int, b: int, kind: str, name: str | None) -> None:
        first = text.count("\n", 0, a) + 1
        out.append((first, first + text.count("\n", a, b), kind, name, text[a:b]))

    def walk(at: int, stop: int, owner: str | None, inside: str | None) -> None:
        while at < stop:
            while at < stop and (code[at].isspace() or code[at] in ";,{})]"):
                at += 1
            if at >= stop:
                return
            if code.startswith("#", at) or (code[at] == "@" and not re.match(r"@interface\b", code[at:])):  # attributes, directives, annotations
                m = re.compile(r"#!?\[[^\]]*\]|#[^\n]*|@[\w.]+(?:\([^)]*\))?").match(code, at)
                at = m.end() if m else at + 1
                continue
            word = re.compile(r"\w+").match(code, at)
            group = re.compile(r"type\s*\(").match(code, at) if lang == "go" else None
            if group:
                at = type_group(group.end(), stop)
                continue
            end, body, body_end = _end_of_item(code, at, stop)
            if not word or word.group() not in STATEMENTS or (lang == "cpp" and word.group() == "using"):
                for pattern, kind, holds in rules:
                    m = pattern.match(code, at, end)
                    if not m or (body and m.start(m.lastindex or 0) > body):
                        continue
                    if handle(m, kind, holds, at, end, body, body_end, owner, inside):
                        break
            at = max(end, at + 1, past)

    def type_group(at: int, stop: int) -> int:
        """Emit each type of a bracketed group; returns where the group ends."""
        depth, close = 1, at
        while close < stop and depth:
            depth += (code[close] == "(") - (code[close] == ")")
            close += 1
        entry = re.compile(rf"[\s;]*({_NAME[1:-1]})(?:\[[^\]]*\])?\s*(struct\b|interface\b)?")
        while (m := entry.match(code, at, close - 1)) and m.end() > m.start(1):
            end = max(_end_of_item(code, m.start(1), close - 1)[0], m.end())
            emit(m.start(1), end, m.group(2) or "type", m.group(1))
            at = end
        return close

    def handle(m, kind, holds, at, end, body, body_end, owner, inside) -> bool:
        nonlocal past
        name = m.group(m.lastindex) if m.lastindex else ""
        if lang == "rust":
            if kind == "impl":
                target = re.sub(r"^(?:<[^{]*?>\s*)?", "", code[m.end() : body - 1].strip(), count=1)
                target = re.split(r"\bwhere\b", target.split(" for ")[-1])[0].strip()
                walk(body, body_end, target, "impl")
                return True
            if kind == "mod" and body:
                walk(body, body_end, None, None)
                return True
            if kind == "fn" and owner:
                kind, name = "impl_method", f"{owner}::{name}"
            emit(at, end, kind, name or None)
            return True
        if lang == "go":
            if kind == "method":
                receiver = re.sub(r"\[.*", "", m.group(1).split()[-1].lstrip("*")) if m.group(1).split() else ""
                name = f"{receiver}.{name}"
            if kind in ("struct", "interface", "type"):
                at = m.start(1)
            emit(at, end, kind, name)
            return True
        if kind == "namespace" and lang == "csharp" or kind == "companion":
            walk(body or end, body_end or end, owner, inside)
            return True
        if kind == "template":
            depth, i = 0, m.end() - 1
            while i < end:
                depth += (code[i] == "<") - (code[i] == ">")
                i += 1
                if depth == 0:
                    break
            begin = re.compile(r"\s*").match(code, i).end()  # the declaration may stand on the next line
            inner_end = _end_of_item(code, begin, end if body else len(code))[0]
            for pattern, k2, _ in rules[2:]:
                m2 = pattern.match(code, begin, inner_end)
                if m2:
                    past = inner_end
                    emit(at, inner_end, k2, m2.group(1))
                    return True
            return False
        if kind == "member":
            if not inside or not body:
                return False
            kind = "method"
        if kind in ("method", "fn") and lang in ("java", "csharp", "dart", "cpp") and not (body or (lang in ("java", "csharp") and inside) or (lang == "dart")):
            return False
        if kind in ("method", "fn"):
            if name in STATEMENTS - {"of", "in", "match", "import"} or "=" in code[at : m.start(m.lastindex)]:
                return False
            kind, name = ("method", f"{owner}{sep}{name}") if owner else ("fn" if lang != "java" or not inside else "method", name)
        if kind == "property" and owner:
            return True
        emit(at, end, kind, name or None)
        if holds and body:
            walk(body, body_end, name, kind)
        return True

    walk(0, len(code), None, None)
    return out


def parse(text: str, lang: str) -> list[Item]:
    """Chunks (start line, end line, kind, name, text) of a source text; none where nothing is found."""
    return _python(text) if lang == "python" else _scan(text, lang)
