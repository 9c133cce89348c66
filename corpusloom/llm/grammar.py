"""Token patterns, classes, permissible pairs and productions of eight languages, for problem 3.

A *shape* is a statement as a string of one character for each token (its class's code);
what stands in brackets is reduced to the brackets. Productions are regular expressions
over shapes. They are written in classes, each followed by a space, and translated by
``coded``. ``_x`` stands for tokens of an expression or a type: any but those that only
begin, join or end statements in the language. As that is a character class, matching
neither recurses nor depends on how long a statement is.
"""

from __future__ import annotations

import re
from itertools import product

LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "js": "javascript", "java": "java", "json": "json", "toml": "toml"}
SCRIPT = ["javascript", "typescript"]

# Reserved words, and literals among them.
KEYWORDS = {
    "python": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "rust": "as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp switch synchronized throw throws transient try void volatile while",
    "javascript": "as async await break case catch class const continue debugger default delete do else export extends finally for from function get if import in instanceof let new of return set static switch throw try typeof var void while with yield",
}
KEYWORDS["typescript"] = KEYWORDS["javascript"] + " abstract asserts declare enum implements infer interface is keyof namespace module override private protected public readonly satisfies type unique any"
LITERALS = {
    "python": "True False None", "rust": "true false self Self super crate", "go": "true false nil iota", "java": "true false null this super", "javascript": "true false null undefined this super",
}
LITERALS["typescript"] = LITERALS["javascript"]
#: Keywords that may follow an operand.
AFTER_OPERAND = {
    "python": "and as else for from if import in is not or async", "rust": "as else for if in where", "go": "chan else func interface map struct", "java": "default extends implements instanceof throws else while catch finally final",
    "javascript": "as async await catch else extends finally from function if in instanceof of return throw while break continue get set static new case default const let var for typeof delete",
}
AFTER_OPERAND["typescript"] = AFTER_OPERAND["javascript"] + " as implements is satisfies keyof readonly private public protected infer any"
CONTEXTUAL = set("async from get set static of as type declare readonly abstract is keyof module namespace override any unique infer asserts satisfies public private protected implements interface enum await let yield default match".split())
HEADS = {"java": "if while switch catch synchronized for", "javascript": "if while switch with", "typescript": "if while switch with"}
INFIX = {
    "python": "== != <= >= < > + - * / // % ** @ & | ^ << >> = += -= *= /= //= %= **= &= |= ^= >>= <<= @= := . ->",
    "rust": "== != <= >= < > + - * / % & | ^ << >> && || = += -= *= /= %= &= |= ^= <<= >>= . :: -> => .. ..= @",
    "go": "== != <= >= < > + - * / % & | ^ << >> &^ && || = := += -= *= /= %= &= |= ^= <<= >>= &^= . <-",
    "java": "== != <= >= < > + - * / % & | ^ << >> >>> && || = += -= *= /= %= &= |= ^= <<= >>= >>>= . :: -> ?",
    "javascript": "== === != !== <= >= < > + - * ** / % & | ^ << >> >>> && || ?? = += -= *= **= /= %= &= |= ^= <<= >>= >>>= &&= ||= ??= . ?. => ?",
}
INFIX["typescript"] = INFIX["javascript"]
PREFIX = {
    "python": "+ - ~ * ** @ ...", "rust": "- ! & && * | || .. ..= ' # < ::", "go": "+ - ! ^ * & <-", "java": "+ - ! ~ ++ -- @ < ...",
    "javascript": "+ - ! ~ ++ -- ... @ # <", "typescript": "+ - ! ~ ++ -- ... @ # < |&",
}
POSTFIX = {"python": "...", "rust": "? ! > >> .. ' .. *", "go": "++ -- ... *", "java": "++ -- > >> >>> ... ? *", "javascript": "++ --", "typescript": "++ -- ! > >> >>> ?"}
OPERANDS = "n 0 s c".split()
OPEN, CLOSE = "( [ {".split(), ") ] }".split()
FAULT = "E"
#: Line ends of Go after these classes end the statement.
GO_ENDS = "n 0 s c ) ] } ++ -- true false nil iota break continue return fallthrough".split()
#: Line ends of JavaScript and TypeScript end a statement between one of the first and none of the second.
SCRIPT_ENDS = "n 0 s c ) ] } ++ -- true false null undefined this super break continue return debugger any from of get set type".split()
SCRIPT_GOES_ON = ". ?. ( [ + - * ** / % & | ^ << >> >>> && || ?? = += -= *= **= /= %= &= |= ^= <<= >>= >>>= &&= ||= ??= => ? : , ; ) ] } == === != !== < > <= >= in instanceof of as satisfies extends implements { from".split()


def permissible_pairs(lang: str) -> set[tuple[str, str]]:
    """Adjacent token classes that the grammar of a language permits; ``^`` is the begin of a line or value."""
    if lang == "toml":
        return set()
    if lang == "json":
        value, start = ["s", "0", "l"], ["s", "0", "l", "{", "["]
        out = set(product(["["], [*start, "]"])) | set(product(["{"], ["s", "}"])) | set(product([*value, "}", "]"], [",", "}", "]"]))
        return out | {("s", ":")} | set(product([":"], start)) | set(product([","], start)) | set(product(["^"], start))
    words, literals, after = (x[lang].split() for x in (KEYWORDS, LITERALS, AFTER_OPERAND))
    if lang == "python":
        words = [*words, "match", "case"]
    infix, prefix, postfix = INFIX[lang].split(), PREFIX[lang].split(), POSTFIX[lang].split()
    context = [w for w in words if w in CONTEXTUAL] if lang in SCRIPT else []
    ends = [*OPERANDS, *literals, *CLOSE, *postfix, *context]
    begins = [*OPERANDS, *literals, *OPEN, *prefix]
    out = set(product(ends, [*infix, *postfix, ",", ";", ":", *CLOSE, "(", "[", "{", *after]))
    out |= set(product([*infix, *prefix, ",", ";", ":", *OPEN], [*begins, *words]))
    out |= set(product(words, [*begins, *words, ";", ":", ",", *CLOSE, "*", "<"])) | set(product(infix, words))
    out |= set(product(OPEN, CLOSE)) | set(product([",", ";", ":"], [*CLOSE, ";"])) | {("}", w) for w in words} | {(")", w) for w in words if lang != "python"}
    out |= set(product(["^"], [*begins, *infix, *postfix, *words, *CLOSE, ",", ";", ":"]))
    if lang == "python":
        out -= set(product(["^"], [",", ":", *CLOSE, "."]))
        out |= {("s", "s"), (".", "..."), ("import", "*"), ("^", "@"), (".", "."), ("from", "."), (".", "import"), ("...", "import"), ("from", "..."), (":", ":"), ("*", ","), ("/", ","), ("/", ")"), (",", "/"), ("except", "*"), (",", ":"), ("^", "type"), ("type", "n")}
    if lang in ("go", "java"):  # a type before or after its name
        out |= set(product(["n", "]", "}", ">", ">>", "?", *(["*"] if lang == "go" else [])], ["n"])) | {(")", "n"), ("...", "n"), ("}", "else")}
    if lang == "go":
        out |= {(")", "("), (")", "*"), ("n", "*"), ("n", "<-"), ("n", "["), ("import", "s"), ("n", "s"), (")", "["), ("]", "*"), (".", "("), ("*", "n"), ("*", ")"), ("import", ".")} | set(product(["n", "]", ")", "*"], ["map", "chan", "func", "struct", "interface"]))
        out -= set(product(["import", "package"], ["{", "[", "*"])) | {("package", "s"), ("package", "("), ("import", "c"), (".", "*"), ("func", "{"), ("func", "[")}
        out |= {("import", "("), ("struct", "{"), ("interface", "{"), ("select", "{"), ("s", "n")} - {("s", "n")}
    if lang == "java":
        out |= {(".", "*"), (">", "("), ("?", ">"), ("?", "extends"), ("?", "super"), (")", "s"), (")", "0"), (")", "c"), (")", "!"), (")", "("), ("<", ">"), ("]", "{"), ("->", "{"), ("::", "new"), (".", "class"), (">", "void")}
        out |= {(k, "[") for k in words} | {(k, ".") for k in ("int", "long", "double", "float", "boolean", "byte", "char", "short")} | {(k, "...") for k in words} | {(k, ">") for k in words} | set(product([">", "]"], words))
        out |= set(product([")"], literals)) | {("new", "n"), ("-", "-")} | set(product(["&"], ["n"])) | {("default", "->"), ("}", "("), ("super", "n"), ("<", "?"), ("(", ";"), ("n", "interface"), ("n", "class")}
        out -= {("import", "{"), ("import", "s"), ("import", "("), ("package", "s")} | set(product(["class", "interface", "enum"], ["{", "(", "[", "0", "s", "<"]))
    if lang == "rust":
        out |= {("!", "["), ("!", "("), ("!", "{"), ("!", "n"), ("|", "|"), ("n", "!"), ("'", "n"), ("c", "n"), (">", ">"), (">", "{"), ("<", "'"), ("<", "<"), ("&", "'"), ("&", "mut"), ("*", "const"), ("*", "mut"), ("|", "{"), ("||", "{"), ("|", "n"), ("|", "->"), ("=>", "{"), ("#", "["), ("#", "!"), ("<", ">"), ("_", "_"), ("..", "}"), ("..", ")"), ("..", "]"), ("?", ";"), ("::", "<"), ("::", "{"), ("::", "*"), ("]", "pub"), (">", "("), (",", "|"), ("->", "!"), ("(", "|")}
        out |= {(t, "'") for t in ("<", "&", "+", ",", ":", "(", "=")} | set(product([">", "]"], words)) | set(product(["'"], ["n", "static", "mut", "dyn"])) | {("crate", ")"), ("$", "n")}
        out |= {(a, b) for a in (">", ">>") for b in (">", ">>", ",", ")", "(", "{", ";", "=", "::", "]", "where", "for", "+", "?", ".", "|", "->")} | {("pub", "("), ("'", ":"), ("n", "'")} | {(x, "=>") for x in ends} | {("|", "&"), ("|", "_"), (",", "="), ("!", ";"), ("!", ",")} | {(x, "$") for x in "{ ( [ , => ; :".split()}
        out -= set(product(["fn", "struct", "enum", "trait", "mod", "type"], ["{", "[", "0", "s"])) | set(product(["struct", "enum", "trait", "mod"], ["("]))
    if lang in SCRIPT:
        out |= {(x, "n") for x in context} | {("!", "!"), ("=>", "{"), ("function", "*"), ("yield", "*"), ("import", "*"), ("export", "*"), ("*", "as"), ("n", "s"), ("?", "."), (")", "n"), (")", "s"), (")", "["), (")", "!"), (")", "++"), (")", "0"), ("}", "n"), ("}", ")"), ("/", ")"), ("import", "s"), ("async", "("), ("*", "n"), ("*", "["), ("for", "("), ("for", "await"), ("n", "=>"), ("*", "from"), ("static", "#"), ("static", "*"), ("static", "["), ("async", "*"), ("try", "{"), ("finally", "{"), ("catch", "{")}
        out |= set(product([")"], [*begins])) - {(")", "<")} | set(product(["}"], begins))
        out -= {("n", "s")} | set(product(["function"], ["{", "[", "0", "s"]))
    if lang == "typescript":
        out |= {("?", ":"), ("!", ":"), ("!", "."), ("!", ";"), ("!", ")"), ("!", "["), ("!", ","), (":", "|"), ("=", "|"), ("^", "|"), ("^", "&"), ("-", "?"), ("+", "?"), ("-", "readonly"), ("<", ">"), (">", ">"), (">", "("), (">", "{"), ("?", "("), ("?", ","), ("?", ")")} | {(k, ">") for k in words} | {(k, x) for k in words for x in ("[", "|", "&", "=", "=>", ";", "{", "?", ".")}
        out |= {(a, b) for a in (">", ">>", ">>>") for b in (">", ">>", ",", ")", "(", "{", ";", "=", "]", "|", "&", "=>", "[", "}", ".", "extends", "implements", ":")} | {("abstract", "class"), ("declare", "n"), ("readonly", "["), ("new", "("), (",", ">")}
    for k in HEADS.get(lang, "").split():
        out = {(a, b) for a, b in out if a != k or b == "(" or lang in SCRIPT and k == "catch" and b == "{"}
    if lang != "python":  # statements end at braces without a separator: the productions tell
        every = {*operators(lang), *words, *literals, *OPERANDS, *OPEN, *CLOSE, "'"}
        out |= {("}", b) for b in every} | {(a, "}") for a in every if a not in infix} | {("^", b) for b in every} | {("\n", b) for b in every}
    return {(a, b) for a, b in out if FAULT not in (a, b)}


def operators(lang: str) -> list[str]:
    """Operators and separators of a language, longest first."""
    if lang in ("json", "toml"):
        return [",", ":"] if lang == "json" else [",", "="]
    found = {*INFIX[lang].split(), *PREFIX[lang].split(), *POSTFIX[lang].split(), ",", ";", ":"} - {"'", "|&", "$"}
    return sorted(found | ({"$"} if lang == "rust" else set()), key=lambda x: (-len(x), x))


def _codes() -> dict[str, str]:
    """A character for every class but TOML's.

    Sets of characters below 256 are bitmaps to a regular expression, all others chains of
    comparisons, and texts of such characters take a byte each. Line ends and what means
    something in a pattern are left out; the common classes come first and are ASCII.
    """
    classes = ["^", *OPERANDS, "l", "'", "$", FAULT, *OPEN, *CLOSE, "match", "case"]
    for lang in [*KEYWORDS, "json"]:
        classes += operators(lang) + (KEYWORDS[lang].split() + LITERALS[lang].split() if lang in KEYWORDS else [])
    free = [c for c in map(chr, range(256)) if c.isascii() and c.isalnum()] + [chr(c) for c in (*range(0xA0, 0x100), *range(0x7F, 0xA0), *range(0x0E, 0x20)) if c != 0x85]
    classes = list(dict.fromkeys(classes))
    if len(classes) > len(free):
        raise ValueError(f"{len(classes)} classes, but {len(free)} characters")
    return dict(zip(classes, free))


def coded(pattern: str) -> str:
    """A pattern over classes as one over codes: classes are followed by a space, a bar or the end of a group.

    Marks of the private use area stand for the codes until the whole pattern is read.
    """
    out, word, at = [], "", 0

    def flush() -> None:
        nonlocal word
        if word:
            out.append(_MARKS[word])
            word = ""

    while at < len(pattern):
        c = pattern[at]
        group = next((m for m in ("(?:", "(?!", "(?=", "(?<=", "(?<!") if pattern.startswith(m, at)), "")
        if group:
            flush()
            out.append(group)
            at += len(group)
        elif pattern.startswith("\\S+", at):
            flush()
            out.append(".")
            at += 3
        elif c == "\\":
            word += pattern[at + 1]
            at += 2
        elif c == "[":
            flush()
            end = next(k for k in range(at + 1, len(pattern)) if pattern[k] == "]" and pattern[k - 1] != "\\")
            inner = pattern[at + 1 : end].replace("\\", "")
            out.append("[" + "".join(x if "\ue000" <= x <= "\uf8ff" or x == "^" and not k else _MARKS[x] for k, x in enumerate(inner)) + "]")
            at = end + 1
        elif c == "{":
            flush()
            end = pattern.index("}", at)
            out.append(pattern[at : end + 1])
            at = end + 1
        elif c in "()|?*+ " or c == "^" and not word and (not out or out[-1] in ("|", "(?:", "(?<=")) or c == "$" and not word:
            flush()
            out.append(c if c != " " else "")
            at += 1
        elif "\ue000" <= c <= "\uf8ff":
            flush()
            out.append(c)
            at += 1
        else:
            word += c
            at += 1
    flush()
    return "".join(out).translate(_CODED)


def _escaped(token: str) -> str:
    return "".join(c if c.isalnum() or c in "<>=!:;,&%@~#'-" else "\\" + c for c in token)


def token_pattern(lang: str) -> re.Pattern:
    """The lexer of a language; whatever else it finds is a character by itself.

    Comments, attributes and annotations come out as tokens that begin like none other,
    and a line end takes the blank and comment lines after it along.
    """
    ops = "|".join(map(_escaped, operators(lang)))
    quoted, ticked = r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'"
    block = r"/\*[\s\S]*?\*/"
    c_line = rf"\n(?:\s++|//[^\n]*+|{block})*+"
    word = r"(?:[^\W\d]|\$)[\w$]*+" if lang in (*SCRIPT, "java") else r"[^\W\d]\w*+"
    number = r"0[xXbBoO][\w.]++|\d[\d_]*+(?:\.(?!\.|[^\W\d])[\d_]*+)?(?:[eE][+-]?\d++)?\w*+|(?<![\w)\]])\.\d[\d_]*+(?:[eE][+-]?\d++)?\w*+"
    rest = rf"|{word}|{number}|{ops}|\S"
    note = r"@(?!interface\b)[^\W\d][\w.]*+(?:[ \t]*\((?:[^()\"']++|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|\([^()]*+\))*+\))?"
    if lang == "json":
        text = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?(?![\w.])|\w++|\S'
    elif lang == "toml":
        text = (
            r'\n(?:[ \t\r]*+(?:#[^\n]*+)?\n)*+|#[^\n]*+|"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|' + r"'''[\s\S]*?'''|" + r'"(?:[^"\\\n]++|\\(?:[btnfre"\\]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*+"|'
            r"'[^'\n]*+'|[\w+-][\w+\-.:]*+(?: \d\d:\d\d:\d\d(?:\.\d++)?(?:Z|[+-]\d\d:\d\d)?)?|\S"
        )
    elif lang == "python":
        string = r'[rRuUbBfFtT]{0,2}(?:"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|" + r'"(?!"")(?:[^"\\\n]++|\\[\s\S])*+"|' + r"'(?!'')(?:[^'\\\n]++|\\[\s\S])*+'|\"\"|'')"
        text = r"\n(?:[ \t\r\f]*+(?:#[^\n]*+)?\n)*+[ \t\f]*+|\\\n|#[^\n]*+|" + string + rest
    elif lang == "rust":
        string = r'[bc]?r"[^"]*+"|[bc]?r#"[\s\S]*?"#|[bc]?r##"[\s\S]*?"##|[bc]?r###"[\s\S]*?"###|[bc]?"(?:[^"\\]++|\\[\s\S])*+"'
        char = r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*+\}|.))'|'[^\W\d]\w*+"
        text = rf"//[^\n]*+|{block}|/\*|#!?\[(?:[^\]\"]++|" + r'"(?:[^"\\]++|\\[\s\S])*+"' + rf")*+\]|{string}|{char}" + rest
    elif lang == "go":
        char = r"'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'"
        text = rf"{c_line}|//[^\n]*+|{block}|/\*|" + r'"(?:[^"\\\n]++|\\.)*+"|`[^`]*+`|' + char + rest
    elif lang == "java":
        char = r"'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'"
        text = rf"//[^\n]*+|{block}|/\*|{note}|" + r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|"(?:[^"\\\n]++|\\.)*+"|' + char + rest
    else:
        before = r"[=(,:;!&|?{}\[+\n]"
        regex = rf"(?:(?<={before} )|(?<={before})|(?<=return ))/(?![/*\s])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
        text = rf"{c_line}|//[^\n]*+|{block}|/\*|{note}|{quoted}|{ticked}|`(?:[^`\\]++|\\[\s\S])*+`|{regex}" + rest
    return re.compile(text)


#: What a number must look like.
NUMBER = {
    "python": r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[1-9][\d_]*|0[0_]*|(?:[\d_]+\.[\d_]*|\.[\d_]+|\d[\d_]*)(?:[eE][+-]?\d[\d_]*[jJ]?|[jJ])|[\d_]+\.[\d_]*|\.[\d_]+",
    "json": r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?",
}
TOML_VALUE = (
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|z|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)"
)
TOML_KEY = r"[\w-]+(?:\.[\w-]+)*"

#: Keywords that tell what the next ``{`` of the same level opens.
OPENERS = {
    "java": {"class": "members", "interface": "members", "enum": "enum", "switch": "switch", "new": "any", "if": "block", "for": "block", "while": "block", "throws": "block", "catch": "block", "synchronized": "block", "try": "block"},
    "rust": {"struct": "fields", "enum": "fields", "match": "match", "impl": "items", "trait": "items", "mod": "items", "extern": "items", "use": "value", "fn": "block", "if": "block", "while": "block", "for": "block", "loop": "block", "unsafe": "block", "else": "block", "async": "block", "move": "block"},
    "go": {"struct": "fields", "interface": "fields", "switch": "switch", "select": "switch", "func": "block", "if": "block", "for": "block", "else": "block"},
    "javascript": {"class": "members", "switch": "switch", "if": "block", "for": "block", "while": "block", "import": "value", "export": "value", "function": "block", "catch": "block"},
}
OPENERS["typescript"] = OPENERS["javascript"] | {"interface": "types", "enum": "value", "namespace": "top", "module": "top", "type": "types"}


CODES = _codes()
_MARKS = {c: chr(0xE000 + k) for k, c in enumerate(CODES)}
_CODED = {ord(_MARKS[c]): code for c, code in CODES.items()}


def _x(*banned: str) -> str:
    """Any tokens but those banned."""
    return f"[^{''.join(_MARKS[t] for t in ' '.join(banned).split())}]*"


_ENDS_BLOCK = r"\{ \} "
_PY_STATEMENT = "def class return pass break continue raise import global nonlocal del assert with while try except finally elif match case"
_PE = _x(_PY_STATEMENT, "for async as : ; from @ = += -= *= /= //= %= **= &= |= ^= >>= <<= @= ->", "yield")
_PA = _x(_PY_STATEMENT, "for async as : ; @ ->", "from")
_PY_SIMPLE = (
    r"(?:pass |break |continue |return " + _PE + r"|raise " + _PE + r"(?:from " + _PE + r")?|import n (?:\. n )*(?:as n )?(?:, n (?:\. n )*(?:as n )?)*"
    r"|from (?:\.{1,3} )*(?:n (?:\. n )*)?import (?:\* |\( \) |n (?:as n )?(?:, n (?:as n )?)*)|(?:global|nonlocal) n (?:, n )*|del " + _PE + r"|assert " + _PE
    + r"|type n (?:\[ \] )?= " + _PE + r"|n (?:\. n |\[ \] |\( \) )*: " + _PE + r"(?:= " + _PA + r")?|" + _PA + r"(?:yield from " + _PE + r")?)"
)
_PY_LINE = rf"{_PY_SIMPLE}(?:; {_PY_SIMPLE})*(?:; )?"

_J_WORDS = "package import public private protected throws if else for while do try catch finally throw break continue return ; { case goto const assert extends implements interface enum abstract volatile transient native strictfp synchronized"
_JE = _x(_J_WORDS.replace("extends ", ""), "void default static final")
_J_MOD = r"(?:(?:public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|n|n - n) )*"
_J_TYPE = r"(?:(?:n|0|int|long|double|float|boolean|byte|char|short|void|\.|<|>|>>|>>>|,|\?|&|extends|super|\[|\]|\.\.\.) )"
_J_DECL = _J_MOD + r"(?:class|interface|enum|@ interface|n) n (?:\( \) )?(?:" + _J_TYPE + r"|implements |n |\( \) )*\{ \} "
_J_OPEN = r"(?:n : |(?:if|for|while|synchronized) \( \) |else |do )*"
_J_STATEMENT = (
    rf"{_J_OPEN}(?:{_ENDS_BLOCK}|; |switch \( \) {_ENDS_BLOCK}|try (?:\( \) )?{_ENDS_BLOCK}|(?:return|throw|break|continue|assert) {_JE}(?:; |{_ENDS_BLOCK})|(?:final |var )*{_JE}(?:; |(?<=[=\])>n]|->){_ENDS_BLOCK}))"
    rf"|catch \( \) {_ENDS_BLOCK}|finally {_ENDS_BLOCK}"
)

_S_WORDS = "import export throw break continue if else for while do try catch finally return switch case ; { const let var debugger with"
_SE = _x(_S_WORDS, "interface enum namespace", "}")
_S_OPEN = r"(?:n : |(?:if|while|with) \( \) |for (?:await )?\( \) |else |do )*"
_S_NAME = r"(?:\S+ |\[ \] |# n )"

_R_WORDS = "let fn struct enum impl trait mod pub use static type ; while for loop where extern"
_RE = _x("let fn struct enum trait mod pub use static type ; where extern")
_R_VIS = r"(?:pub (?:\( \) )?)?"
_R_ITEM = (
    rf"{_R_VIS}(?:use {_x('; let fn struct')}(?:; |{_ENDS_BLOCK})|mod n (?:; |{_ENDS_BLOCK})|(?:default )?(?:const )?(?:async )?(?:unsafe )?(?:extern (?:s )?)?fn n (?:< {_x('fn let ;')})?\( \) {_x('let struct ; {')}(?:; |{_ENDS_BLOCK})"
    rf"|struct n {_x('let fn ; {')}(?:; |{_ENDS_BLOCK})|n n (?:< {_x('let ; {')})?{_ENDS_BLOCK}|enum n {_x('let fn ; {')}{_ENDS_BLOCK}|(?:unsafe )?(?:default )?impl (?!\{{ ){_x('let struct ; {')}{_ENDS_BLOCK}|(?:unsafe )?(?:n )?trait n {_x('let ; {')}(?:; |{_ENDS_BLOCK})"
    rf"|(?:const|static) (?:mut )?n : {_x('; let')}(?:; |{_ENDS_BLOCK})|type n {_x('; let')}; |extern crate n (?:as n )?; |extern (?:s )?{_ENDS_BLOCK}|(?:n :: |crate :: )*n ! (?:n )?(?:\( \) ; |\[ \] ; |{_ENDS_BLOCK})|const n : {_x('; let')}; )"
)
_R_BLOCKISH = rf"(?:' : )?(?:if {_RE}|(?:if|while) let {_RE}|while {_RE}|for {_RE}in {_RE}|loop |match {_RE}|unsafe |else (?:if (?:let )?{_RE})?|async (?:move )?|)" + _ENDS_BLOCK

_G_BLOCK = r"\{ \} "
_G_PARTS = _x("package import case default else fallthrough goto defer var const if for switch select return break continue type go")
_GE = _G_PARTS
_G_IF = rf"if {_GE}{_G_BLOCK}(?:else if {_GE}{_G_BLOCK})*(?:else {_G_BLOCK})?"
_G_STATEMENT = (
    rf"(?:n : )?(?:{_G_IF}|for {_x('package import case default else go defer')}{_G_BLOCK}|(?:switch|select) {_x('package import case default else go defer if for')}{_G_BLOCK}|{_G_BLOCK}|(?:go|defer) {_GE}|return {_GE}|(?:break|continue|goto) (?:n )?|fallthrough "
    rf"|(?:var|const) (?:\( \) |n (?:, n )*{_GE})|type (?:\( \) |n {_GE})|(?!n n |func n )(?:n : )?{_GE})"
)

#: Shapes that a statement may have, by language and by what the brackets around it hold.
PRODUCTIONS = {
    ("python", "top"): rf"(?:@ {_PE}|(?:if|elif|while|match|case) (?!: ){_PE}(?:as n )?(?:if {_PE})?: (?:{_PY_LINE})?|(?:else|try|finally) : (?:{_PY_LINE})?|except (?:\* )?(?:{_PE}(?:as n )?)?: (?:{_PY_LINE})?|case {_x(_PY_STATEMENT, ':')}: (?:{_PY_LINE})?"
    rf"|(?:async )?for {_PE}in {_PE}: (?:{_PY_LINE})?|(?:async )?with (?:{_PE}(?:as {_PE})?)+: (?:{_PY_LINE})?|(?:async )?def n (?:\[ \] )?\( \) (?:-> {_PE})?: (?:{_PY_LINE})?|class n (?:\[ \] )?(?:\( \) )?: (?:{_PY_LINE})?|{_PY_LINE})",
    ("python", "group"): _x(_PY_STATEMENT.replace(" match case", ""), ": ; ->", "= += -="),
    ("python", "call"): _x(_PY_STATEMENT.replace(" match case", ""), ": ; ->"),
    ("python", "params"): _x(_PY_STATEMENT.replace(" match case", ""), "; ->"),
    ("python", "index"): _x(_PY_STATEMENT.replace(" match case", ""), "; -> = += -="),
    ("python", "set"): _x(_PY_STATEMENT.replace(" match case", ""), "; -> = += -="),
    ("java", "top"): rf"(?:package n (?:\. n )*; |import (?:static )?n (?:\. n )*(?:\. \* )?; |{_J_DECL}|; )",
    ("java", "members"): rf"(?:{_J_DECL}|(?:static )?{_ENDS_BLOCK}|; |{_J_MOD}(?:< {_J_TYPE}*> )?{_J_TYPE}*n \( \) (?:\[ \] )*(?:throws {_J_TYPE}+)?(?:{_ENDS_BLOCK}|; |default {_x('; if for while return')}; )|{_J_MOD}n {_ENDS_BLOCK}"
    rf"|{_J_MOD}{_J_TYPE}+(?:\[ \] )*(?:= {_JE})?(?:, n (?:\[ \] )*(?:= {_JE})?)*(?:; |(?<=[=\])>n]|->){_ENDS_BLOCK}))",
    ("java", "enum"): _x("if for while return throw"),
    ("java", "block"): rf"(?:{_J_STATEMENT}|{_J_DECL})",
    ("java", "switch"): rf"(?:(?:case (?:{_x('; { -> case return if')}|default )(?:->|:) |default (?:->|:) )*(?:{_J_STATEMENT}|{_J_DECL})?)",
    ("javascript", "block"): rf"(?:{_S_OPEN}(?:{_ENDS_BLOCK}|; |switch \( \) {_ENDS_BLOCK}|try {_ENDS_BLOCK}|(?:break|continue) (?:n )?(?:; )?|debugger (?:; )?|(?:return|throw) {_SE}(?:{_ENDS_BLOCK})*(?:; )?|(?!function (?:\* )?\( |class \{{ |async function \( ){_SE}(?:{_ENDS_BLOCK})*(?:; )?)"
    rf"|catch (?:\( \) )?{_ENDS_BLOCK}|finally {_ENDS_BLOCK}|(?:export )?(?:default )?(?:async )?function (?:\* )?n \( \) {_ENDS_BLOCK}|export default (?:async )?function (?:\* )?\( \) {_ENDS_BLOCK}|(?:export )?(?:default )?class n (?:extends {_SE})?{_ENDS_BLOCK}|export default class (?:extends {_SE})?{_ENDS_BLOCK}"
    rf"|(?:export )?(?:const (?:n|\[ \]|\{{ \}}) (?:= {_SE})(?:{_ENDS_BLOCK})*|const {_ENDS_BLOCK}|(?:let|var) (?:n|\[ \]) {_SE}(?:{_ENDS_BLOCK})*|(?:let|var) {_ENDS_BLOCK})(?:; )?"
    rf"|import (?:\( \) |\. n ){_SE}(?:; )?|import (?:s |n (?:, )?(?:\* as n )?(?:{_ENDS_BLOCK})?(?:from s )?|\* as n from s |{_ENDS_BLOCK})(?:n {_ENDS_BLOCK})?(?:; )?|export (?:\* (?:as n )?from s |{_ENDS_BLOCK}|default {_SE}(?:{_ENDS_BLOCK})?)(?:; )?|from s (?:; )?)",
    ("javascript", "members"): rf"(?:; |(?:static )?{_ENDS_BLOCK}|(?:(?:static|async|get|set|\*) )*{_S_NAME}\( \) {_ENDS_BLOCK}|(?:static )?{_S_NAME}(?:= {_SE}(?:{_ENDS_BLOCK})*)?(?:; )?)",
    ("rust", "top"): rf"(?:{_R_ITEM}|; )",
    ("rust", "items"): rf"(?:{_R_ITEM}|; )",
    ("rust", "block"): rf"(?:{_R_ITEM}|let {_x('let fn struct enum trait mod pub use static type ; where extern return')}(?:else )?(?:; |{_ENDS_BLOCK})|{_R_BLOCKISH}|; |(?!(?:for|while|loop|struct|enum) ){_RE}(?:; |{_ENDS_BLOCK})?)",
    ("rust", "match"): rf"(?:{_x('let fn struct enum trait mod pub use static type ; where extern =>')}(?:if (?:let )?{_x('=> let')})?=> {_RE}(?:, )?|, )",
    ("rust", "fields"): rf"(?:{_R_VIS}n : {_x('let ; =')}(?:, )?|n (?:\( \) )?(?:= {_RE})?(?:, )?|n {_ENDS_BLOCK}|, )",
    ("go", "top"): rf"(?:package n |import (?:\( \) |(?:n |\. )?s )|func (?:\( \) )?n (?:\[ \] )?\( \) {_x('= := ; if for return var import')}|type (?:\( \) |n {_GE})|(?:var|const) (?:\( \) |n (?:, n )*{_GE}))(?:; )?",
    ("go", "block"): rf"{_G_STATEMENT}(?:; {_G_STATEMENT})*",
    ("go", "switch"): rf"(?:(?:(?:case {_x('package import default else go defer if for return var case :')}|default ): )+{_G_STATEMENT}|{_G_STATEMENT})",
    ("go", "fields"): _x("= := if for return var import package case default else go defer ; : const type switch select"),
}
_T_TYPE = _x("if else for while return ; const let var throw")
_T_MOD = r"(?:(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set|\*) )*"
PRODUCTIONS["typescript", "block"] = (
    PRODUCTIONS["javascript", "block"][:-1]
    + rf"|(?:export )?(?:default )?(?:declare )?(?:abstract )?class n {_T_TYPE}{_ENDS_BLOCK}|(?:export )?(?:default )?(?:declare )?interface n {_T_TYPE}{_ENDS_BLOCK}|(?:export )?(?:declare )?type n {_T_TYPE}(?:; )?|(?:export )?(?:declare )?(?:const )?enum n {_ENDS_BLOCK}"
    rf"|(?:export )?(?:declare )?(?:namespace|module) (?:n (?:\. n )*|s ){_ENDS_BLOCK}|(?:export )?(?:default )?(?:declare )?(?:async )?function (?:\* )?(?:n )?(?:< {_T_TYPE})?\( \) (?:: {_T_TYPE})?(?:{_ENDS_BLOCK}|; )?|declare (?:const|let|var) n : {_T_TYPE}(?:; )?"
    rf"|(?:export )?(?:const|let|var) (?:n|\[ \]|\{{ \}}) (?:! )?: {_T_TYPE}(?:; )?|(?:import|export) type {_T_TYPE}(?:{_ENDS_BLOCK})?(?:from s )?(?:; )?)"
)
PRODUCTIONS["typescript", "members"] = rf"(?:; |(?:static )?{_ENDS_BLOCK}|{_T_MOD}{_S_NAME}(?:[?!] )?(?:< {_T_TYPE})?\( \) (?:: {_T_TYPE})?(?:{_ENDS_BLOCK}|; )?|{_T_MOD}{_S_NAME}(?:[?!] )?(?:: {_T_TYPE})?(?:= {_SE}(?:{_ENDS_BLOCK})*)?(?:; )?)"
PRODUCTIONS["typescript", "types"] = _x("if else for while return const let var throw case function class")
for _lang in SCRIPT:
    PRODUCTIONS[_lang, "top"] = PRODUCTIONS[_lang, "block"]
    PRODUCTIONS[_lang, "switch"] = rf"(?:(?:case {_x('; case return if :')}|default ): )*(?:{PRODUCTIONS[_lang, 'block']})?"

PRODUCTIONS = {k: coded(v) for k, v in PRODUCTIONS.items()}
#: Shapes that no statement has, though a production lets them through.
_LOOSE = "|".join(_escaped(t) for t in "== != <= >= < + - / // % ** @ & | ^ << >> = += -= *= /= := . -> and or not in is if else lambda".split())
NEVER = {
    "python": rf"^(?:if|else|and|or|in|is|for|as|async) {_x(':')}$|lambda {_x(':')}$|(?:{_LOOSE}) $",
    "java": r"(?<!interface )(?<!class )n n n ",
    "go": r"n n n |range n n |else (?!if |\{ )|(?:= |:= |\+ |- |/ |\. |&& |\|\| |== |\* )$",
    "javascript": r"^(?:const|let|var) n : |\) : |(?:= |\+ |- |/ |\. |&& |\|\| |=> |== |=== )$",
    "typescript": r"(?:= |\+ |- |/ |\. |&& |\|\| |=> |== |=== )$",
}
NEVER = {k: coded(v) for k, v in NEVER.items()}
#: Heads of statements that go on from the one before.
GOES_ON = {
    "java": ". , ; ) + - * / % ? : == != && || < > <= >= instanceof & | ^ [ ( ::",
    "rust": ". , ; ) ? + - * / % == != && || < > <= >= as & | .. => else",
    "javascript": ". ?. , ; ) + - * / % ? : == === != !== && || ?? < > <= >= instanceof in & | ^ [ ( = from as => of }",
}
GOES_ON["typescript"] = GOES_ON["javascript"] + " satisfies [ ] { > & | extends implements"
#: Statements ending in a brace that need more: their brace holds a value.
NEEDS_MORE = {
    "java": r"(?:=|->|new|return|throw) ",
    "rust": r"^(?:let|return|(?:pub )?(?:use|const|static)) |= ",
}
NEEDS_MORE = {k: coded(v) for k, v in NEEDS_MORE.items()}
