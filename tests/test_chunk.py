import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunk, syntax
from corpusloom.operators.chunk import ChunkRule, ChunkRules

SOURCES = {
    "python": ("import a\nfrom b import c\n\n@d\ndef f():\n    def g(): pass\n\nclass K:\n    x = 1\n    def m(self): pass\n", {("imports", None), ("fn", "f"), ("class", "K"), ("method", "K.m")}),
    "rust": ("use a::b;\npub struct S { x: u8 }\nimpl<T> S {\n    fn m(&self) { let s = \"}\"; }\n}\nimpl D for S { fn n() {} }\nmod t {\n    fn q() {}\n}\nmacro_rules! mm { () => {} }\nconst X: u8 = 1;\nenum E { A, B }\ntrait T { fn z(); }\nfn f() {}\n", {("use", None), ("struct", "S"), ("impl_method", "S::m"), ("impl_method", "S::n"), ("fn", "q"), ("macro", "mm"), ("const", "X"), ("enum", "E"), ("trait", "T"), ("fn", "f")}),
    "go": ("package a\n\ntype S struct {\n\tx int\n}\ntype I interface {\n\tM()\n}\nfunc (s *S) M() {\n}\nfunc F() int {\n\treturn 1\n}\n", {("struct", "S"), ("interface", "I"), ("method", "S.M"), ("fn", "F")}),
    "java": ("package a;\nimport b.C;\npublic class K {\n  private int x = 3;\n  public K() { }\n  @Override\n  public int m(String s) { if (x) { return g(); } return 1; }\n}\ninterface I { void z(); }\nenum E { A }\n", {("class", "K"), ("method", "K.K"), ("method", "K.m"), ("interface", "I"), ("method", "I.z"), ("enum", "E")}),
    "typescript": ("import x from 'y';\nexport class K extends B {\n  constructor(a) { super(); }\n  async m(): Promise<void> { if (a) { f(); } }\n}\nexport interface I { a: string }\ntype T = string;\nenum E { A }\nexport default function f(a: number) { return 1; }\n", {("class", "K"), ("method", "K.constructor"), ("method", "K.m"), ("interface", "I"), ("type", "T"), ("enum", "E"), ("fn", "f")}),
    "javascript": ("export function f() {}\nclass K { m() { return 1; } }\nconst g = () => 1;\n", {("fn", "f"), ("class", "K"), ("method", "K.m")}),
    "csharp": ("using A;\nnamespace N {\n  public class K {\n    public K() { }\n    public int M(int a) { return 1; }\n  }\n  public interface I { void Z(); }\n  public record R(int X);\n  enum E { A }\n}\n", {("class", "K"), ("method", "K.K"), ("method", "K.M"), ("interface", "I"), ("method", "I.Z"), ("record", "R"), ("enum", "E")}),
    "kotlin": ("package a\nclass K {\n  fun m(): Int { return 1 }\n  companion object {\n    fun of() = K()\n  }\n}\ninterface I { }\nobject O { }\nval top = 1\nfun f(a: Int): Int { return a }\n", {("class", "K"), ("method", "K.m"), ("method", "K.of"), ("interface", "I"), ("object", "O"), ("property", "top"), ("fn", "f")}),
    "swift": ("import A\nstruct S {\n  init(a: Int) { }\n  func m() -> Int { return 1 }\n}\nprotocol P { func z() }\nextension S { func q() { } }\nfunc f() { }\n", {("struct", "S"), ("method", "S.init"), ("method", "S.m"), ("protocol", "P"), ("method", "P.z"), ("extension", "S"), ("method", "S.q"), ("fn", "f")}),
    "dart": ("import 'a';\nclass P {\n  P(this.x);\n  int m() { return 1; }\n}\nenum E { a }\nmixin M { }\nint f(int a) { return a; }\n", {("class", "P"), ("method", "P.P"), ("method", "P.m"), ("enum", "E"), ("mixin", "M"), ("fn", "f")}),
    "cpp": ("#include <a>\nnamespace n {\nint f(int a) { return a; }\nclass K {\n public:\n  int m() { return 1; }\n};\n}\ntemplate <typename T>\nT g(T a) { return a; }\nvoid K::o() { }\nstruct S { int x; };\nenum E { A };\n", {("namespace", "n"), ("method", "n::f"), ("class", "K"), ("method", "K::m"), ("fn", "g"), ("fn", "K::o"), ("struct", "S"), ("enum", "E")}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_kinds_and_names(lang):
    text, want = SOURCES[lang]
    items = syntax.parse(text, lang)
    assert want <= {(k, n) for _, _, k, n, _ in items}
    lines = text.split("\n")
    for a, b, _, _, t in items:
        assert t in text and t.split("\n")[0] in lines[a - 1] and t.split("\n")[-1] in lines[b - 1]
    assert syntax.parse("", lang) == []


def test_line_windows():
    text = "\n".join(map(str, range(1, 101)))
    assert [(a, b) for a, b, _ in chunk.line_chunks(text, ChunkRule("lines", 10, 2, 10**6))][:2] == [(1, 10), (9, 18)]
    assert [(a, b) for a, b, _ in chunk.line_chunks("\n".join(["x" * 100] * 30), ChunkRule("lines", 60, 1, 303))][0] == (1, 3)
    parts = chunk.line_chunks("One. " * 50, ChunkRule("lines", 10, 0, 60))
    assert len(parts) > 1 and all(a == b == 1 for a, b, _ in parts) and "".join(t for *_, t in parts) == "One. " * 50
    with pytest.raises(ValueError):
        ChunkRule("lines", 5, 5, 100)
    with pytest.raises(ValueError):
        ChunkRules(per_language={"perl": ChunkRule("tree-sitter")})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\né!", max_size=300), st.integers(1, 8), st.integers(0, 7), st.integers(1, 60))
def test_line_windows_cover_everything(text, n, overlap, size):
    rule = ChunkRule("lines", n, min(overlap, n - 1), size)
    seen = set()
    for a, b, t in chunk.line_chunks(text, rule):
        assert b - a < n
        seen.update(range(a, b + 1))
    assert {i + 1 for i, x in enumerate(chunk.split_lines(text)) if x.strip()} <= seen


def test_headings_agree_with_their_sql_form(spark):
    texts = {
        "a": "# one\ntext\n## two\n```\n# not\n```\n### three\n#tag\n", "b": "intro\n# x\n\n# y\nz", "c": "", "d": "no headings\n", "e": "\n\n## q\n  # indented\n",
    }
    df = spark.createDataFrame(list(texts.items()), "file string, text string")
    want = {(f, *c) for f, t in texts.items() for c in chunk.heading_chunks(t, ChunkRule("headings"))}
    assert {(r.file, r.start_line, r.end_line, r.text) for r in chunk.heading_sections(df).collect()} == want
    rules = ChunkRules(per_language={"markdown": ChunkRule("headings"), "go": ChunkRule("tree-sitter")})
    files = df.withColumn("lang", F.lit("markdown")).union(spark.createDataFrame([("g", SOURCES["go"][0], "go"), ("h", "x\ny", "zig"), ("n", None, "go")], "file string, text string, lang string"))
    got = chunk.chunk_files(files, rules).collect()
    assert {(r.file, r.start_line, r.end_line, r.text) for r in got if r.file in texts} == want
    assert ("F" in {r.name for r in got}) and [r.text for r in got if r.file == "h"] == ["x\ny"]


def test_go_type_groups_and_templates_on_a_line_of_their_own():
    from corpusloom.operators import syntax

    text = "package a\n\ntype (\n\tA int\n\tB struct {\n\t\tx int\n\t}\n\tC[T any] interface {\n\t\tf()\n\t}\n)\n\nfunc f() {\n}\n"
    assert [x[:4] for x in syntax.parse(text, "go")] == [(4, 4, "type", "A"), (5, 7, "struct", "B"), (8, 10, "interface", "C"), (13, 14, "fn", "f")]
    text = "int a() { return 1; }\n\ntemplate <typename T>\nT f(T a) {\n  return a;\n}\n\nint g() { return 2; }\n"
    assert [x[:4] for x in syntax.parse(text, "cpp")] == [(1, 1, "fn", "a"), (3, 6, "fn", "f"), (8, 8, "fn", "g")]


def test_line_windows_count_every_line_end_and_keep_blank_windows():
    from corpusloom.operators import chunk

    rule = chunk.ChunkRule("lines", 60, 1, 29)
    assert [x[:2] for x in chunk.line_chunks("\n".join(["x" * 9] * 6), rule)] == [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert [x[:2] for x in chunk.line_chunks("\n".join(["a", "", "", "b"]), chunk.ChunkRule("lines", 1, 0, 100))] == [(1, 1), (2, 2), (3, 3), (4, 4)]
