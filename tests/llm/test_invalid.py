from corpusloom.llm import invalid

SCHEMA = "file_id long, repo string, relative_path string, text string"
GOOD = {
    "a.py": 'import os\n\nclass A(B):\n    """x: {"""\n\n    @staticmethod\n    async def f(a, *, b: int = 3, **k) -> dict[str, int]:\n        if a:\n            return {**k, "x": [i for i in a if i]}\n        elif not a:\n            pass\n        else:\n            x = a if a else b\n        try:\n            y = (1,\n2)\n        except (E, F) as e:\n            raise G from e\n        finally:\n            pass\n        return lambda q: -q\n',
    "b.rs": "use crate::a::{B, C};\n\n#[derive(Debug)]\npub struct S<'a, T: Clone> { x: &'a [u8], y: Option<Vec<T>> }\n\nimpl<'a> S<'a> {\n    pub(crate) fn f(&mut self, c: char) -> Result<(), E> {\n        let v = self.x.iter().map(|q| q + 1).collect::<Vec<_>>();\n        match c { 'a'..='z' => {}, _ if v.len() > 3 => return Err(e)?, '\\'' => (), }\n        println!(\"{}\", r#\"a\"b\"#);\n        Ok(())\n    }\n}\n",
    "c.go": 'package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\ta int\n\tb map[string][]*T\n}\n\nfunc (t *T) F(x string, ys ...int) (int, error) {\n\tfor _, y := range ys {\n\t\tgo func() { ch <- y }()\n\t}\n\tswitch v := x.(type) {\n\tcase string:\n\t\treturn 1, nil\n\tdefault:\n\t\tv++\n\t}\n\treturn 0, fmt.Errorf("{ %w", err)\n}\n',
    "d.ts": "import { A } from './a';\nimport type B from 'b';\n\nexport interface C<T> extends A { readonly x?: string; f(a: number): Promise<T[]>; }\nexport type D = string | { a: number } | undefined;\nconst f = async (a: string, b?: number): Promise<void> => { await g(a!, `x ${b} (`); };\nexport default class E extends A implements C<string> {\n  private static y = 3;\n  constructor(private z: string) { super(); }\n  get q(): number { return this.y ?? 0; }\n}\n",
    "e.js": "import x, { y as z } from './x';\nconst r = /[/\"]+/g.test(a) ? b : c;\nlet o = { a: 1, async f(b) { return b; }, ...x };\nfor (const k of ks) { if (k) continue; else break; }\nexport { z };\n!function(a){return a}(1);function q(){}!function(){}();\n",
    "f.java": 'package a.b;\n\nimport java.util.*;\n\npublic final class F<T extends G> implements H {\n    private static final Map<String, List<T>> M = new HashMap<>();\n    @Override\n    public int f(final String[] a, int... b) throws E {\n        for (var x : a) { m.stream().filter(q -> q != 3).forEach(F::g); }\n        int c = (int) d;\n        switch (c) { case 1: break; default: return 0; }\n        try { g(); } catch (A | B e) { throw new E("{", e); }\n        return c > 0 ? 1 : -1;\n    }\n}\n',
    "g.json": '{"a": [1, -2.5e3, true, null, {"b": {}}], "c": "\\u00e9"}',
    "h.toml": 'a = 1\n[b.c]\nd = ["x", 2]\n[[e]]\nf = { g = 1 }\nh = """\nx\n"""\n',
    "empty.py": "", "crlf.go": "package a\r\n\r\nvar x int\r\n", "n.md": "def (", "nul.py": None,
}
BAD = {
    "b1.py": "if x\n    y = 1\n", "b2.py": "def f():\nreturn 1\n", "b3.py": "try:\n    x = 1\ny = 2\n", "b4.py": "x = (1,\n", "b5.py": "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n",
    "b6.py": "package a\n\nfunc f() {\n}\n", "b7.py": "x = 'abc\n", "b8.py": "if x:\n    y = 1\n  z = 2\n", "b9.py": "x = 1\n    y = 2\n", "b10.py": "else:\n    x = 1\n",
    "b1.rs": "fn f() { g(); \n", "b2.rs": "package a;\npublic class A { }\n", "b3.rs": "fn f() {\n<<<<<<< HEAD\n    g();\n=======\n    h();\n>>>>>>> b\n}\n",
    "b1.go": 'package a\nfunc f() { x := map[string]int{"a\n', "b2.go": "import { A } from 'a';\nconst x = 1;\n", "b3.go": "public class A {\n  private static int x = 3;\n}\n",
    "b1.ts": "package a\n\nimport (\n\t\"fmt\"\n)\nfunc f(x string) error {\n\ty := 1\n}\n", "b2.ts": "function f() { return (1; }\n",
    "b1.js": "function f(a: string): number {\n  return 1;\n}\n", "b2.js": "<!DOCTYPE html>\n<html><head></head></html>\n", "b3.js": "/* never ends\nlet x = 1;\n",
    "b1.java": "use crate::a::B;\nfn f(x: &str) -> u8 { 1 }\n", "b2.java": "class A {\n  void f() { g(]; }\n}\n",
    "b1.json": '{"a": 1,}', "b2.json": '{"a" 1}', "b3.json": "<html>", "b4.json": '{"a": [1, 2}', "b1.toml": "a = \n", "b2.toml": "a = 1 b = 2\n", "b3.toml": "[a\nb = 1\n",
}


def test_good_and_bad_files(spark):
    rows = [(i, "r", p, t) for i, (p, t) in enumerate([*GOOD.items(), *BAD.items()])]
    df = spark.createDataFrame(rows + rows[:3] + rows[-3:] + [(None, "r", "a.py", "(")], SCHEMA).selectExpr("*", "'x' as lang", "1 as n")
    got = {r.file_id for r in invalid.invalid_files(df).collect()}
    names = [*GOOD, *BAD]
    assert {names[i] for i in got} == set(BAD)
    rate = {(r.repo, r.lang): (r.n_files, r.n_invalid) for r in invalid.rates(df).collect()}
    assert rate["r", "json"] == (5, 4) and rate["r", "rust"] == (4, 3)
    assert invalid.invalid_files(df.limit(0)).count() == 0


def test_very_long_file(spark):
    text = "def f():\n" + "    x = g(1, [2, 3])\n" * 30_000
    df = spark.createDataFrame([(1, "r", "a.py", text), (2, "r", "b.py", text + "    y = (")], SCHEMA)
    assert [r.file_id for r in invalid.invalid_files(df).collect()] == [2]


STATEMENTS = {
    "a.java": ["import a.b;", "class A {", "  int x = 1;", "  void f() {", "    if (x) {", "      g();", "    } else {", "      h();", "    }", "    try {", "      g();", "    } catch (E e) {", "      h();", "    }", "    int y = 2;", "    return;", "  }", "}"],
    "a.rs": ["use a::b;", "struct S {", "    x: u8,", "    y: u8", "}", "fn f() {", "    if x {", "        g();", "    } else {", "        h();", "    }", "    let y = 2;", "    h();", "    k()", "}"],
    "a.go": ["package a", "func f() {", "\tif x {", "\t\tg()", "\t} else {", "\t\th()", "\t}", "\ty := []int{", "\t\t1,", "\t}", "}"],
    "a.ts": ["function f(a: string,", "  b: number) {", "  if (a) {", "    g();", "  } else {", "    h()", "  }", "  try {", "    g();", "  } catch (e) {", "    h();", "  }", "}"],
    "a.js": ["function f(a,", "  b) {", "  if (a) {", "    g();", "  } else {", "    h()", "  }", "  try {", "    g();", "  } catch (e) {", "    h();", "  }", "}"],
}
#: (file, line, what it becomes): pairs within lines and nesting stay as they were.
BROKEN = [
    ("a.java", 0, "import a.b"), ("a.java", 2, "  int x = 1"), ("a.java", 5, "      g()"), ("a.java", 14, "    int y = 2"), ("a.java", 15, "    return"), ("a.java", 4, "    while (x) {"), ("a.java", 11, "    } while (e) {"), ("a.java", 9, "    {"), ("a.java", 17, "} f();"),
    ("a.rs", 0, "use a::b"), ("a.rs", 2, "    x: u8"), ("a.rs", 6, "    while x {"), ("a.rs", 11, "    let y = 2"), ("a.rs", 12, "    h()"), ("a.rs", 14, "} let x = 1;"),
    ("a.go", 4, "\t}\n\telse {"), ("a.go", 4, "\t} else {\n\t} else {"), ("a.go", 8, "\t\t1"), ("a.go", 2, "\tif x\n\t{"), ("a.go", 10, "}\nf()"), ("a.go", 0, ""),
    ("a.ts", 0, "function f(a: string"), ("a.ts", 2, "  while (a) {"), ("a.ts", 9, "  } while (e) {"), ("a.ts", 7, "  {"),
    ("a.js", 0, "function f(a"), ("a.js", 2, "  while (a) {"), ("a.js", 9, "  } while (e) {"), ("a.js", 7, "  {"),
]
#: Valid texts that come near to the productions.
NEAR = {
    "n.java": "class A {\n  int[][] a = {{1}, {2}};\n  enum B { C(1), D(2) { void f() { } }; B(int x) { } }\n  A(int x)\n      throws E {\n    if (x) if (y) f(); else g(); else h();\n    do { f(); } while (x);\n    Runnable r = new Runnable() {\n      public void run() { f(); }\n    };\n    String s = (String)\n        y;\n    for (int i : a)\n      f();\n    try (R q = f()) { g(); }\n    return a\n        .b();\n  }\n}\n",
    "n.rs": "fn f() -> u8 {\n    let x = if a { 1 } else { 2 };\n    let Some(y) = z else { return 1; };\n    match x {\n        1 => foo(),\n        2 if y\n            && z => { bar() }\n        _ => 3,\n    };\n    if x { return 1 }\n    let v = a\n        .b()?;\n    v\n}\n",
    "n.go": "package a\n\nvar (\n\ta = 1\n\tb = 2\n)\n\nfunc f() {\n\tx := []struct {\n\t\ta int\n\t}{\n\t\t{1},\n\t}\n\tdefer func() {\n\t\tg()\n\t}()\n\tif a {\n\t\tg()\n\t} else if b {\n\t\th()\n\t} else {\n\t\tk()\n\t}\n}\n",
    "n.js": "const x = { catch: 1, f() { return 1 } }\np.then(q).catch((e) => {\n  r(e)\n})\n  .finally(() => { })\nif (a) x = { y: 1 }; else z()\nif (a) b(); else if (c) d(); else e();\n",
    "n.ts": "abstract class A {\n  catch(e) { return e }\n  async f(): Promise<{ a: B }> {\n    try {\n      await g()\n    } finally { h() }\n  }\n}\n",
}


def test_statements_of_brace_languages(spark):
    broken = [(p, "\n".join([*STATEMENTS[p][:k], line, *STATEMENTS[p][k + 1 :]])) for p, k, line in BROKEN]
    good = [*((p, "\n".join(x) + "\n") for p, x in STATEMENTS.items()), *NEAR.items()]
    df = spark.createDataFrame([(i, "r", p, t) for i, (p, t) in enumerate([*good, *broken])], SCHEMA)
    got = {r.file_id for r in invalid.invalid_files(df).collect()}
    assert got == set(range(len(good), len(good) + len(broken)))


#: What stands around a statement, and statements that are none; each is put into a file of its own.
AROUND = {"java": ("class A {\n  void f() {\n", "\n  }\n}\n"), "rs": ("fn f() {\n", "\n}\n"), "go": ("package a\n\nfunc f() {\n", "\n}\n"), "ts": ("function f() {\n", "\n}\n"), "js": ("function f() {\n", "\n}\n")}
FAULTS = {
    'java': ['int x = ;', 'return return;', 'if (x) }', 'else { g(); }', 'for (int i = 0; i < 3) i++ { } }', 'int = 3;', 'try { g(); }', 'void g() { h(); }', 'x = 1 y = 2;', 'case 1: g();', 'foo(1, );', 'String s = "a" "b";'],
    'rs': ['let = 3;', 'let x 3;', 'else { g(); }', 'fn { }', 'if { } else { } else { }', 'match x { 1 => }', 'let x = 1 let y = 2;', 'for x { }', 'struct { x: u8 }', 'x = = 3;', 'return fn;', 'g(1 2);'],
    'go': ['x := ', 'if x { } else } {', 'else { g() }', 'for x := range y z { }', 'func g() { }', 'var = 3', 'x y z', 'return return', 'if x { g() }\n\telse { h() }', 'x := [1, 2]', 'g(1 2)', 'case 1:'],
    'ts': ['const x;', 'let x: = 3;', 'else { g(); }', 'try { g(); }', 'function () { }', 'class { }', 'if x { g(); }', 'x = ;', 'for (const x y) { }; }', 'catch (e) { }', 'return return;', 'let 3 = x y;'],
    'js': ['const x;', 'let = = 3;', 'else { g(); }', 'try { g(); }', 'function () { }', 'class { }', 'if x { g(); }', 'x = ;', 'return return;', 'catch (e) { }', 'let x: number = 3;', 'g(1 2);'],
}
FAULTY_FILES = [('t.rs', 'let x = 1;\n'), ('t.rs', 'g();\n'), ('t.rs', 'fn () { }\n'), ('t.rs', 'struct { x: u8 }\n'), ('t.rs', 'impl { }\n'), ('t.java', 'int f() { return 1; }\nif (x) { }\n'), ('t.java', 'class { }\n'), ('t.java', 'package ;\nclass A { }\n'), ('t.java', 'class A { x = 3; if (y) { } }\n'), ('t.go', 'package a\nx := 3\n'), ('t.go', 'package a\nfunc { }\n'), ('t.go', 'package a\nif x { }\n'), ('t.py', 'def f:\n    pass\n'), ('t.py', 'class :\n    pass\n'), ('t.py', 'x = = 1\n'), ('t.py', 'for x y:\n    pass\n'), ('t.py', 'import\n'), ('t.py', 'from x import\n'), ('t.py', 'x = 1 +\n'), ('t.py', 'if x = 1:\n    pass\n'), ('t.py', 'def f(x y):\n    pass\n'), ('t.py', 'return x y\n'), ('t.py', 'lambda x\n'), ('t.py', 'f(a b)\n'), ('t.py', 'else:\n    pass\n'), ('t.py', 'while:\n    pass\n')]
#: Valid files with many kinds of statements.
VALID = [
    ('ok.java', 'package a;\n\npublic record P(int x, String y) implements Q { P { check(); } static int z = 3; }\n'),
    ('ok.java', 'import static a.b.C.*;\n@interface N { int v() default 3; }\nsealed interface S permits A, B { }\nclass A {\n  static { f(); }\n  int[] a = new int[]{1, 2}, b[];\n  <T extends B> T g(List<? super T> x) { label: for (;;) { if (a) continue label; else break; } return switch (x) { case 1 -> 2; default -> { yield 3; } }; }\n  Runnable r = () -> { f(); };\n  void h() { synchronized (this) { x++; } int y = a ? b : c; f(x -> { return y; }); throw new E("x"); }\n}\n'),
    ('ok.rs', '#![allow(x)]\nuse std::{io, fmt::{self, Debug}};\npub(crate) mod a { pub fn f() {} }\npub enum E { A, B(u8), C { x: u8 } }\ntrait T: Clone + \'static { const N: usize; type X; fn f(&self) -> u8; fn g() {} }\nunsafe impl<T> Send for S<T> where T: Send {}\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nstatic X: &str = "a";\nasync fn h(x: impl Fn(u8) -> u8) -> Result<(), Box<dyn Error>> {\n    let (a, mut b) = (1, 2);\n    let v: Vec<u8> = vec![1; 3];\n    \'o: loop { if a > b { break \'o; } b += 1; }\n    while let Some(x) = it.next() { f(x)?; }\n    let s = S { x: 1, ..Default::default() };\n    let Ok(q) = r else { return Err(e.into()); };\n    if let Some(x) = y && z { g(); } else if w { h().await?; }\n    match s { S { x, .. } if x > 3 => { f() } S { x: 1 | 2, .. } => g(), _ => unreachable!(), }\n    for (i, x) in v.iter().enumerate() { println!("{i}"); }\n    unsafe { *p = 3; }\n    let c = |x: u8| -> u8 { x + 1 };\n    x as u64\n}\n'),
    ('ok.go', 'package a\n\nimport "fmt"\n\ntype (\n\tA int\n\tB interface {\n\t\tf(x int) (y, z error)\n\t\tfmt.Stringer\n\t}\n)\n\ntype G[T any] struct {\n\tx, y T\n\t*B `json:"b"`\n}\n\nvar x, y = 1, 2\n\nconst (\n\tc = iota\n\td\n)\n\nfunc (g *G[T]) f(a ...int) (r int, err error) {\n\tif x, ok := m[1]; ok && x > 2 {\n\t\treturn 1, nil\n\t} else if !ok {\n\t\tgoto end\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor range ch {\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\tg(v)\n\tcase <-done:\n\tdefault:\n\t}\n\tswitch {\n\tcase x > 1, y < 2:\n\t\tfallthrough\n\tdefault:\n\t\tch <- 1\n\t}\n\ts := []T{{1, 2}, {3, 4}}\n\tm := map[string]int{\n\t\t"a": 1,\n\t}\n\tf := func(x int) int { return x }\n\tdefer func() { recover() }()\nend:\n\tx.y[1], z = 2, &T{a: 1}\n\treturn\n}\n'),
    ('ok.ts', "import type { A } from './a';\nimport * as b from 'b';\nimport c, { d } from 'c';\nexport * from './e';\nexport { A, B as C } from './f';\ndeclare module 'x' { export function f(a: string): void; }\nexport enum E { A = 1, B }\ntype F<T> = { [K in keyof T]?: T[K] } & { a: string };\ntype U = | 'a' | 'b'\ninterface G { readonly a: string\n  b?(x: number): void\n  [key: string]: unknown }\nabstract class H<T> extends I<T> implements J {\n  private x = 1\n  static #y: Map<string, number> = new Map()\n  constructor(private readonly z: string, public w?: number) { super() }\n  abstract f(): void;\n  get g(): number { return this.x }\n  async *h<U>(a: U): AsyncGenerator<U> { yield a }\n}\nexport const f = async <T,>(a: T): Promise<T | undefined> => { try { return await g(a) } catch { return undefined } }\nlet x = a as unknown as string, y = b!\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else { h(v) } }\nexport default class { }\nfunction over(a: string): void;\nfunction over(a: any) { switch (a) { case 'x': return 1; default: break } }\nlet z = cond ? { a: 1 } : [2]\nconst { p, q: { r } } = s;\nx satisfies Y;\n"),
    ('ok.js', "'use strict'\nconst { a, b } = require('x')\nlet c, d = 1\nvar e = function () { return 1 }\nasync function* f() { for await (const x of y) { yield* x } }\nclass A extends B { static x = 1; #y = 2; get z() { return this.#y } static { f() } async m() { } [k]() { } }\nmodule.exports = { a, b: 1, c() { }, get d() { return 1 }, ...e, [f]: g, async *h() { } }\ndo { x++ } while (x < 3)\nif (a) b\nelse c\nswitch (a) { case 1: case 2: { f(); break } default: g() }\nlabel: for (let i = 0, n = 3; i < n; i++) { continue label }\ntry { f() } catch { g() } finally { h() }\nconst t = `a ${b} c`, r = /x[/]y/g\nexport default function () { }\nx = y ? z : { w: 1 }\n;[1, 2].map(n => n * 2)\nthrow new Error('x')\n"),
    ('ok.py', "from __future__ import annotations\nimport a.b as c, d\nfrom . import (e,\n    f)\nfrom ..g import *\n\n@h(1)\nclass A(B, metaclass=C):\n    x: int = 1\n    y: dict[str, int]\n    def f(self, /, a, *, b: int = 1, **k) -> None: return None\n    async def g(self):\n        async with a as b, c as d:\n            await x\n        async for i in y: pass\n        return [i async for i in z if i]\n\nmatch x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': A(b=1)} | None:\n        pass\n    case _:\n        pass\nmatch = 3\nx = y = lambda a, *b, c=1: a if b else c\nx[1:2, ::3] = {**a, 'b': 1}\nx, *y = 1, 2\nprint(*a, **b, sep='')\nif (n := 3) > 2 and not x is None: y += 1; z -= 2\nwith (open(a) as f, open(b) as g):\n    pass\ntry:\n    pass\nexcept* E as e:\n    raise F from e\nfor i, j in a: pass\nelse:\n    del x, y\nassert x, 'y'\nglobal q\ntype T = int\ndef f[T](x: T): yield from x\nx = yield\nw = 1_000.5e3j + 0x_ff + .5\nf'{x!r:>{y}}' rb'x'\n"),
]


def test_nine_of_ten_statement_faults_are_caught_and_valid_files_pass(spark):
    faulty = [(f"x.{x}", AROUND[x][0] + c + AROUND[x][1]) for x, cs in FAULTS.items() for c in cs] + FAULTY_FILES
    rows = [(i, "r", p, t) for i, (p, t) in enumerate([*faulty, *VALID])]
    got = {r.file_id for r in invalid.invalid_files(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not {i for i in got if i >= len(faulty)}
    for x in {p.rsplit(".", 1)[1] for p, _ in faulty}:
        of = [i for i, (p, _) in enumerate(faulty) if p.endswith("." + x)]
        assert len(of) >= 10 and len([i for i in of if i in got]) >= 0.9 * len(of), x


def test_equals_the_parsers_of_the_standard_library(spark):
    import ast
    import json
    import tomllib
    import warnings

    parse = {"py": ast.parse, "json": json.loads, "toml": tomllib.loads}
    files = spark.read.parquet("/root/testdata/sf0.01/files.parquet").select("file_id", "repo", "relative_path", "text")
    want = set()
    for r in files.collect():
        x = r.relative_path.rsplit(".", 1)[-1]
        if x in parse and r.text and r.text.strip():
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    parse[x](r.text)
            except (ValueError, SyntaxError):
                want.add(r.file_id)
    got = {r.file_id for r in invalid.invalid_files(files).collect() if r.lang in ("python", "json", "toml")}
    assert got == want and want


def test_productions_are_judged_once_for_a_shape_by_compiled_code(spark):
    assert max(invalid.g.CODES.values()) < "Ā" and not {*"\n\r\x85"} & {*invalid.g.CODES.values()}
    text = "def f():\n" + "    x = g(1, [2, 3])\n" * 1000 + "    y = 1 +\n"
    lexed = invalid.lexed(spark.createDataFrame([(1, "python", text)], "file_id long, lang string, text string")).localCheckpoint()
    row = lexed.first()
    assert len(row.statements) == 1002 and len(row.shapes) == len({*row.shapes}) == 5
    faults = invalid.shape_faults(lexed)
    assert faults.count() == 1
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(faults._jdf.queryExecution().executedPlan())
    sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    assert sizes and max(sizes) <= 8000  # the JVM interprets larger methods
