from corpusloom.llm import docpairs

SCHEMA = "chunk_id string, file string, lang string, kind string, name string, text string"
GOOD = "one two three four"
CASES = {
    # python
    "py1": ("a.py", "fn", "f", f'@deco("x")\ndef f(a, b=")("):\n    # note\n    """{GOOD}"""\n    return 1', True),
    "py2": ("a.py", "fn", "f", f'def f():\n    x = 1\n    """{GOOD}"""', False),
    "py3": ("a.py", "fn", "f", f'# {GOOD}\ndef f():\n    def g():\n        """{GOOD} five"""\n    return g', False),
    "py4": ("a.py", "fn", "f", f"def f(x: dict[str, int] = {{}}) -> int:\n    r'''{GOOD}'''\n", True),
    "py5": ("a.py", "fn", "f", f'def f():\n    b"{GOOD}"\n    return', False),
    "py6": ("a.py", "fn", "f", f'def f():\n    "{GOOD}".strip()\n', False),
    "py7": ("a.py", "method", "K.read_all", 'def read_all(self, path):\n    """Read all path and one two"""\n', False),
    "py8": ("a.py", "method", "K.read_all", 'def read_all(self, path):\n    """Read all path: one two three four"""\n', True),
    # rust
    "rs1": ("a.rs", "fn", "f", f"/// {GOOD}\n#[inline]\npub fn f() {{}}", True),
    "rs2": ("a.rs", "fn", "f", f"// {GOOD}\nfn f() {{ /// {GOOD}\n fn g() {{}} }}", False),
    "rs3": ("a.rs", "impl_method", "T::f", f'#[doc = "{GOOD}"]\n#[cfg(unix)]\nfn f() {{}}', True),
    "rs4": ("a.rs", "fn", "f", f"//// {GOOD}\n/* {GOOD} */\nfn f() {{}}", False),
    "rs5": ("a.rs", "fn", "f", "/// one two\n/// three four\nfn f<'a>(x: &'a str) {}", True),
    # go
    "go1": ("a.go", "fn", "F", f"// {GOOD}\n//go:noinline\nfunc F() {{}}", True),
    "go2": ("a.go", "fn", "F", f"// {GOOD}\n\nfunc F() {{}}", False),
    "go3": ("a.go", "method", "T.F", "//go:generate one two three four\nfunc (t *T) F() {}", False),
    "go4": ("a.go", "fn", "F", f"func F() {{\n// {GOOD}\n}}", False),
    # java, typescript, javascript
    "ja1": ("a.java", "method", "K.f", f'/** {GOOD} */\n@SuppressWarnings("(")\npublic int f(String a) {{ return 1; }}', True),
    "ja2": ("a.java", "method", "K.f", "/** @param a one\n * @see Other thing\n * TODO(me): later */\nint f(int a) {}", False),
    "ja3": ("a.java", "method", "K.f", f"/* {GOOD} */\n// {GOOD}\nint f() {{ /** {GOOD} */ int x; }}", False),
    "ts1": ("a.ts", "fn", "loadAllRows", "/** load all rows one two three */\nexport function loadAllRows(a: string) {}", False),
    "ts2": ("a.ts", "fn", "f", f"/** {GOOD} */\n/** no */\nfunction f() {{}}", False),
    "js1": ("a.js", "fn", "f", f"/**\n * {GOOD}\n */\nexport async function f(a) {{ return `/** ${{a}} */`; }}", True),
    # none at all
    "no1": ("a.md", "fn", "f", f"/** {GOOD} */ f", False),
    "no2": ("a.js", "class", "F", f"/** {GOOD} */ class F {{}}", False),
    "no3": ("a.js", "fn", None, None, False),
    "no4": ("a.js", "fn", "f", "", False),
}


def test_cases_nulls_and_repeats(spark):
    rows = [(k, f, None, kind, name, text) for k, (f, kind, name, text, _) in CASES.items()]
    rows += rows[:3] + [(None, "a.js", None, "fn", "f", f"/** {GOOD} */ f()"), ("nul", None, "Rust", "fn", None, f"/// {GOOD}\nfn f() {{}}")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "'x' as doc")
    got = docpairs.doc_pairs(df).collect()
    assert len(got) == len({r.chunk_id for r in got})
    assert {r.chunk_id for r in got} == {k for k, c in CASES.items() if c[-1]} | {"nul"}
    assert all("one two" in r.doc or "three four" in r.doc for r in got)
    assert docpairs.doc_pairs(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "/** " + "w " * 200_000 + "*/\nfunction f() { " + 'x("' + "é" * 300_000 + '");' * 3 + " }"
    got = docpairs.doc_pairs(spark.createDataFrame([("a", "a.js", "JavaScript", "fn", "f", text)], SCHEMA)).collect()
    assert got[0].n_words == 200_000
