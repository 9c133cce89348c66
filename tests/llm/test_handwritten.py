import random

from corpusloom.llm import handwritten

SCHEMA = "file_id long, repo string, relative_path string, text string"
BODY = "import x\n\ndef f(a):\n    return a + 1\n" * 20
C_BODY = "package a\n\nfunc F(a int) int {\n\treturn a + 1\n}\n" * 20
MINI = "function a(b,c){return d.e(b)}if(x!==y)z=q.w(y);" * 40
CASES = [
    ("src/a.py", BODY, None), ("vendor/q/a.py", BODY, "vendored"), ("src/vendor_portal/a.py", BODY, None), ("deps/q/a.go", C_BODY, "vendored"),
    ("x/contrib/q-2.x/a.go", C_BODY, "vendored"), ("x/contrib/notes/a.go", C_BODY, None), ("a/_generated/b.py", BODY, "generated"),
    ("a/generated_at_b.py", BODY, None), ("a/zz_generated.b.go", C_BODY, "generated"), ("a/b_pb2.py", BODY, "generated"), ("a/codegen_b.py", BODY, None),
    ("a.py", "# Code generated by protoc. DO NOT EDIT.\n" + BODY, "generated"), ("a.py", 'X = "Code generated by protoc. DO NOT EDIT."\n' + BODY, None),
    ("a.py", "# Not generated: code generated by protoc.\n" + BODY, None), ("a.py", BODY + "\n# Code generated by protoc. DO NOT EDIT.\n", None),
    ("a.go", "/*\n * Vendored from q 1.2.3. Keep in sync with upstream.\n */\n" + C_BODY, "vendored"), ("a.go", "// Upstream the log is cut.\n" + C_BODY, None),
    ("a.go", "// Copyright 2020 the other authors. Released\n" + C_BODY, "vendored"), ("a.go", "// Copyright 2020 the me authors. Released\n" + C_BODY, None),
    ("a.js", MINI, "minified"), ("a.min.js", "x", "minified"), ("a.json", "[" + "1, " * 900 + "1]", None), ("vendor/a.toml", "a = 1", None),
    ("a.py", "T = [\n" + "    0x12, 0xff, 0x00,\n" * 200 + "]\n", "data"), ("a.rs", "pub static T: &[&str] = &[\n" + '    "abc", "de\\"f",\n' * 100 + "];\n", "data"),
    ("a.py", None, None), ("a.py", "", None), (None, BODY, None),
]


def test_cases(spark):
    rows = [(i, "me", p, t) for i, (p, t, _) in enumerate(CASES)] + [(0, "me", *CASES[0][:2]), (None, "me", "vendor/a.py", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as lang", "1 as reason")
    got = {r.file_id: r.reason for r in handwritten.judge(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert handwritten.judge(df.limit(0)).count() == 0


def test_copies_across_repositories_are_found_in_spite_of_layout(spark):
    rng = random.Random(1)
    code = lambda: [f"    v{rng.randint(0, 999)} = f{rng.randint(0, 999)}(a{rng.randint(0, 99)}, {rng.randint(0, 9)})" for _ in range(80)]
    shared = code()
    rows = []
    for i in range(10):  # the same code, re-indented and commented anew
        rows.append((i, f"r{i}", f"src/u{i}.py", "def g():\n" + "\n".join(("\t" * (i % 3 + 1)) + x.strip() + "  # note %d" % i for x in shared)))
        rows.append((100 + i, f"r{i}", f"src/w{i}.py", "def g():\n" + "\n".join(code())))
        rows.append((200 + i, "one", f"src/z{i}.js", "\n".join(x.strip() + ";" for x in shared[:0]) + "let same = 1; " * 30))
    got = {r.file_id: r.reason for r in handwritten.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k for k, v in got.items() if v} == set(range(10)) and set(got.values()) == {None, "copied"}


def test_winnowing_keeps_a_mark_in_every_window():
    rng = random.Random(2)
    tokens = [rng.getrandbits(63) for _ in range(500)]
    whole = set(handwritten.fingerprints(tokens, 4, 10).tolist())
    for at in range(0, 480):
        assert whole & set(handwritten.fingerprints(tokens[at : at + 13], 4, 10).tolist())
