import base64

import pytest

from corpusloom.llm import catalog, mix


@pytest.fixture(scope="module")
def tokenizer(tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "bytes.tiktoken"  # a public byte alphabet without merges: a token is a byte
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    return str(path)


SCHEMA = "doc_id long, text string, lang string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def test_shortages_go_to_siblings_before_ancestors():
    leaves = {("a", "en", "x"): (0.4, 10.0), ("a", "en", "y"): (0.1, 100.0), ("a", "de", "z"): (0.5, 100.0)}
    got = mix.budgets(leaves, 100)
    assert got == pytest.approx({("a", "en", "x"): 10, ("a", "en", "y"): 40, ("a", "de", "z"): 50})
    got = mix.budgets({**leaves, ("a", "en", "y"): (0.1, 20.0)}, 100)
    assert got == pytest.approx({("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "de", "z"): 70})
    assert mix.fill(50, [1, 1, 2], [5, 100, 100]) == pytest.approx([5, 15, 30])
    assert mix.budgets({}, 5) == {}


def test_shares_are_met_and_caps_hold(spark, tokenizer):
    docs = [(i, "x" * (3 + i % 7), ["en", "de", None][i % 3], ["a", "b", "c", "d", None][i % 5]) for i in range(1500)]
    docs += [(0, docs[0][1], docs[0][2], docs[0][3]), (5000, None, "en", "a"), (5001, "", "en", "a"), (None, "x", "en", "a")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "7 as tokens")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 1), ("e", 0.1, 3)], TARGETS)
    used, shares = mix.mix(df.select("doc_id", "text", "lang", "source"), targets, tokenizer=tokenizer)
    rows = used.collect()
    assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} == {"a", "b", "c"}
    caps = {"a": 2, "b": 4, "c": 1}
    assert all(1 <= r.repeats <= caps[r.source] and r.tokens == len(docs[r.doc_id][1]) for r in rows)
    got = {r.source: r for r in shares.collect()}
    assert got["e"].tokens == 0 and got["e"].target_share == 0.1
    for s, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert got[s].tokens == sum(r.tokens * r.repeats for r in rows if r.source == s)
        assert abs(got[s].share - want) < 0.01
    again = mix.mix(df.repartition(7).select("doc_id", "text", "lang", "source"), targets, tokenizer=tokenizer)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_given_total_and_empty_tables(spark, tokenizer):
    docs = spark.createDataFrame([(i, "abcd", "en", "a") for i in range(50)] + [(90, "abcd", "en", "b")], SCHEMA)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    got = {r.source: r.tokens for r in mix.mix(docs, targets, total=100, tokenizer=tokenizer)[1].collect()}
    assert got == {"a": 92, "b": 8}
    used, shares = mix.mix(docs.limit(0), targets, tokenizer=tokenizer)
    assert used.count() == 0 and [r.share for r in shares.collect()] == [0, 0]
    assert mix.mix(docs, targets.limit(0), tokenizer=tokenizer)[0].count() == 0


def test_all_tokens_of_the_sources_fix_the_total(spark, tokenizer):
    docs = spark.createDataFrame([(i, "abcd", "en", "a", "x") for i in range(50)] + [(90, "abcd", "en", "b", "x")] + [(i, "abcd", "en", "c", "y") for i in range(100, 120)], SCHEMA + ", kind string")
    targets = spark.createDataFrame([("a", 0.25, 2), ("b", 0.25, 1), ("c", 0.5, 6)], TARGETS)
    used, shares = mix.mix(docs, targets, total=mix.ALL_TOKENS, tokenizer=tokenizer, domain="kind")
    # of 284 tokens, b's missing 67 go to its sibling a; c repeats towards its half
    assert {r.source: r.tokens for r in shares.collect()} == {"a": 136, "b": 4, "c": 140}
    assert {r.repeats for r in used.filter("source = 'c'").collect()} == {1, 2}


def test_caps_and_repeats_decide_the_registered_mixture(spark):
    d = "/root/testdata/sf0.01"
    cap = {r.source: r.max_repeats for r in spark.read.parquet(f"{d}/mix_targets.parquet").collect()}
    rows = catalog.QUERIES["p9_mixture"](spark, d).collect()
    assert all(1 <= r.repeats <= cap[r.source] for r in rows) and max(r.repeats for r in rows) > 1
    held = {r.source: r.n for r in spark.read.parquet(f"{d}/documents.parquet").filter("text <> ''").groupBy("source").agg({"doc_id": "count"}).toDF("source", "n").collect()}
    assert sum(r.source == "survey_replies" for r in rows) == held["survey_replies"]
    got = {r.source: r for r in catalog.QUERIES["p9_shares"](spark, d).collect()}
    assert got["survey_replies"].share < got["survey_replies"].target_share - 0.03
    assert sum(r.tokens for r in got.values()) == sum(r.tokens * r.repeats for r in rows)
