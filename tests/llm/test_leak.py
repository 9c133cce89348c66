import random

from pyspark.sql import functions as F

from corpusloom.llm import leak


def edit_distance_to_substring(p, t):
    row = list(range(len(p) + 1))
    best = []
    for w in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p[i - 1] != w)))
        row = new
        best.append(row[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 13))], [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        assert leak.myers(p, t) == edit_distance_to_substring(p, t)


def test_random_plants_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "数据"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 13, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        src = rng.choice(items)[1].split()
        a = rng.randint(0, max(0, len(src) - 8))
        part = src[a : a + rng.randint(8, 20)]
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "zz"]])
        at = rng.randint(0, len(words))
        docs.append((d, rng.choice([", ", "\n", " - "]).join(words[:at] + part + words[at:]).upper()))
    got = leak.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), max_errors=1, block_bytes=300).collect()
    want = {}
    for d, dt in docs:
        dw = leak.word_list(dt)
        for i, it in items:
            iw = leak.word_list(it)
            errors = min((min(leak.myers(iw[k : k + 13], dw), default=13) for k in range(len(iw) - 12)), default=13)
            if errors <= 1:
                want[d, i] = errors
    assert {(r.doc_id, r.item_id): r.errors for r in got} == want and 0 in want.values() and 1 in want.values()


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(13))
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "x " * 50_000 + text)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, text), (7, text), (8, text), (9, None), (10, "short"), (None, text)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.errors) for r in leak.find_leaks(docs, items).collect()}
    assert got == {(d, i, 0) for d in (1, 4) for i in (7, 8)}
    assert leak.find_leaks(docs.limit(0), items).count() == 0
    assert leak.find_leaks(docs, items.limit(0)).count() == 0
