import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import neardup


def shingle_set(text):
    w = [x for x in __import__("re").findall(r"\w+", text.lower())]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def family(rng, n):
    base = [f"v{rng.randint(0, 400)}" for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_links_equal_brute_force_even_in_crowded_buckets(spark):
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in family(rng, 5)] + family(rng, 40) + ["one two", "", "Ünï"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (901, texts[0]), (0, texts[0]), (902, None), (None, "a b c d")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("rep", F.lit("clash"))
    sets = {i: shingle_set(t) for i, t in rows if t is not None and i is not None}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    for star in (64, 4):
        classes, links = neardup.near_duplicates(df, "id", "text", 0.5, star=star)
        rep = {r.id: r.rep for r in classes.collect()}
        got = {(r.a, r.b) for r in links.collect()}
        assert rep[900] == rep[901] == rep[0] == 0
        assert got <= want
        missed = {(a, b) for a, b in want if a == rep[a] and b == rep[b]} - got
        assert len(missed) <= 0.01 * len(want)


def test_pairs_and_groups_keep_every_link(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8), (9, 9)], "id long, rep long")
    links = spark.createDataFrame([(1, 5, 0.7), (5, 8, 0.6)], "a long, b long, similarity double")
    places = spark.createDataFrame([(1, "f"), (2, "g"), (3, "f"), (5, "f"), (6, "h"), (8, "h"), (9, "h")], "id long, place string")
    pairs = {tuple(r) for r in neardup.pairs_between(classes, links, places, "x", "y").collect()}
    assert {(1, 2), (2, 3), (5, 6), (1, 6), (2, 5), (3, 6), (5, 8)} <= pairs
    assert not pairs & {(1, 3), (1, 5), (3, 5), (6, 8)}
    got = {r.id: (r.group, r.n_links) for r in neardup.groups(classes, links).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 5: (1, 2), 6: (1, 2), 8: (1, 1), 9: (9, 0)}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    gram = np.unique(rng.integers(0, 2**63, 150)).astype(np.uint64)
    weight = rng.uniform(1, 2, len(gram))
    a, b = np.arange(len(gram)) < 100, np.arange(len(gram)) >= 40
    doc = np.repeat([0, 1], [a.sum(), b.sum()])
    _, s = neardup.draw(doc, np.r_[gram[a], gram[b]], np.r_[weight[a], weight[b]], 2000)
    true = weight[a & b].sum() / weight[a | b].sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_empty(spark):
    classes, links = neardup.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text", 0.8)
    assert classes.count() == 0 and links.count() == 0
