import random

from corpusloom.llm import repeat


def brute(text, run=5):
    w = repeat._WORD.findall((text or "").lower())
    seen, bad = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            bad.update(range(i, i + run))
        seen.add(g)
    return len(bad) / len(w) if w else 0.0


def texts(n):
    rng = random.Random(4)
    out = []
    for _ in range(n):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.3 and w:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 30)] * rng.randint(1, 3)
        out.append(" ".join(w))
    return out


def test_shares_equal_brute_force():
    rows = [None, "", "One two", "é " * 9, *texts(150)]
    got = repeat.exact_shares(rows)["repeated_share"]
    assert [round(x, 9) for x in got] == [round(brute(t), 9) for t in rows]


def test_every_repetitive_row_is_a_suspect(spark):
    rows = [(i, t) for i, t in enumerate([None, "", *texts(400)])] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score")
    got = repeat.repetition(df, sample=100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.suspect and r.repeated_share >= 0.3} == {i for i, t in rows if brute(t) >= 0.3}
    assert repeat.repetition(df.limit(0)).count() == 0


def test_forest_isolates_outliers():
    import numpy as np

    x = np.vstack([np.random.default_rng(0).normal(0, 0.01, (500, 3)), [[1, 1, 1]]])
    score = repeat.anomaly(repeat.grow_forest(x), x)
    assert score[-1] > score[:-1].max()


def test_held_out_recall_of_the_calibrated_forest():
    import numpy as np

    rows = texts(3000)
    x, share = repeat.measure(rows)[repeat.STATISTICS].to_numpy(), repeat.exact_shares(rows)["repeated_share"].to_numpy()
    wanted = share >= 0.3
    forest = repeat.grow_forest(x[:1000])
    threshold = repeat.calibrated(repeat.anomaly(forest, x[:1000]), wanted[:1000])
    suspect = repeat.anomaly(forest, x[1000:]) >= threshold
    assert suspect[wanted[1000:]].mean() >= 0.99
    assert repeat.calibrated(np.array([0.4, 0.9]), np.array([False, False])) == -1.0
    assert 0.6 < repeat.calibrated(np.array([0.4, 0.4, 0.9]), np.array([False, False, True])) < 0.7


def test_share_of_suspects_only_and_of_all(spark):
    rows = [(i, "ab cd ef gh ij kl mn op " * (1 + 3 * (i % 20 == 0)) + f"w{i} v{i} u{i}") for i in range(400)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in repeat.repetition(df, sample=200).collect()}
    assert all(r.suspect and r.repeated_share > 0.6 for i, r in got.items() if i < 400 and i % 20 == 0)
    assert sum(not r.suspect for r in got.values()) > 300 and all(r.repeated_share is None for r in got.values() if not r.suspect)
    every = {r.doc_id: r.repeated_share for r in repeat.repeated_shares(df).collect()}
    assert every == {i: brute(t) for i, t in rows}
