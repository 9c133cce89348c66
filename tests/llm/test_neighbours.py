import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import neighbours

SCHEMA = "i long, e array<float>"


def brute(rows, k, least=-2.0, dim=8):
    vecs = {}
    for i, e in rows:
        if i is None or e is None or len(e) != dim or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, dtype=np.float32).astype(float)
        vecs[i] = min(vecs.get(i, tuple(v)), tuple(v))
    ids = sorted(vecs)
    x = np.array([np.array(vecs[i]) / np.linalg.norm(vecs[i]) for i in ids])
    s = x @ x.T
    out = {}
    for a, i in enumerate(ids):
        best = sorted((-round(s[a, b], 9), j) for b, j in enumerate(ids) if j != i and s[a, b] >= least)[:k]
        out[i] = [j for _, j in best]
    return out


def data(n=400, dim=8):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dim))
    x[100:140] = x[0] + 0.05 * rng.normal(size=(40, dim))
    x[200:230] = x[1]  # equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    bad = [(1000, None), (1001, [0.0] * dim), (1002, [1.0] * (dim - 1)), (1003, [float("nan")] * dim), (1004, [1.0] * (dim - 1) + [None]), (1005, [float("inf")] + [1.0] * (dim - 1)), (None, rows[0][1]), (1006, [])]
    return rows + rows[:9] + bad


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item, r.place)):
        out.setdefault(r.item, []).append(r.other)
    return out


def test_equal_to_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit("clash"))
    want = brute(rows, 5)
    assert lists(neighbours.most_similar(df, "i", "e", 5, 8, block=150)) == want
    asked = df.filter("i % 50 = 0").select("i")
    assert lists(neighbours.most_similar(df, "i", "e", 5, 8, block=150, queries=asked)) == {i: v for i, v in want.items() if i % 50 == 0}
    least = {i: v for i, v in brute(rows, 3, 0.8).items() if v}
    assert lists(neighbours.most_similar(df, "i", "e", 3, 8, 0.8, block=64 * 3)) == least
    assert neighbours.most_similar(df.limit(0), "i", "e", 5, 8).count() == 0


def test_a_query_does_not_take_a_place_of_its_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lists(neighbours.most_similar(df, "i", "e", 5, 64, block=100, queries=df.filter("i % 3 = 0").select("i")))
    want = brute(rows, 5, dim=64)
    assert got == {i: v for i, v in want.items() if i % 3 == 0}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = neighbours.quantise(x)
    approx = (q.astype(float) * s[:, None]) @ (q.astype(float) * s[:, None]).T
    bound = e[:, None] + e[None, :] * (1 + 2 * e[:, None])
    assert (np.abs(approx - x @ x.T) <= bound + 1e-6).all()
