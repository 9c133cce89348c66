import random
from statistics import NormalDist

from corpusloom.llm import rank

SCHEMA = "g long, k long, a double, b float, n string"


def brute(rows, weights):
    groups = {}
    for g, k, *scores in rows:
        if g is None or k is None:
            continue
        best = groups.setdefault(g, {}).setdefault(k, [None, None])
        for i, v in enumerate(scores):
            if v is not None and v == v and (best[i] is None or v > best[i]):
                best[i] = v
    out = {}
    for g, items in groups.items():
        n, z, total = len(items), {k: 0.0 for k in items}, 0.0
        for i, w in enumerate(weights):
            have = [v[i] for v in items.values() if v[i] is not None]
            if not have:
                continue
            total += w
            vals = {k: min(have) if v[i] is None else v[i] for k, v in items.items()}
            for k, v in vals.items():
                below, ties = sum(x < v for x in vals.values()), sum(x == v for x in vals.values())
                z[k] += w * NormalDist().inv_cdf((below + (ties + 1) / 2 - 0.5) / n)
        for k in items:
            out[g, k] = (n, round(z[k] / total, 6) if total else 0.0)
    return out


def test_both_ways_equal_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    val = lambda: rng.choice([None, float("nan"), float(rng.randint(0, 5)), float(rng.randint(0, 99) / 4)])
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), val(), val()) for _ in range(150)]
    rows += [(9, 1, None, None), (9, 2, None, None), (8, 5, 1.5, None)] + rows[:20]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for hot in (10**6, 1):
        got = rank.fuse(df, "g", "k", ["a", "b"], [2.0, 1.0], hot).collect()
        assert {(r.g, r.k): (r.n, round(r.fused, 6)) for r in got} == brute(rows, [2.0, 1.0])
        for g in {r.g for r in got}:
            order = sorted((r for r in got if r.g == g), key=lambda r: r.place)
            assert [r.place for r in order] == list(range(1, len(order) + 1))
            assert all((-round(a.fused, 9), a.k) <= (-round(b.fused, 9), b.k) for a, b in zip(order, order[1:]))


def test_empty(spark):
    assert rank.fuse(spark.createDataFrame([], SCHEMA), "g", "k", ["a"]).count() == 0
