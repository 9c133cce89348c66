"""Problem 9: mix sources to target weights.

Sizes are tokens of a public tokenizer whose rank file is a parameter. The sources
with a target are the leaves of a tree domain > language > source; a source's weight
is split over its languages by their tokens. Budgets run down the tree: every node
fills its children by weight, none beyond its capacity (tokens times the allowed
repeats), so a shortage is taken by siblings first and by an ancestor's other
children only when all siblings are full. Each leaf then takes whole epochs of its
documents and, of one further epoch in seeded order, the prefix that fits.

``total`` is the wanted size; by default it is the largest at which no source hits its
cap, so targets are met up to one document per leaf; with ``ALL_TOKENS`` it is what the
sources with a target hold, so that small ones repeat up to their caps and what they
cannot give is taken by others. Targets without documents and
documents without a target are left out; null sources have no target, null languages
form a language of their own. Null or empty texts have no tokens and are never used.
Repeated rows of one id count once. A document is used at most ``max_repeats`` times.
Prefix sums run over buckets of the seeded order, so no leaf meets in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern of the vocabulary's public release.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
MAX_LEAVES = 100_000
ALL_TOKENS = "all tokens"


def with_tokens(documents: DataFrame, text: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``documents`` with a column ``tokens`` in place of the text."""
    rest = [f for f in documents.schema.fields if f.name != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf.drop(columns=[text]).assign(tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", tokens long"
    return documents.mapInPandas(count, schema)


def fill(budget: float, weights: list[float], capacities: list[float]) -> list[float]:
    """Split a budget by weight, none beyond its capacity; what one can't take goes to the others."""
    out = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if out[i] + left * weights[i] / total >= capacities[i]]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            return out
        for i in full:
            left -= capacities[i] - out[i]
            out[i] = capacities[i]
        open_ = [i for i in open_ if i not in full]
        # the others keep what they have; the rest is shared out anew
    return out


def budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """Budget of every leaf path, from its weight and capacity."""
    if not leaves:
        return {}
    if all(len(path) == 0 for path in leaves):
        return {(): min(total, leaves[()][1])}
    children: dict = {}
    for path, leaf in leaves.items():
        children.setdefault(path[0], {})[path[1:]] = leaf
    names = list(children)
    shares = fill(total, [sum(w for w, _ in children[c].values()) for c in names], [sum(cap for _, cap in children[c].values()) for c in names])
    return {(c, *path): b for c, share in zip(names, shares) for path, b in budgets(children[c], share).items()}


def mix(documents: DataFrame, targets: DataFrame, total: int | str | None = None, seed: int = 0, tokenizer: str = TOKENIZER, domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): ``mixture`` has (doc_id, source, lang, tokens, repeats) of every document used;
    ``shares`` has (source, target_share, tokens, share) of every target, 0 where it has no documents."""
    goal = targets.filter("source is not null and target_share > 0").dropDuplicates(["source"]).limit(MAX_LEAVES + 1).collect()
    if len(goal) > MAX_LEAVES:
        raise ValueError("more targets than the budget tree may have leaves")
    spark = documents.sparkSession
    goal_df = spark.createDataFrame([(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in goal], "source string, target_share double, max_repeats int")
    kind = F.lit("all") if domain is None else F.coalesce(F.col(domain).cast("string"), F.lit(""))
    wanted = documents.select("doc_id", kind.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), "source", "text").join(F.broadcast(goal_df.select("source")), "source", "left_semi")
    sized = with_tokens(wanted.filter("doc_id is not null"), "text", tokenizer).filter("tokens > 0").dropDuplicates(["doc_id"])
    sized = cut_lineage(sized)
    sums = sized.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("t")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError("more leaves than a budget tree may have")
    of_source: dict[str, float] = {}
    for r in sums:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["t"]
    aim = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in goal}
    present = sum(aim[s][0] for s in of_source) or 1.0
    size = sum(of_source.values()) if total == ALL_TOKENS else total if total is not None else min((of_source[s] * aim[s][1] * present / aim[s][0] for s in of_source), default=0)
    leaves = {(r["domain"], r["lang"], r["source"]): (aim[r["source"]][0] * r["t"] / of_source[r["source"]], float(r["t"] * aim[r["source"]][1])) for r in sums}
    have = {(r["domain"], r["lang"], r["source"]): r["t"] for r in sums}
    plan = []
    for path, budget in budgets(leaves, size).items():
        epochs = min(int((budget + 1e-6) // have[path]), aim[path[2]][1])
        plan.append((*path, epochs, float(budget - epochs * have[path]) + 1e-6 if epochs < aim[path[2]][1] else 0.0))
    plan_df = spark.createDataFrame(plan, "domain string, lang string, source string, epochs int, rest double")
    leaf = ["domain", "lang", "source"]
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    rows = sized.join(F.broadcast(plan_df), leaf).withColumn("_o", order).withColumn("_b", F.pmod(F.shiftright("_o", 16), F.lit(BUCKETS)))
    by_bucket = Window.partitionBy(*leaf).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*leaf, "_b").agg(F.sum("tokens").alias("_t")).select(*leaf, "_b", F.coalesce(F.sum("_t").over(by_bucket), F.lit(0)).alias("_before"), "_t")
    rows = rows.join(before, [*leaf, "_b"])
    inside = Window.partitionBy(*leaf, "_b").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # only the bucket in which the prefix ends needs an order of its own
    ends = (F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_t") > F.col("rest"))
    edge = rows.filter(ends).withColumn("_in", F.col("_before") + F.sum("tokens").over(inside) <= F.col("rest"))
    clear = rows.filter(~ends).withColumn("_in", F.col("_before") + F.col("_t") <= F.col("rest"))
    used = edge.unionByName(clear).select("doc_id", "source", "lang", "tokens", (F.col("epochs") + F.col("_in").cast("int")).alias("repeats")).filter("repeats > 0")
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    shares = F.broadcast(goal_df).join(reached, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = shares.agg(F.sum("tokens").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)
    return used, shares.join(F.broadcast(whole), F.lit(True)).select("source", "target_share", "tokens", share.alias("share"))
