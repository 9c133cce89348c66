"""Problem 10: repetition inside single documents.

Each document gets cheap rule statistics: the share of words in runs of ``SHORT`` words
that start earlier in the document as well, the shares of repeated lines and sentences,
the most frequent short run's share and how few of the words are distinct. An isolation
forest over these statistics scores how soon random splits isolate a document.

The forest is fitted on at most ``sample`` documents. The same rows are labelled by
their exact repeated share, and the threshold is set midway between the median score of
the rows labelled below the wanted share and the least score of the others, so that a
wanted row has to score far below every labelled one to be lost. Only documents at or
above the threshold are suspects; their exact share, of words that lie in a run of
``run`` consecutive words that also starts earlier, is then computed. Of the others it
is not (null). ``repeated_shares`` measures all documents instead.

Null texts have no words and share 0, as have empty ones and those of fewer words
than a run. Rows repeated under one id come out as often as they came in. Texts are
measured whole. Where no row of the sample has the wanted share there is nothing to
calibrate on, and every row is a suspect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 5
SHORT = 3
SAMPLE = 4096
TREES, LEAF_SAMPLE = 64, 256
STATISTICS = ["short_share", "line_share", "sentence_share", "top_share", "common_share"]
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?]\s+|\n+")
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _repeats(parts: list[str]) -> float:
    """Share of the characters of ``parts`` that lie in parts seen before."""
    seen, total, again = set(), 0, 0
    for p in parts:
        p = p.strip()
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, the text of each, and the number of words of each text."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    hashes = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum())).view(np.uint64)
    return hashes, np.repeat(np.arange(len(texts)), sizes), sizes


def _runs(hashes: np.ndarray, doc: np.ndarray, sizes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the share of words in repeated runs and the share of its most frequent run."""
    n, total = len(sizes), len(hashes)
    share, top = np.zeros(n), np.zeros(n)
    if total >= run:
        gram = np.zeros(total - run + 1, dtype=np.uint64)
        for k in range(run):
            gram = _mixed(gram * _M + hashes[k : total - run + 1 + k])
        starts = np.flatnonzero(doc[: total - run + 1] == doc[run - 1 :])
        if len(starts):
            keys = gram[starts] + doc[starts].astype(np.uint64) * _M
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            again = np.ones(len(starts), dtype=bool)
            again[first] = False
            edge = np.zeros(total + 1, dtype=np.int64)
            np.add.at(edge, starts[again], 1)
            np.add.at(edge, starts[again] + run, -1)
            covered = np.cumsum(edge[:-1]) > 0
            share = np.bincount(doc, weights=covered, minlength=n) / np.maximum(sizes, 1)
            np.maximum.at(top, doc[starts[first]], (counts - 1) * run / sizes[doc[starts[first]]])
    return share, np.minimum(top, 1)


def exact_shares(texts: list[str | None], run: int = RUN) -> pd.DataFrame:
    """n_words and repeated_share of each text."""
    hashes, doc, sizes = _hashed(texts)
    return pd.DataFrame({"n_words": sizes, "repeated_share": _runs(hashes, doc, sizes, run)[0]})


def measure(texts: list[str | None]) -> pd.DataFrame:
    """n_words and the rule statistics of each text."""
    hashes, doc, sizes = _hashed(texts)
    share, top = _runs(hashes, doc, sizes, SHORT)
    common = np.zeros(len(sizes))
    if len(hashes):
        first = np.unique(_mixed(hashes) + doc.astype(np.uint64) * _M, return_index=True)[1]
        common = 1 - np.bincount(doc[first], minlength=len(sizes)) / np.maximum(sizes, 1)
    lines = [_repeats(t.split("\n")) if t else 0.0 for t in texts]
    sentences = [_repeats(_SENTENCE.split(t)) if t else 0.0 for t in texts]
    return pd.DataFrame({"n_words": sizes, "short_share": share, "line_share": lines, "sentence_share": sentences, "top_share": top, "common_share": common})


def _slices(texts: list[str | None], chars: int = 1 << 22) -> Iterator[slice]:
    """Consecutive slices of at most about ``chars`` characters, however long the texts are."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(x: np.ndarray, trees: int = TREES, leaf_sample: int = LEAF_SAMPLE, seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays (feature or -1, split, left child, right child, path length at a leaf)."""
    rng = np.random.default_rng(seed)
    size = min(leaf_sample, len(x))
    limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
    forest = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + path_constant(len(rows))])
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth < limit and len(rows) > 1 and len(open_features):
                f = int(rng.choice(open_features))
                split = rng.uniform(low[f], high[f])
                left = rows[:, f] <= split
                nodes[at][:2] = [f, split]
                nodes[at][2] = grow(rows[left], depth + 1)
                nodes[at][3] = grow(rows[~left], depth + 1)
            return at

        grow(x[rng.choice(len(x), size, replace=False)], 0)
        a = np.array(nodes)
        forest.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return forest


def anomaly(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, leaf_sample: int = LEAF_SAMPLE) -> np.ndarray:
    """Scores in (0, 1), the higher the sooner a row is isolated."""
    total = np.zeros(len(x))
    for feature, split, left, right, length in forest:
        at = np.zeros(len(x), dtype=int)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            node = at[inner]
            goes = x[inner, f[inner]] <= split[node]
            at[inner] = np.where(goes, left[node], right[node])
        total += length[at]
    return 2.0 ** (-total / len(forest) / max(path_constant(leaf_sample), 1e-9))


def calibrated(scores: np.ndarray, wanted: np.ndarray) -> float:
    """Threshold from labelled rows: midway between the median of the others and the least wanted score."""
    if not wanted.any():
        return -1.0
    least = float(scores[wanted].min())
    others = float(np.median(scores[~wanted])) if not wanted.all() else 0.0
    return least - max(0.0, (least - others) / 2) - 1e-9


def _columns(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def repeated_shares(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, n_words, repeated_share) of every row of ``documents``."""
    docs = _columns(documents, doc_id, text)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in _slices(texts):
                yield exact_shares(texts[part], run).assign(doc_id=pdf["doc_id"].iloc[part].to_numpy())[["doc_id", "n_words", "repeated_share"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(exact, f"doc_id {kind}, n_words long, repeated_share double").withColumnRenamed("doc_id", doc_id)


def repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.3, run: int = RUN, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, the statistics, score, suspect, repeated_share) of every row of ``documents``;
    ``repeated_share`` is null where the forest sees no suspect."""
    docs = _columns(documents, doc_id, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = F.xxhash64("doc_id")
    # twice the sample by a bound on the hash, then exactly its least hashes: few rows meet in one task
    reach = min(1.0, 2 * sample / max(1, docs.count()))
    fitted = docs.filter(F.pmod(mark, F.lit(1 << 30)) < int(reach * (1 << 30))).dropDuplicates(["doc_id"]).orderBy(mark, "doc_id").limit(sample)
    schema = f"doc_id {kind}, n_words long, " + ", ".join(f"{s} double" for s in STATISTICS)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in _slices(texts):
                rows = measure(texts[part]).assign(doc_id=pdf["doc_id"].iloc[part].to_numpy(), label=exact_shares(texts[part], run)["repeated_share"])
                yield rows[["doc_id", "n_words", *STATISTICS, "label"]]

    rows = fitted.mapInPandas(label, schema + ", label double").orderBy("doc_id").toPandas()  # at most ``sample`` rows of numbers
    x = rows[STATISTICS].to_numpy(dtype=float)
    forest, threshold, size = [], -1.0, min(LEAF_SAMPLE, len(x))
    if len(x):
        forest = grow_forest(x)
        threshold = calibrated(anomaly(forest, x, size), rows["label"].to_numpy() >= share - 1e-12)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"]
            for part in _slices(texts):
                some = texts[part]
                rows = measure(some).assign(doc_id=ids.iloc[part].to_numpy())[["doc_id", "n_words", *STATISTICS]]
                score = anomaly(forest, rows[STATISTICS].to_numpy(dtype=float), size) if forest else np.ones(len(rows))
                suspect = score >= threshold
                exact = np.full(len(rows), np.nan)
                at = np.flatnonzero(suspect)
                if len(at):
                    exact[at] = exact_shares([some[i] for i in at], run)["repeated_share"]
                yield rows.assign(score=score, suspect=suspect, repeated_share=exact)

    out = docs.mapInPandas(judge, schema + ", score double, suspect boolean, repeated_share double")
    return out.withColumn("repeated_share", F.nanvl("repeated_share", F.lit(None).cast("double"))).withColumnRenamed("doc_id", doc_id)
