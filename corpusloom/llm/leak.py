"""Problem 8: find documents that contain passages of held-out test items.

A passage is any ``min_words`` consecutive words of an item. Up to ``max_errors``
words of it may be changed, dropped or added. The words of every item are cut into
aligned pieces short enough that each passage holds ``max_errors + 1`` whole ones;
with at most that many edits one piece stays intact (pigeonhole). All pieces are
sought at once in the words of each document, and every hit is verified by Myers'
bit-parallel edit distance over words, literal passages (distance 0) included.

Words are longest runs of letters, digits and underscores, lower-cased, so case,
punctuation and layout don't matter. Items of fewer words than a passage, null or
empty texts and null ids give no rows. A text under several ids is reported for
each of them. Rows repeated under one id count once. Documents are processed whole.
The items are written to the shared folder in blocks of about ``block_bytes`` of text,
and each task reads the block it seeks; the driver never holds an item. There is one
pass over the documents for each block, so the time grows with the blocks of items.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_shared

MIN_WORDS = 13
MAX_ERRORS = 1
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")


def word_list(text: str) -> list[str]:
    """Lower-cased words of a text."""
    return _WORD.findall(text.lower())


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """Edit distance of ``pattern`` to the best substring of ``text`` that ends at each word (Myers 1999)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for w in text:
        eq = masks.get(w, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(zero | plus) & full)
        down = plus & zero
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(zero | up) & full), up & zero
        out.append(score)
    return out


def _longest_run(doc: list[str], item: list[str], at: int, piece: int, size: int) -> tuple[int, int]:
    """Start in the item and length of the run of equal words around an exact piece hit."""
    left = 0
    while at - left > 0 and piece - left > 0 and doc[at - left - 1] == item[piece - left - 1]:
        left += 1
    right = size
    while at + right < len(doc) and piece + right < len(item) and doc[at + right] == item[piece + right]:
        right += 1
    return piece - left, left + right


def _windows(doc: list[str], item: list[str], at: int, piece: int, size: int, min_words: int) -> list[int]:
    """Starts of the item's passages that hold a piece, those first that agree most with the document around the hit."""
    start, run = _longest_run(doc, item, at, piece, size)
    firsts = range(max(0, piece + size - min_words), min(piece, len(item) - min_words) + 1)
    return sorted(firsts, key=lambda f: max(0, start - f) + max(0, f + min_words - start - run))


def _matcher(items: list[tuple], min_words: int, max_errors: int):
    """A function from the words of a document to {item index: (errors, words matched)}."""
    import ahocorasick

    size = (min_words + 1) // (max_errors + 2)
    words = [word_list(text) for _, text in items]
    places: dict[str, list[tuple[int, int]]] = {}
    for i, ws in enumerate(words):
        if len(ws) >= min_words:
            for p in range(0, len(ws) - size + 1, size):
                places.setdefault(" " + " ".join(ws[p : p + size]) + " ", []).append((i, p))
    machine = ahocorasick.Automaton()
    for piece in places:
        machine.add_word(piece, piece)
    if not places:
        return lambda doc: {}
    machine.make_automaton()

    def match(doc: list[str]) -> dict[int, tuple[int, int]]:
        found: dict[int, tuple[int, int]] = {}
        if len(doc) < min_words - max_errors:
            return found
        line = " " + " ".join(doc) + " "
        hits = [(end, piece) for end, piece in machine.iter(line)]
        tried = set()
        ends_at = list(accumulate((len(w) + 1 for w in doc), initial=0)) if hits else []  # of each word, its separator included
        for end, piece in hits:
            at = bisect_left(ends_at, end) - size  # index of the piece's first word
            for i, p in places[piece]:
                item = words[i]
                if (i, at - p) in tried and found.get(i, (1, 0))[0] == 0:
                    continue
                tried.add((i, at - p))
                for first in _windows(doc, item, at, p, size, min_words):
                    low = max(0, at - (p - first) - max_errors)
                    errors = min(myers(item[first : first + min_words], doc[low : at + min_words - (p - first) + max_errors]), default=min_words)
                    if errors > max_errors:
                        continue
                    run = max(min_words, _longest_run(doc, item, at, p, size)[1]) if errors == 0 else min_words
                    found[i] = min(found.get(i, (max_errors + 1, 0)), (errors, -run))
                    if errors == 0:
                        break
        return {i: (errors, -run) for i, (errors, run) in found.items()}

    return match


def _items(folder: str, block: int) -> list[tuple]:
    """(item_id, text) of one block of items in the shared folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    filesystem, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/block={block}"
    if filesystem.get_file_info(path).type == fs.FileType.NotFound:
        return []
    table = ds.dataset(path, filesystem=filesystem, format="parquet").to_table(columns=["item_id", "text"])
    return list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()))


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    min_words: int = MIN_WORDS, max_errors: int = MAX_ERRORS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, errors, run_words): every document with the items it contains a passage of.

    ``errors`` is the least edit distance found, 0 for a literal passage; ``run_words``
    is then the longest literal run found around a piece, else the passage length.
    """
    if max_errors < 0 or (min_words + 1) // (max_errors + 2) < 1:
        raise ValueError("the error budget leaves no whole piece in a passage")
    tests = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null").dropDuplicates()
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, errors int, run_words int"
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    folder = write_shared(tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), ["block"])
    out = None
    for b in range(blocks):

        def search(batches: Iterator[pd.DataFrame], block=b) -> Iterator[pd.DataFrame]:
            rows = _items(folder, block)
            match = _matcher(rows, min_words, max_errors)
            for pdf in batches:
                found = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    found += [(d, rows[i][0], errors, run) for i, (errors, run) in match(word_list(t)).items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "errors", "run_words"])

        part = docs.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("errors", (-F.col("run_words")).alias("run"))).alias("_b"))
    return best.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), F.col("_b.errors").alias("errors"), (-F.col("_b.run")).alias("run_words"))
