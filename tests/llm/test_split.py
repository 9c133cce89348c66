import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import split

SCHEMA = "item string, text string, first_line long, max_lines int, max_bytes int, overlap int"


def random_text(rng, n):
    words = ["alpha", "β", "gamma.", "δέλτα!", "}", "  if x:", "", "\t", "é" * 30, "x" * rng.randint(1, 90)]
    return "".join(rng.choice(words) + rng.choice([" ", "\n", "\n", "\n\n", ". "]) for _ in range(n))


def verify(text, pieces, max_lines, max_bytes, overlap, first_line=1):
    data = text.encode()
    pieces = sorted(pieces, key=lambda r: r.piece_no)
    assert pieces[0].start_byte == 0
    covered = 0
    for k, p in enumerate(pieces):
        assert data[p.start_byte : p.end_byte].decode() == p.text  # code points stay whole
        assert len(p.text.encode()) <= max_bytes
        assert p.end_line - p.start_line + 1 <= max_lines
        assert p.start_line == first_line + data[: p.start_byte].count(b"\n")
        assert p.start_byte <= covered and p.end_byte >= covered - 1
        assert k == 0 or p.start_line >= pieces[k - 1].end_line - overlap
        covered = max(covered, p.end_byte + (data[p.end_byte : p.end_byte + 1] == b"\n"))
    assert covered == len(data)


def test_limits_cover_and_overlap_hold_on_random_texts(spark):
    rng = random.Random(5)
    rows = [(str(i), random_text(rng, rng.randint(1, 200)), 1, rng.choice([3, 10]), rng.choice([40, 90, 400]), rng.choice([0, 1, 2])) for i in range(60)]
    out = {}
    for r in split.split_texts(spark.createDataFrame(rows, SCHEMA), 300).collect():
        out.setdefault(r.item, []).append(r)
    for item, text, _, max_lines, max_bytes, overlap in rows:
        over = len(text.encode()) > max_bytes or len(text.removesuffix("\n").split("\n")) > max_lines
        assert (item in out) == over
        if over:
            verify(text, out[item], max_lines, max_bytes, overlap)


def test_overlap_repeats_the_last_lines(spark):
    text = "\n".join(f"line {i:03}" for i in range(100))
    rows = sorted(split.split_texts(spark.createDataFrame([("a", text, 11, 10, 10_000, 3)], SCHEMA)).collect(), key=lambda r: r.piece_no)
    for a, b in zip(rows, rows[1:]):
        assert b.start_line == a.end_line - 2
        assert b.text.split("\n")[:3] == a.text.split("\n")[-3:]
    assert rows[0].start_line == 11 and rows[-1].end_line == 110


def test_nulls_empty_repeats_one_giant_line(spark):
    giant = "é" * 5000
    rows = [("n", None, 1, 1, 10, 0), ("e", "", 1, 1, 10, 0), ("g", giant, None, 5, 101, 0), ("g", giant, None, 5, 101, 0), (None, None, None, None, None, None)]
    out = split.split_texts(spark.createDataFrame(rows, SCHEMA), 64).collect()
    assert {r.item for r in out} == {"g"}
    assert "".join(r.text for r in sorted(out, key=lambda r: r.piece_no)) == giant
    assert all(r.start_line == r.end_line == 1 for r in out)
    assert split.split_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files_by_offset_equal_texts_in_rows(spark, tmp_path):
    rng = random.Random(9)
    text = random_text(rng, 4000)
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    small = tmp_path / "small.txt"
    small.write_bytes(b"x\n")
    uri = f"file://{path}"
    files = split.split_files(spark, [uri, f"file://{small}"], 20, 500, 2, 1024)
    texts = split.split_texts(spark.createDataFrame([(uri, text, 1, 20, 500, 2)], SCHEMA), 1024)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, texts.select(files.columns).collect()))
    verify(text, texts.collect(), 20, 500, 2)


def test_chunk_rows_take_limits_of_their_language_and_ignore_other_columns(spark):
    chunks = spark.createDataFrame(
        [("a", "x.py", None, 1, "\n".join("ab")), ("b", "x.zz", "Rust", 1, "\n".join("abc")), ("c", "x.zz", None, 1, "\n".join("abcd")), ("d", None, None, 5, None)],
        "chunk_id string, file string, lang string, start_line long, text string",
    ).withColumn("max_lines", F.lit("clash"))
    limits = spark.createDataFrame([("python", 1, 0, 100), ("rust", 3, 0, 100), ("default", 2, 1, 100)], "lang string, max_chunk_lines int, overlap_lines int, max_chunk_chars int")
    assert {r.chunk_id for r in split.split_chunks(chunks, limits).collect()} == {"a", "c"}


def test_bad_range(spark):
    with pytest.raises(ValueError):
        split.split_texts(spark.createDataFrame([], SCHEMA), 0)
