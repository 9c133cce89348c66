"""Problem 5: cut oversized items at natural boundaries, by byte ranges.

An item is a text column value or a file of any size. Its bytes are taken in
ranges of ``range_bytes``; each range is read with a halo behind its end, so that
both neighbours of an edge find the same cut there. A range yields a table of
*segments*: lines, and for lines over the byte limit parts of them, cut after a
sentence, else after white space, else between code points. The tables are
stitched by prefix sums of their line counts (one row per range, never one per
line), pieces are planned on the tables alone, and their text is then cut out by
byte offset. No step holds a whole file.

Results are defined as follows. An item within its limits gives no rows. An empty
or null text is within any limit. Pieces cover every byte; none is over the
limits; each repeats the last ``overlap`` lines of the piece before, or as many of
them as leave room for one new segment. Parts of an overlong line share its line
number. Cutting goes on afresh at each range edge, so the result depends on
``range_bytes`` but not on the cluster. Repeated rows of an item give its pieces once.
Columns besides those named are ignored. A non-positive limit raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.words import language_of, line_count

RANGE_BYTES = 1 << 20

_SENTENCE = re.compile(rb"[.!?;][ \t]+")
_SPACE = re.compile(rb"[ \t]+")


def _code_point(data: bytes, at: int) -> int:
    """The nearest offset not after ``at`` that doesn't split a code point."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def edge_cut(data: bytes) -> int:
    """Where the range that starts with ``data`` (a halo's worth of bytes) really begins."""
    newline = data.find(b"\n")
    if newline >= 0:
        return newline + 1
    space = _SPACE.search(data)
    if space and space.end() < len(data):
        return space.end()
    at = 0
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _line_parts(line: bytes, limit: int) -> Iterator[int]:
    """Lengths of the parts, each at most ``limit`` bytes, of a line over the limit."""
    at = 0
    while len(line) - at > limit:
        window = line[at : at + limit]
        for pattern in (_SENTENCE, _SPACE):
            ends = [m.end() for m in pattern.finditer(window)]
            if ends and ends[-1] > limit // 4:
                end = ends[-1]
                break
        else:
            end = _code_point(line, at + limit) - at
            if end <= 0:  # a limit below one code point
                end = limit
        yield end
        at += end
    if at < len(line):
        yield len(line) - at


def segments(data: bytes, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths of the segments of ``data``, the newlines in each (0 or 1), and how well a cut before each suits.

    A segment's newline is counted in its length but not against the limit.
    """
    lengths, newlines, scores = [], [], []
    blank_before = False
    for line in data.splitlines(keepends=True) if b"\r" not in data else re.findall(rb"[^\n]*\n|[^\n]+", data):
        ends = line.endswith(b"\n")
        body = line[:-1] if ends else line
        bare = body.lstrip(b" \t")
        indent = len(body) - len(bare)
        blank = not bare.strip()
        score = 8 if blank_before and not blank else 0
        score += max(0, 6 - indent // 2) if not blank else 0
        score -= 4 if bare[:1] in (b"}", b")", b"]") else 0
        blank_before = blank
        if len(body) <= limit:
            lengths.append(len(line))
            newlines.append(int(ends))
            scores.append(score)
            continue
        parts = list(_line_parts(body, limit))
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            lengths.append(part + (ends and last))
            newlines.append(int(ends and last))
            scores.append(score if k == 0 else -8)
    return lengths, newlines, scores


def plan_pieces(
    starts: list[int], ends: list[int], lines: list[int], scores: list[int], newlines: list[int],
    seeded: int, max_lines: int, max_bytes: int, overlap: int,
) -> list[tuple[int, int, int, int]]:
    """Pieces (start byte, end byte, first line, last line) of consecutive segments.

    The first ``seeded`` segments belong to the range before and may only be repeated.
    """
    n, out = len(starts), []
    new, before = seeded, 0
    while new < n:
        # repeat whole segments of the last lines of the piece before, if room is left for a new one
        start = new
        while start > before and lines[new - 1] - lines[start - 1] < overlap:
            start -= 1
        while start < new and (ends[new] - newlines[new] - starts[start] > max_bytes or lines[new] - lines[start] + 1 > max_lines):
            start += 1
        stop = new + 1
        while stop < n and ends[stop] - newlines[stop] - starts[start] <= max_bytes and lines[stop] - lines[start] + 1 <= max_lines:
            stop += 1
        if stop < n:  # cut where it suits best in the later half of the new segments
            low = new + max(1, (stop - new + 1) // 2)
            stop = max(range(low, stop + 1), key=lambda k: (scores[k], k))
        out.append((starts[start], ends[stop - 1] - newlines[stop - 1], lines[start], lines[stop - 1]))
        new, before = stop, start
    return out


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Range bytes with halo -> the range's segment table."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            data, halo = bytes(r.data), r.halo
            head = 0 if r.range_no == 0 else edge_cut(data[:halo])
            tail = len(data) if r.range_start + r.own >= r.total else r.own + edge_cut(data[r.own : r.own + halo])
            lengths, newlines, scores = segments(data[head:tail], r.max_bytes)
            rows.append((r.item, r.range_no, r.range_start + head, lengths, newlines, scores, sum(newlines), r.max_lines, r.max_bytes, r.overlap, r.first_line))
        yield pd.DataFrame(rows, columns=["item", "range_no", "range_from", "lengths", "newlines", "scores", "n_lines", "max_lines", "max_bytes", "overlap", "first_line"])


_TABLE = (
    "item string, range_no long, range_from long, lengths array<long>, newlines array<int>, scores array<int>, "
    "n_lines long, max_lines int, max_bytes int, overlap int, first_line long"
)


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stitched segment tables -> spans of pieces."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            seed_len = [] if r.seed_lengths is None else [int(x) for x in r.seed_lengths]
            seed_nl = [] if r.seed_newlines is None else [int(x) for x in r.seed_newlines]
            lengths, newlines = seed_len + [int(x) for x in r.lengths], seed_nl + [int(x) for x in r.newlines]
            scores = [0] * len(seed_len) + [int(x) for x in r.scores]
            at, line = int(r.range_from) - sum(seed_len), int(r.first_line) + int(r.lines_before) - sum(seed_nl)
            starts, ends, lines = [], [], []
            for size, newline in zip(lengths, newlines):
                starts.append(at)
                lines.append(line)
                at += size
                line += newline
                ends.append(at)
            spans = plan_pieces(starts, ends, lines, scores, newlines, len(seed_len), int(r.max_lines), int(r.max_bytes), min(int(r.overlap), int(r.max_lines) - 1))
            rows += [(r.item, r.range_no, k, *span) for k, span in enumerate(spans)]
        yield pd.DataFrame(rows, columns=["item", "range_no", "in_range", "start_byte", "end_byte", "start_line", "end_line"])


_SPAN = "item string, range_no long, in_range int, start_byte long, end_byte long, start_line long, end_line long"


def plan_spans(ranges: DataFrame) -> DataFrame:
    """Spans of the pieces of all items, from rows (item, range_no, range_start, own, total, halo, data, limits)."""
    tables = ranges.mapInPandas(_detect, _TABLE)
    order = Window.partitionBy("item").orderBy("range_no")
    keep = F.greatest(F.lit(1), F.col("overlap") * 2)
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - keep + 1), keep)
    stitched = tables.select(
        "*",
        F.coalesce(F.sum("n_lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"),
        F.lag(tail(F.col("lengths"))).over(order).alias("seed_lengths"),
        F.lag(tail(F.col("newlines"))).over(order).alias("seed_newlines"),
    )
    return stitched.mapInPandas(_plan, _SPAN)


def _numbered(spans: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy("range_no", "in_range")
    return spans.select("item", (F.row_number().over(order) - 1).alias("piece_no"), "start_byte", "end_byte", "start_line", "end_line")


def over_limits(text: Column, max_lines: Column, max_bytes: Column) -> Column:
    """Whether a text has more lines or more UTF-8 bytes than allowed."""
    return (F.octet_length(text) > max_bytes) | (line_count(text) > max_lines)


def with_limits(chunks: DataFrame, limits: DataFrame, lang: Column) -> DataFrame:
    """``chunks`` with max_lines, overlap and max_bytes of their language, or of the row ``default``.

    ``limits`` has a row per language; one million languages is the bound that is
    checked before it is sent to every task.
    """
    if limits.limit(1_000_001).count() > 1_000_000:
        raise ValueError("chunk limits: more rows than languages can have")
    rows = limits.select(F.lower("lang").alias("_lang"), F.col("max_chunk_lines").alias("_l"), F.col("overlap_lines").alias("_o"), F.col("max_chunk_chars").alias("_b"))
    own = rows.filter("_lang <> 'default'").dropDuplicates(["_lang"])
    default = rows.filter("_lang = 'default'").limit(1).select(F.col("_l").alias("_dl"), F.col("_o").alias("_do"), F.col("_b").alias("_db"))
    joined = chunks.withColumn("_key", lang).join(F.broadcast(own), F.col("_key") == F.col("_lang"), "left").join(F.broadcast(default), F.lit(True), "left")
    return joined.select(
        *chunks.columns,
        F.coalesce("_l", "_dl").alias("max_lines"),
        F.coalesce("_o", "_do", F.lit(0)).alias("overlap"),
        F.coalesce("_b", "_db").alias("max_bytes"),
    ).filter("max_lines is not null and max_bytes is not null")


def split_texts(items: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces (item, piece_no, start_byte, end_byte, start_line, end_line, text) of items over their limits.

    ``items`` has item string, text string, first_line long, max_lines, max_bytes and overlap.
    """
    if range_bytes < 1:
        raise ValueError("range_bytes must be positive")
    over = items.select("item", "text", F.coalesce("first_line", F.lit(1)).cast("long").alias("first_line"), "max_lines", "max_bytes", "overlap")
    over = over.filter(over_limits(F.col("text"), F.col("max_lines"), F.col("max_bytes"))).dropDuplicates(["item"])
    halo = F.least(F.lit(range_bytes), F.greatest(F.lit(4096), F.col("max_bytes")))
    size = F.octet_length("text").cast("long")
    ranges = over.select(
        "item", "first_line", "max_lines", "max_bytes", "overlap", F.col("text").cast("binary").alias("bytes"),
        size.alias("total"), halo.cast("long").alias("halo"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / range_bytes))).alias("range_no"),
    )
    start = F.col("range_no") * range_bytes
    ranges = ranges.select(
        "item", "first_line", "max_lines", "max_bytes", "overlap", "range_no", "total", "halo", start.alias("range_start"),
        F.least(F.lit(range_bytes), F.col("total") - start).alias("own"),
        F.substring(F.col("bytes"), (start + 1).cast("int"), (F.lit(range_bytes) + F.col("halo")).cast("int")).alias("data"),
    )
    spans = _numbered(plan_spans(ranges))
    text = over.select(F.col("item").alias("_item"), F.col("text").cast("binary").alias("_bytes"))
    cut = F.substring(F.col("_bytes"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return spans.join(text, F.col("item") == F.col("_item")).select(*spans.columns, F.decode(cut, "UTF-8").alias("text"))


def split_files(spark: SparkSession, paths: list[str], max_lines: int, max_bytes: int, overlap: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of files of any size: ranges are read by offset, and so is the text of each piece."""
    from pyarrow import fs

    if min(max_lines, max_bytes, range_bytes) < 1 or overlap < 0:
        raise ValueError("limits must be positive")
    halo = min(range_bytes, max(4096, max_bytes))

    def open_at(uri: str):
        filesystem, path = fs.FileSystem.from_uri(uri)
        return filesystem.open_input_file(path), filesystem.get_file_info(path).size

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(total=[open_at(p)[1] for p in pdf["item"]])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                with open_at(r.item)[0] as f:
                    f.seek(int(r.range_start))
                    data = f.read(range_bytes + halo)
                yield pd.DataFrame([(*r, data)], columns=[*pdf.columns, "data"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for r in pdf.itertuples(index=False):
                with open_at(r.item)[0] as f:
                    f.seek(int(r.start_byte))
                    texts.append(f.read(int(r.end_byte - r.start_byte)).decode("utf-8", "replace"))
            yield pdf.assign(text=texts)

    files = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "item string").repartition(max(1, min(len(paths), 1000)))
    sized = files.mapInPandas(sizes, "item string, total long").filter("total > 0")
    start = F.col("range_no") * range_bytes
    ranges = sized.select("item", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / range_bytes))).alias("range_no")).select(
        "item", "total", "range_no", start.alias("range_start"), F.least(F.lit(range_bytes), F.col("total") - start).alias("own"),
        F.lit(halo).cast("long").alias("halo"), F.lit(1).cast("long").alias("first_line"), F.lit(max_lines).alias("max_lines"), F.lit(max_bytes).alias("max_bytes"), F.lit(overlap).alias("overlap"),
    )
    ranges = ranges.repartition(F.col("item"), F.col("range_no"))
    data = ranges.mapInPandas(read, "item string, total long, range_no long, range_start long, own long, halo long, first_line long, max_lines int, max_bytes int, overlap int, data binary")
    spans = _numbered(plan_spans(data))
    over = spans.withColumn("_n", F.max("piece_no").over(Window.partitionBy("item"))).filter("_n > 0").drop("_n")
    return over.mapInPandas(emit, "item string, piece_no int, start_byte long, end_byte long, start_line long, end_line long, text string")


def split_chunks(chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of the rows of a chunk table that are over the limits of their language."""
    rows = with_limits(chunks.select("chunk_id", "file", "lang", "start_line", "text"), limits, language_of(F.col("lang"), F.col("file")))
    items = rows.select(F.col("chunk_id").alias("item"), "text", F.col("start_line").alias("first_line"), "max_lines", "max_bytes", "overlap")
    return split_texts(items, range_bytes).withColumnRenamed("item", "chunk_id")
