"""A project tree as a table (S1, S6, S13): a Python data source whose partitions read files on executors.

Spark's own file listing hides names that begin with an underscore, ``__init__.py`` for
one, so the tree is walked on the driver and read by path. Hidden entries are skipped,
by the walk and by the single-path check alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .policy import BINARY, MAX_BYTES, IgnoreRules, extension, extensions_for_language, language_from_ext, text_of

SCHEMA = "file string, size long, mtime double, content binary"
PER_PARTITION = 256


@dataclass(frozen=True)
class PathFilter:
    """Whether one path belongs to the index."""

    root: str
    languages: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore: IgnoreRules = field(default_factory=lambda: IgnoreRules({}))

    def admits(self, path: str, size: int) -> bool:
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[1] if "." in name[1:] else ""
        if any(part.startswith(".") for part in path.split("/")):
            return False
        if self.languages:
            if ext not in {e for x in self.languages for e in extensions_for_language(x)}:
                return False
        elif ext.lower() in BINARY or size > MAX_BYTES:
            return False
        return not self.ignore.ignores(path) and not IgnoreRules({"": "\n".join(self.exclude)}).ignores(path)

    def check(self, path: str) -> bool:
        """Whether the path exists now, is a regular file and belongs."""
        full = Path(self.root, path)
        return full.is_file() and not full.is_symlink() and self.admits(path, full.stat().st_size)


def path_filter(root: str, languages: list[str] | None = None, exclude: list[str] | None = None, respect_gitignore: bool = True) -> PathFilter:
    """The filter of a project, with the ignore files of every folder."""
    found: dict[str, str] = {}
    if respect_gitignore:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if not d.startswith(".")]
            for name in (".gitignore", ".ignore"):
                if name in names:
                    key = os.path.relpath(folder, root)
                    key = "" if key == "." else key.replace(os.sep, "/")
                    found[key] = found.get(key, "") + "\n" + Path(folder, name).read_text(errors="replace")
    return PathFilter(root, tuple(languages or ()), tuple(exclude or ()), IgnoreRules(found))


def walk(rules: PathFilter) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of every file that belongs; an unreadable folder raises."""

    def fail(error: OSError) -> None:
        raise error

    for folder, dirs, names in os.walk(rules.root, onerror=fail):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for name in sorted(names):
            full = os.path.join(folder, name)
            path = os.path.relpath(full, rules.root).replace(os.sep, "/")
            if os.path.isfile(full) and not os.path.islink(full):
                stat = os.stat(full)
                if rules.admits(path, stat.st_size):
                    yield path, stat.st_size, stat.st_mtime


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        split = lambda k: [x for x in options.get(k, "").split("\n") if x]
        self.rules = path_filter(options["path"], split("languages"), split("exclude"), options.get("gitignore", "true") == "true")

    def partitions(self) -> list[InputPartition]:
        files = list(walk(self.rules))
        return [_Part(files[k : k + PER_PARTITION]) for k in range(0, len(files), PER_PARTITION)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, size, mtime in partition.files:
            try:
                yield path, size, mtime, Path(self.rules.root, path).read_bytes()
            except OSError:  # gone or unreadable since the walk: one file never fails the scan
                continue


class ProjectSource(DataSource):
    """``spark.read.format("project").load(root)``; options languages, exclude (one a line) and gitignore."""

    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_project(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: list[str] | None = None, respect_gitignore: bool = True) -> DataFrame:
    """(file, lang, size, mtime, text, file_sha256) of a project's text files; binary contents are left out."""
    spark.dataSource.register(ProjectSource)
    raw = spark.read.format("project").option("languages", "\n".join(languages or [])).option("exclude", "\n".join(exclude or [])).option("gitignore", str(respect_gitignore).lower()).load(root)
    rows = raw.select("file", "size", "mtime", text_of(F.col("content")).alias("text")).filter("text is not null")
    return rows.select("file", language_from_ext(extension(F.col("file"))).alias("lang"), "size", "mtime", "text", F.sha2("text", 256).alias("file_sha256"))
