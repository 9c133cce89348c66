"""A versioned store of chunks, vectors and postings.

Every commit writes a new folder ``v=<n>`` and then moves the pointer file CURRENT to
it, so readers see whole versions only and a failed write changes nothing.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from .retrieval import Postings, build_postings

CHUNKS = "chunk_id string, file string, file_sha256 string, chunk_sha string, start_line long, end_line long, lang string, kind string, name string, content string, embedding array<float>"
FRESH, MATCH, SOFT, HARD = "Fresh", "Match", "SoftChanged", "HardChanged"


@dataclass(frozen=True)
class Marker:
    """Who wrote a store, and by what configuration."""

    project_id: str
    root: str
    project: str
    hard: str
    soft: str
    created_at: float = 0.0
    version: str = "0.1.0"

    @classmethod
    def of(cls, config: Config) -> Marker:
        return cls(config.project_id, config.root, config.project_fingerprint, config.hard_fingerprint, config.soft_fingerprint, time.time())


class MarkerError(RuntimeError):
    """The store belongs to another project or configuration."""


class Store:
    """Tables below ``path``; any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Replace a small file at once: written aside, then renamed over the old one."""
        new = self._path(f"{self.path}/.{name}.new")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()) if "://" in self.path else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(f"{self.path}/{name}")), options)

    @property
    def version(self) -> int:
        return int(self._read("CURRENT") or 0)

    def chunks(self) -> DataFrame:
        """The current chunks with their vectors; empty before the first commit."""
        v = self.version
        return self.spark.read.schema(CHUNKS).parquet(f"{self.path}/v={v}/chunks") if v else self.spark.createDataFrame([], CHUNKS)

    def postings(self) -> Postings:
        """The current postings."""
        v = self.version
        if not v:
            return build_postings(self.chunks())
        table = lambda name: self.spark.read.parquet(f"{self.path}/v={v}/{name}")
        return Postings(table("terms"), table("lengths"), table("stats"))

    def manifest(self) -> DataFrame:
        """(file, file_sha256) of the current version."""
        return self.chunks().select("file", "file_sha256").dropDuplicates(["file"])

    def commit(self, chunks: DataFrame) -> int:
        """K7: write a version and make it the current one; readers of older ones are not disturbed."""
        new = self.version + 1
        base = f"{self.path}/v={new}"
        # K8: rows in order of file and lines, so that parquet statistics find a file and its lines
        laid = chunks.select(*[f.split()[0] for f in CHUNKS.split(", ")]).repartition("file").sortWithinPartitions("file", "start_line")
        laid.write.mode("overwrite").parquet(f"{base}/chunks")
        written = self.spark.read.schema(CHUNKS).parquet(f"{base}/chunks")
        built = build_postings(written)
        built.terms.repartition("tok").sortWithinPartitions("tok").write.mode("overwrite").parquet(f"{base}/terms")
        built.lengths.write.mode("overwrite").parquet(f"{base}/lengths")
        built.stats.write.mode("overwrite").parquet(f"{base}/stats")
        self._write("CURRENT", str(new))
        return new

    def clear(self, confirm: bool = False) -> None:
        """K6: drop everything; asks for a plain yes in code."""
        if not confirm:
            raise ValueError("clear() needs confirm=True")
        self._fs.delete(self._path(self.path), True)

    def marker(self) -> Marker | None:
        text = self._read("MARKER")
        return Marker(**json.loads(text)) if text else None

    def write_marker(self, marker: Marker) -> None:
        """K9."""
        self._write("MARKER", json.dumps(asdict(marker)))

    def status(self, config: Config) -> str:
        """How the store's marker compares with a configuration; another project raises."""
        old, new = self.marker(), Marker.of(config)
        if old is None:
            return FRESH
        if old.project != new.project:
            raise MarkerError(f"the store belongs to project {old.project_id!r} at {old.root}")
        return HARD if old.hard != new.hard else SOFT if old.soft != new.soft else MATCH

    def check_readable(self, config: Config) -> str:
        """Readers bear soft changes, not hard ones."""
        status = self.status(config)
        if status == HARD:
            raise MarkerError("the configuration changed what the index is made of; run index")
        return status

    def prepare(self, config: Config) -> str:
        """What indexing does first: start afresh on a hard change, then leave its marker."""
        status = self.status(config)
        if status == HARD:
            self.clear(confirm=True)
        if status != MATCH:
            self._fs.mkdirs(self._path(self.path))
            self.write_marker(Marker.of(config))
        return status

    def counts(self) -> dict[str, int]:
        """A2."""
        row = self.chunks().agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"), F.count("embedding").alias("vectors")).first()
        return row.asDict()
