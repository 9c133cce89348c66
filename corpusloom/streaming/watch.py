"""Keep an index up to date from a stream of changed paths (ST1-ST8).

Events are JSON lines (path, ts) in a folder. Their kind doesn't matter: each batch is
reduced to distinct paths, and whether a path exists now decides what happens, so late,
repeated and reordered events do no harm and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators import changes
from ..sources.project import path_filter

EVENTS = "path string, ts timestamp"


def apply_batch(engine: Engine, events: DataFrame) -> dict[str, int]:
    """ST3, ST4, ST6, ST7: bring the paths of a batch, and what lay below vanished ones, to their present state."""
    c = engine.config
    spark = events.sparkSession
    rules = path_filter(c.root, c.languages, c.exclude, c.respect_gitignore)
    touched = events.select("path").filter("path is not null and path <> '' and path <> '.'").distinct()
    # the state of the present: one stat for each path, on the driver that sees the project
    state = [(r["path"], rules.check(r["path"])) for r in touched.toLocalIterator()]
    if not state:
        return {"new": 0, "changed": 0, "removed": 0, "unchanged": 0}
    seen = spark.createDataFrame(state, "path string, present boolean")
    present = engine.files().join(F.broadcast(seen.filter("present").select(F.col("path").alias("file"))), "file", "left_semi")
    gone = changes.vanished(engine.store.manifest(), seen.filter("not present").select("path"))
    return engine.apply(present, gone)


def watch(engine: Engine, events: str, checkpoint: str, once: bool = False) -> StreamingQuery | None:
    """ST1: a full sync, then micro-batches of events; ``once`` works off what is there and stops.

    Returns None where the configuration turns the watcher off.
    """
    if not engine.config.watcher_enabled:
        return None
    engine.index()
    stream = engine.spark.readStream.schema(EVENTS).json(events)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_batch(engine, batch))
    trigger = {"availableNow": True} if once else {"processingTime": f"{engine.config.debounce_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """ST2: (path, first, last, n) of bursts of a path's events, by event time with a watermark."""
    sessions = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("path", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")
