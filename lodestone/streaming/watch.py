"""Incremental maintenance from a stream of changes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import files, lake

QUIET = "300 milliseconds"


def changes(spark: SparkSession, root: str, own: tuple[str, ...] = ()) -> DataFrame:
    """(rel, path, ts, deleted) of edits and deletions, as a stream."""
    files.register(spark)
    return spark.readStream.format("file_tree").option("path", root).option("own", json.dumps(list(own))).option("changes", "true").load()


def sessions(log: DataFrame, gap: str = QUIET, path: str = "path", late: str | None = None) -> DataFrame:
    """Batches of a change log that end with a quiet gap: start, end, their distinct paths.

    One form for batch and stream; a stream needs `late`, its watermark's delay.  Sessions
    of parts are merged before the shuffle where Spark can, as the window is an aggregate."""
    if late:
        log = log.withWatermark("ts", late)
    by = log.groupBy(F.session_window("ts", gap).alias("w"))
    grouped = by.agg(F.count("*").alias("n_events"), F.sort_array(F.collect_set(path)).alias("paths"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", F.size("paths").alias("n_paths"), "paths")


def keyed_sessions(log: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """The same for each key on its own."""
    if late:
        log = log.withWatermark("ts", late)
    by = log.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def follow(spark: SparkSession, root: str, folder: str, checkpoint: str, interval: str = QUIET) -> StreamingQuery:
    """Keeps the snapshot in `folder` up to date: a batch brings the paths that changed or
    went since the last one, and only these are read again."""

    def apply(batch: DataFrame, _: int) -> None:
        paths = [r[0] for r in batch.select("rel").distinct().collect()]
        if not paths:
            return
        found = lake.load(spark, folder)
        if found is None:
            lake.build(spark, root, folder)
        else:
            lake.refresh(found, root, paths)

    return changes(spark, root, (folder,)).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
