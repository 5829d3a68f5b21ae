"""Streams: file events, incremental indexing, sync, debounced sessions and rate windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import tree

# Folders whose events are ignored, and extensions that are watched.
IGNORED = ["node_modules", ".git", ".lodestone", "dist", "build", ".next", ".cache", "coverage", "__pycache__", ".pytest_cache"]
WATCHED = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "kt", "swift", "c", "cpp", "h", "hpp", "cs", "rb", "php", "vue", "svelte"]
EVENT = "type string, path string, timestamp bigint"
# Requests an hour and a day by tier.
RATE_LIMITS = {"free": (1000, 5000), "solo": (5000, 25000), "team": (25000, 100000)}


def watched(path: Column) -> Column:
    folders = "|".join(x.replace(".", r"\.") for x in IGNORED)
    return path.rlike(rf"\.({'|'.join(WATCHED)})$") & ~path.rlike(rf"(^|/)({folders})(/|$)")


def last_events(events: DataFrame) -> DataFrame:
    """(path, type) of the last event of each watched path."""
    return events.where(watched(F.col("path"))).groupBy("path").agg(F.max_by("type", F.struct("timestamp", "type")).alias("type"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """File events that a collector writes as JSON lines."""
    return spark.readStream.schema(EVENT).json(folder)


def tree_events(spark: SparkSession, root: str, existing: bool = False) -> DataFrame:
    """File events of a source tree, found by listing it for each batch; nothing else has to write them."""
    return tree.changes(spark, root, IGNORED, WATCHED, existing)


def watch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Hand the last event of each path to ``handle`` once for each batch; the trigger is the debounce."""

    def batch(rows: DataFrame, number: int) -> None:
        handle(last_events(rows), number)

    out = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def files_stream(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of new or changed sync files with the file that each came from."""
    lines = spark.readStream.option("pathGlobFilter", pattern).text(folder)
    return lines.select("value", F.col("_metadata.file_name").alias("file")).where(~F.col("file").startswith("."))


def debounced(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions that end ``gap`` after their last event: what a trailing timer would fire."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(*keys, F.session_window(time, gap)).agg(F.count("*").alias("events"))
    return found.select(*keys, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("fires_at"), "events")


def rate_windows(events: DataFrame, time: str, key: str, window: str, limit: int, late: str | None = None) -> DataFrame:
    """(key, window_start, requests, remaining, reset_at) of tumbling windows, such as "1 hour"."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(key, F.window(time, window)).agg(F.count("*").alias("requests"))
    return found.select(key, F.col("window.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.lit(limit) - F.col("requests")).alias("remaining"), F.col("window.end").alias("reset_at"))
