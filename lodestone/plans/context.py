"""Task context: what someone who is about to change files should know."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import context_test_paths
from ..operators.search import recent

MAX_SYMBOLS = 20
RECENT_DAYS, RECENT_LIMIT = 7, 10


def task_context(paths: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, max_files: int = 20) -> DataFrame:
    """One row for each of the first files of ``paths`` (ord, path): indexed, dependents, symbols, test_files.

    All files go at once: dependents are one aggregate, symbols the first twenty by line, tests one
    join with the candidates.
    """
    asked = paths.orderBy("ord").limit(max(1, min(50, max_files)))
    ids = files.select(F.col("id").alias("file_id"), "path", "indexed_at")
    known = asked.join(ids, "path", "left")
    dependents = edges.join(asked.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("dependents"))
    first = Window.partitionBy("file_id").orderBy("line_start", "name")
    own = symbols.join(known.select("file_id").where("file_id is not null"), "file_id", "left_semi").withColumn("_n", F.row_number().over(first)).where(f"_n <= {MAX_SYMBOLS}")
    own = own.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_start").alias("line"), "name", "kind"))).alias("symbols"))
    candidates = asked.select("path", F.explode(context_test_paths(F.col("path"))).alias("test"))
    tests = candidates.join(files.select(F.col("path").alias("test")).distinct(), "test").groupBy("path").agg(F.array_sort(F.collect_set("test")).alias("test_files"))
    out = known.join(dependents, "path", "left").join(own, "file_id", "left").join(tests, "path", "left")
    return out.select(
        "ord", "path", F.col("file_id").isNotNull().alias("indexed"), F.coalesce("dependents", F.lit(0)).alias("dependents"),
        F.coalesce("symbols", F.array().cast("array<struct<line:int,name:string,kind:string>>")).alias("symbols"), F.coalesce("test_files", F.array().cast("array<string>")).alias("test_files"),
    )


def recent_changes(files: DataFrame, now, days: int = RECENT_DAYS, limit: int = RECENT_LIMIT) -> DataFrame:
    since = F.col("indexed_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return recent(files, "indexed_at", limit, ["path"], since).select("path", "indexed_at")


def is_stale(files: DataFrame, now, hours: int = 24) -> DataFrame:
    """One row: the newest index time, and whether it is older than so many hours."""
    newest = F.max("indexed_at")
    return files.agg(newest.alias("last_indexed_at"), F.coalesce(newest < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)), F.lit(True)).alias("stale"))
