"""What several training-data operators share: staging, ranks inside hot groups, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    A folder of our own is set only where there is none on one machine, as in tests; on a cluster
    that is an error, as executors don't share a local folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return found or context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written into the plan; ``schema`` as for createDataFrame."""
    fields = [c.split() for c in schema.split(", ")]
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {listed} AS t({', '.join(n for n, _ in fields)})")


class _Collected(threading.local):
    """Lists to which a thread's checkpoints are added while they are collected, the innermost last."""

    def __init__(self) -> None:
        self.lists: list[list[str]] = []


_COLLECTED = _Collected()


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder.

    It stays as long as results may be read from it; inside ``temporary`` it goes at the end.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if _COLLECTED.lists:
        _COLLECTED.lists[-1].append(place(out))
    return out


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, of which only the columns that are needed are read again."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    if _COLLECTED.lists:
        _COLLECTED.lists[-1].append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def place(checkpointed: DataFrame) -> str:
    """The folder of a DataFrame that ``staged`` returned."""
    return checkpointed._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Remove at the end what is staged inside, but for places that are taken out of the list."""
    _COLLECTED.lists.append([])
    try:
        yield _COLLECTED.lists[-1]
    finally:
        for folder in _COLLECTED.lists.pop():
            remove(spark, folder)


def carried(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash with one of ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def hashable(docs: DataFrame) -> list[Column]:
    """The columns that xxhash64 takes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]


def stretches(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``size`` bytes of text, or as much more as the last text has."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size)) + 1
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the cheaper equal of translate() for texts of ASCII characters alone
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str], rank: str) -> DataFrame:
    """Add ``rank``, from 0, of each row among the rows with its keys, by bucket and then by ``order``.

    A key may hold any share of the rows: each (key, bucket) pair is sorted on its own, and only
    one count for each pair is summed up over the whole key.
    """
    rows = df.withColumn("_bucket", bucket)
    cell = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return inside.join(starts, cell).withColumn(rank, F.col("_start") + F.col("_row") - 1).drop("_bucket", "_start", "_row")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to one row (node, root) for each node that has an edge; root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each step is
    a minimum for each node, which is combined before the shuffle, and a join with it. The minima
    are staged, so the join stands on plain exchanges and the edges of a large node can be split.
    No neighbour list is ever collected. What a step staged goes when the next one stands.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen, last = tuple(mark), now
        with temporary(spark) as places:
            both = now.union(now.select("b", "a"))
            least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
            large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
            low = staged(large.groupBy("a").agg(F.min("b").alias("m")))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
            now = staged(small)
            places.remove(place(now))
            places.append(place(last))
        if _COLLECTED.lists:
            _COLLECTED.lists[-1][:] = [x for x in _COLLECTED.lists[-1] if x != place(last)] + [place(now)]
