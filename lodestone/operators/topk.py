"""The best rows for a phrase from an index, without scoring all that hold it.

Documents are dealt into blocks by their key. For each token and block the index has the most often that a
document holds the token and the least tokens of such a document, which bound what any document of the
block can score. Blocks are read from the highest bound on, some at a time, and reading stops when no block
left could reach the last of the best.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_tokens, tokens
from ..staging import staged
from .search import K1, LEAST_IDF, B, _shifted, clamp_limit

#: Documents of a block, about, and blocks that are read first; each further step reads twice as many.
PER_BLOCK, FIRST = 1024, 4


@dataclass
class Index:
    """Postings (block, token, key, positions, tf, dl), their bounds (token, block, n, tf, dl), and totals (n_rows, avg_dl, blocks) of one row."""

    postings: DataFrame
    bounds: DataFrame
    totals: DataFrame

    def write(self, folder: str) -> None:
        """Sorted by token and block, so that a search reads the row groups of its tokens and blocks."""
        for name, order in (("postings", ["token", "block", "key"]), ("bounds", ["token", "block"])):
            getattr(self, name).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{folder}/{name}")
        self.totals.coalesce(1).write.parquet(f"{folder}/totals")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "bounds", "totals")])


def build(rows: DataFrame, key: str, columns: list[str], blocks: int, query: str | None = None) -> Index:
    """Positions count on over the columns with a gap between, so a phrase stands in one of them.

    With a ``query`` only its tokens are indexed, of all rows: lengths and totals stay those of whole texts,
    and texts are read once, into a checkpoint that every step of a search reads.
    """
    each = rows.select(F.col(key).alias("key"), *[tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    sizes = [F.size(f"t{i}") for i in range(len(columns))]

    def from_(first: Column):
        return lambda t, k: F.struct(t.alias("token"), (k + first).alias("position"))

    placed = [F.transform(f"t{i}", from_(reduce(lambda a, b: a + b, [s + 1 for s in sizes[:i]], F.lit(0)))) for i in range(len(columns))]
    every = F.concat(*placed)
    if query is not None:
        own = sorted(set(query_tokens(query)))
        every = F.filter(every, lambda x: x["token"].isin(own) if own else F.lit(False))
    each = each.select("key", reduce(lambda a, b: a + b, sizes).cast("long").alias("dl"), every.alias("spots"))
    each = each if query is None else staged(each)
    spots = each.select("key", "dl", F.explode_outer("spots").alias("x")).select("key", "dl", "x.*")
    postings = spots.where("token is not null").groupBy("token", "key", "dl").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    postings = postings.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "token", "key", "positions", F.size("positions").alias("tf"), "dl")
    bounds = postings.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    totals = each.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avg_dl")).withColumn("blocks", F.lit(blocks))
    return Index(postings, bounds, totals)


def weight(tf: Column, dl: Column, average: Column) -> Column:
    """BM25 of a phrase without what is the same for all documents; more with tf, less with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


@dataclass
class Found:
    """(key, tf, dl, score), best first, and how many blocks were read of those that hold all tokens."""

    rows: DataFrame
    read: int
    candidates: int


def best(index: Index, query: str, limit: int | None = None, first: int = FIRST) -> Found:
    """The best documents for a phrase, ties by key.

    The order is that of the scores over all documents. A phrase's idf needs the number of documents that
    hold it, which only reading all of them tells: for one token it is known, for more the number of
    those with the rarest token stands for it.
    """
    phrase, k, spark = query_tokens(query), clamp_limit(limit), index.postings.sparkSession
    schema = f"key {dict(index.postings.dtypes)['key']}, tf int, dl long, score double"
    total = index.totals.first()
    if not phrase or not total.n_rows:
        return Found(spark.createDataFrame([], schema), 0, 0)
    own = sorted(set(phrase))
    of_tokens = index.bounds.where(F.col("token").isin(own))
    df = {r.token: r.n for r in of_tokens.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row for each token of the query
    if len(df) < len(own):
        return Found(spark.createDataFrame([], schema), 0, 0)
    average = F.lit(total.avg_dl)
    blocks = of_tokens.groupBy("block").agg(F.count("*").alias("_n"), F.min("tf").alias("tf"), F.max("dl").alias("dl")).where(F.col("_n") == len(own))
    blocks = blocks.select("block", weight(F.col("tf"), F.col("dl"), average).alias("bound"))
    candidates, kept, read, least = blocks.count(), [], [], None
    step = first
    while len(read) < candidates:
        left = blocks.where(~F.col("block").isin(read)) if read else blocks
        # a block whose bound equals the last of the best may hold a smaller key
        left = left if least is None else left.where(F.col("bound") >= least)
        now = [r.block for r in left.orderBy(F.desc("bound"), "block").limit(step).collect()]
        if not now:
            break
        rows = index.postings.where(F.col("token").isin(own) & F.col("block").isin(now))
        at = rows.groupBy("key", "dl").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
        shifted = [_shifted(t, by) for by, t in enumerate(phrase)]
        hits = at.select("key", "dl", F.size(reduce(F.array_intersect, shifted)).alias("tf")).where("tf > 0").withColumn("weight", weight(F.col("tf"), F.col("dl"), average))
        kept += [tuple(r) for r in hits.select("weight", "key", "tf", "dl").orderBy(F.desc("weight"), "key").limit(k).collect()]  # at most `limit` rows a step
        kept = sorted(kept, key=lambda r: (-r[0], r[1]))[:k]
        least = kept[-1][0] if len(kept) == k else None
        read += now
        step *= 2
    n = min(df.values())
    idf = F.greatest(F.log((F.lit(total.n_rows) - n + 0.5) / (F.lit(n) + 0.5)), F.lit(LEAST_IDF))
    out = spark.createDataFrame([(r[1], r[2], r[3], r[0]) for r in kept], schema.replace("score", "weight")) if kept else spark.createDataFrame([], schema.replace("score", "weight"))
    return Found(out.select("key", "tf", "dl", (-idf * F.col("weight")).alias("score")).orderBy("score", "key"), len(read), candidates)
