"""Mixing sources to target weights by Pfair scheduling, earliest deadline first.

Each source's rows form blocks. A source that has ``k`` of the ``M`` slots of a frame must, by
its weight w = k/M, run its block j (from 0) in the window from floor(j/w) to ceil((j+1)/w).
Among the blocks that are released, the one with the earliest deadline gets the slot. As the
weights are multiples of 1/M, all windows repeat after one frame, and so does the schedule:
M slots of it, however many rows there are, are worked out once and written into the plan, and each
block finds its slot by its number within its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, hashable, ranked, values

#: Slots of 100 for each source; "other" stands for every other source, and for none.
WEIGHTS = {"src0": 20, **{f"src{i}": 5 for i in range(1, 10)}, **{f"src{i}": 3 for i in range(10, 19)}, "src19": 4, "other": 4}
BLOCK_DOCS = 8
BUCKETS = 4096
#: Parts of a bucket; those in the middle hold rows without an id.
PARTS = 1024


def frame(weights: dict[str, int]) -> list[dict]:
    """The slots of one frame: class, job (the block's number in the frame), slot, release, deadline."""
    size, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(size):
        due = [(-(-(done[s] + 1) * size // k), s) for s, k in weights.items() if k and done[s] * size // k <= slot]
        deadline, s = min(due)
        out.append({"class": s, "job": done[s], "slot": slot, "release": done[s] * size // weights[s], "deadline": deadline})
        done[s] += 1
    return out


def schedule(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """The frame as a table of sum(weights) rows."""
    return values(spark, [(x["class"], x["job"], x["slot"], x["release"], x["deadline"]) for x in frame(weights)], "class string, job bigint, slot_in_frame bigint, release_in_frame bigint, deadline_in_frame bigint")


def mixed(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS) -> DataFrame:
    """All rows and columns of ``docs`` and: class, block, slot, release, deadline, mix_pos.

    Rows take mix_pos order. Within a source they are shuffled by the MD5 of doc_id. While it has
    rows, a source is less than one block away from its share of every prefix; no row is dropped
    or repeated, so a source that runs out leaves its slots empty. Weights are whole slots of a
    frame and need an "other", for null and unlisted sources. Null doc_ids count as empty, and
    are ranked in parts by a hash of the row; ties of repeated rows are in any order. Columns of ``docs`` with
    one of the six names give way, others keep theirs. An empty table gives no rows. Texts are not
    looked at. The broadcast frame has sum(weights) rows, at most 65,536.
    """
    size = sum(weights.values())
    if "other" not in weights or not 0 < size <= 65_536 or min(weights.values()) < 1:
        raise ValueError("weights need 'other', at least one slot each and at most 65,536 in all")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = [k for k in weights if k != "other"]
    rows = docs.select(carried(docs).alias("_carried"), key.alias("_key"), F.when(F.col("doc_id").isNull(), F.xxhash64(*hashable(docs))).alias("_none"), F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit("other")).alias("_class"))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    # all null ids have one key: their rows are dealt by a hash of the row into parts between what is below and above them in their bucket
    part = F.when(F.col("_none").isNotNull(), 1 + F.pmod("_none", F.lit(PARTS - 2))).when(F.col("_key") > F.md5(F.lit("")), F.lit(PARTS - 1)).otherwise(F.lit(0))
    rows = ranked(rows, ["_class"], bucket * PARTS + part, ["_key"], "_rank")
    slots = F.array(*[F.lit(weights[k]).cast("long") for k in weights])
    share = F.element_at(slots, F.array_position(F.array(*[F.lit(k) for k in weights]), F.col("_class")).cast("int"))
    rows = rows.withColumns({"_block": F.floor(F.col("_rank") / block_docs), "_share": share})
    rows = rows.withColumns({"_frame": F.floor(F.col("_block") / F.col("_share")), "_job": F.col("_block") % F.col("_share")})
    plan = schedule(docs.sparkSession, weights).select(F.col("class").alias("_class"), F.col("job").alias("_job"), "slot_in_frame", "release_in_frame", "deadline_in_frame")
    at = rows.join(F.broadcast(plan), ["_class", "_job"])
    base = F.col("_frame") * size
    own = [c for c in docs.columns if c.lower() not in ("class", "block", "slot", "release", "deadline", "mix_pos")]
    return at.select(
        *[F.col("_carried").getField(c).alias(c) for c in own],
        F.col("_class").alias("class"),
        F.col("_block").alias("block"),
        (base + F.col("slot_in_frame")).alias("slot"),
        (base + F.col("release_in_frame")).alias("release"),
        (base + F.col("deadline_in_frame")).alias("deadline"),
        ((base + F.col("slot_in_frame")) * block_docs + F.col("_rank") % block_docs).alias("mix_pos"),
    )


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, with its columns, in mixed order: files hold ranges of mix_pos, sorted."""
    bare = docs.select(carried(docs).alias("_doc"), "doc_id", "source")
    return mixed(bare, weights).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos").select("_doc.*")


def oracle(weights: dict[str, int] = WEIGHTS, block_docs: int = BLOCK_DOCS) -> str:
    """DuckDB SQL for doc_id, class, block, slot, release, deadline, mix_pos, with a recursion of its own for the frame."""
    size, names = sum(weights.values()), sorted(weights)
    w = ", ".join(f"({i + 1}, '{s}', {weights[s]})" for i, s in enumerate(names))
    k = "[" + ", ".join(str(weights[s]) for s in names) + "]"
    due = f"list_transform(range(1, {len(names) + 1}), lambda i: CASE WHEN done[i] * {size} // ({k})[i] <= t THEN (((done[i] + 1) * {size} + ({k})[i] - 1) // ({k})[i]) * 1000 + i ELSE 1000000000 END)"
    return f"""
WITH RECURSIVE w(i, class, k) AS (VALUES {w}),
sim(t, done, pick) AS (
  SELECT 0, list_transform(range(1, {len(names) + 1}), lambda i: 0), 0
  UNION ALL
  SELECT t + 1, list_transform(range(1, {len(names) + 1}), lambda i: CASE WHEN i = p THEN done[i] + 1 ELSE done[i] END), p
  FROM (SELECT t, done, list_min({due}) % 1000 AS p FROM sim WHERE t < {size})
),
frame AS (
  SELECT w.class, w.k, row_number() OVER (PARTITION BY w.class ORDER BY t) - 1 AS job, t - 1 AS slot
  FROM sim JOIN w ON w.i = sim.pick WHERE t > 0
),
d AS (
  SELECT doc_id, CASE WHEN source IN (SELECT class FROM w WHERE class <> 'other') THEN source ELSE 'other' END AS class, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
),
r AS (SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY key) - 1 AS rnk FROM d),
b AS (SELECT doc_id, r.class, rnk, rnk // {block_docs} AS block, k FROM r JOIN w USING (class))
SELECT doc_id, b.class AS class, block,
  (block // b.k) * {size} + slot AS slot,
  (block // b.k) * {size} + (job * {size}) // b.k AS release,
  (block // b.k) * {size} + ((job + 1) * {size} + b.k - 1) // b.k AS deadline,
  ((block // b.k) * {size} + slot) * {block_docs} + rnk % {block_docs} AS mix_pos
FROM b JOIN frame ON frame.class = b.class AND frame.job = block % b.k"""
