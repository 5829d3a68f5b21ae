"""SimHash near-duplicates, compared at the anchor points of a covering code.

A fingerprint has 64 bits. Two that differ in at most three bits differ in at most one bit of
their left or of their right half. On each half of 32 bits the anchors are the words whose
first 31 bits form a codeword of the Hamming code [31, 26]: the code is perfect, so an anchor lies
within its covering radius, one, of every half. A half goes home to its nearest anchor and is
replicated to each anchor within covering radius plus threshold, 1 + 1; the halves of a pair that
differ in one bit then meet at the home of either. Nothing is missed, as a test shows by brute
force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, components, staged

THRESHOLD = 3
SEED = 42
#: At anchors with more homes than this, links are found block by block and leave as spanning forests.
SMALL = 64
BLOCK = 1024
#: Homes of a block that meet all its replicas at once.
AT_ONCE = 64
#: Anchors that are marked by a broadcast; more are marked by a join.
BROADCAST = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a text, as an unsigned integer; none: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[list[int]]:
    """By syndrome s: what leads from a half to each anchor within distance two, its home first."""
    out = []
    for s in range(32):
        home = (1 << (s - 1)) if s else 0
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and (i ^ s) > i]
        out.append([home, home | (1 << 31), *pairs])
    return out


def _syndrome(half: Column) -> Column:
    checks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    return sum((F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << k) for k, m in enumerate(checks)), F.lit(0))


def anchored(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Homes and replicas (side, anchor, fp) of distinct fingerprints."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")), F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")))
    halves = fps.select("fp", F.explode(sides).alias("s")).select("fp", "s.side", "s.half").withColumn("syndrome", _syndrome(F.col("half")).cast("int"))
    masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in m]) for m in _masks()])
    of = F.element_at(masks, F.col("syndrome") + 1)
    homes = halves.select("side", F.col("half").bitwiseXOR(of[0]).alias("anchor"), "fp")
    replicas = halves.select("side", "half", "fp", F.explode(of).alias("mask")).select("side", F.col("half").bitwiseXOR(F.col("mask")).alias("anchor"), "fp")
    return homes, replicas


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect what the links between the homes and the replicas of one block connect."""
    x, y = (pdf.loc[pdf.home == k, "fp"].to_numpy().view(np.uint64) for k in (True, False))
    if not len(x) or not len(y):
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    near = [np.flatnonzero(np.bitwise_count(x[i : i + AT_ONCE, None] ^ y) <= THRESHOLD) + i * len(y) for i in range(0, len(x), AT_ONCE)]
    at_x, at_y = np.divmod(np.concatenate(near), len(y))
    label_x, label_y = x.copy(), y.copy()
    while True:
        new_x, new_y = label_x.copy(), label_y.copy()
        np.minimum.at(new_y, at_y, label_x[at_x])
        np.minimum.at(new_x, at_x, new_y[at_y])
        if (new_x == label_x).all() and (new_y == label_y).all():
            break
        label_x, label_y = new_x, new_y
    a, b = np.concatenate([x, y]).view(np.int64), np.concatenate([label_x, label_y]).view(np.int64)
    return pd.DataFrame({"a": a, "b": b})[a != b].drop_duplicates()


def links(fps: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; what links within THRESHOLD bits connect, they connect.

    A home meets every replica of its anchor. Where an anchor has more than ``small`` homes,
    homes and replicas are dealt into blocks, each pair of blocks is compared on its own, and
    leaves a spanning forest in place of its pairs.
    """
    homes, replicas = anchored(fps)
    key = ["side", "anchor"]
    hot = staged(homes.groupBy(*key).agg(F.count("*").alias("homes")).where(F.col("homes") > small))
    mark = F.broadcast(hot) if hot.count() <= BROADCAST else hot
    few, reps = (x.join(mark, key, "left_anti") for x in (homes.withColumnRenamed("fp", "a"), replicas.withColumnRenamed("fp", "b")))
    pairs = few.join(reps, key).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD).select("a", "b")

    reps = replicas.join(mark, key)
    dealt = staged(hot.join(reps.groupBy(*key).agg(F.count("*").alias("reps")), key).select(*key, F.ceil(F.col("homes") / block).cast("long").alias("h"), F.ceil(F.col("reps") / block).cast("long").alias("r")))
    mix = F.xxhash64("fp")
    hot_homes = homes.join(dealt, key).select(*key, "fp", F.pmod(mix, "h").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("j"), F.lit(True).alias("home"))
    hot_reps = replicas.join(dealt, key).select(*key, "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("i"), F.pmod(mix, "r").alias("j"), F.lit(False).alias("home"))
    forests = hot_homes.unionByName(hot_reps).groupBy(*key, "i", "j").applyInPandas(_forest, "a long, b long")
    return pairs.union(forests)


def near_groups(docs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles have three of them;
    a text of fewer words is one shingle, a text of none (or null) has fingerprint zero and
    links like any other. Copies share a fingerprint and are compared once. Null doc_ids are
    rows like any other but never name a component; one of null doc_ids alone has a null
    component_id. Repeated rows give repeated rows; further columns are not read.
    """
    rows = staged(fingerprints(docs))
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), small, block))
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # staged, so that the join with it can split a root that most fingerprints have
    least = staged(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    of = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the one of each component whose doc_id is smallest.

    Rows without a doc_id stay, as nothing tells them apart; rows that share a doc_id stay or go
    together. Empty and null texts have fingerprint zero and are near each other. Columns keep
    their names, whatever they are.
    """
    stay = near_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(carried(docs).alias("_carried"), F.col("doc_id").cast("long").alias("doc_id"))
    known = rows.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    return known.unionByName(rows.where("doc_id is null")).select("_carried.*")
