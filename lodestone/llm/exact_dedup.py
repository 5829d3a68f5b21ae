"""Exact deduplication by content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, carried, hashable, staged


def _tie() -> Column:
    """What decides between rows of one doc_id whose texts differ in case only."""
    return F.xxhash64(F.col("text").cast("string"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after lower-casing A-Z. Rows group by the 128-bit MD5 of the
    text; inside a group the texts themselves are the key of a second aggregation, so two texts
    that share an MD5 come apart (they then differ in SHA-256; should even that agree, the query
    fails rather than merge them). The row with the largest doc_id stays.

    Null texts count as empty and so equal each other. Null doc_ids sort first: such a row stays
    only if its whole group has none, and keep_id is null then. Of several rows with the largest
    doc_id exactly one is kept, the one whose text as it stands has the largest hash. An empty
    table gives no rows; further columns are not read.
    """
    norm = ascii_lower(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), _tie().alias("tie"))
    keys = staged(texts.select("doc_id", "tie", F.monotonically_increasing_id().alias("row"), F.md5("norm").alias("md5"), F.sha2("norm", 256).alias("text_sha256")))
    key = ["md5", "text_sha256"]
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))), F.col("tie"))
    groups = keys.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.max_by("row", order).alias("keep_row"))
    distinct = texts.groupBy(F.md5("norm").alias("md5"), "norm").agg(F.count("*").alias("copies"))
    compared = distinct.select("md5", F.sha2("norm", 256).alias("text_sha256")).groupBy(*key).agg(F.count("*").alias("texts"))
    # staged, so that the join below stands on plain exchanges and a large group's rows can be split
    checked = groups.join(compared, key).withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
    return keys.join(staged(checked), key).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: one of each group of equal texts.

    Nulls and ties are as in ``exact_groups``: of equal texts without any doc_id one row stays, and of
    rows that differ in further columns alone the one with the largest hash. Columns keep their
    names, whatever they are. Rows are found again by hash and doc_id together, so a large group
    does not meet in one task; a doc_id that very many equal rows share does, and is ranked there
    with a limit of one.
    """
    sha, doc = F.sha2(ascii_lower(F.col("text")), 256), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    stay = exact_groups(docs).where("kept").select(F.col("text_sha256").alias("_sha"), F.coalesce("keep_id", F.lit(-(2**63))).alias("_doc"))
    rows = docs.select(carried(docs).alias("_carried"), sha.alias("_sha"), doc.alias("_doc"), _tie().alias("_tie"), F.xxhash64(*hashable(docs)).alias("_all"))
    one = Window.partitionBy("_sha", "_doc").orderBy(F.desc("_tie"), F.desc("_all"))  # repeated rows
    return rows.join(stay, ["_sha", "_doc"]).withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_carried.*")
