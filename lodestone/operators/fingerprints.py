"""Prefix, suffix and containment joins as equi-joins, on pieces of the lengths that occur.

A text that ends in a wanted one has it as its piece of that length, so texts are cut at the lengths that
wanted texts have, which one row holds, and pieces meet wanted texts by equality. What a text contains is
found by hashes of windows: of each wanted text the beginning of the largest power of two
of characters stands for it, so there are few window sizes, and what meets is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lengths(wanted: DataFrame, column: str) -> Column:
    """The different lengths of a column, as one array in a scalar subquery: no more numbers than the longest has characters."""
    return F.coalesce(wanted.agg(F.collect_set(F.char_length(column))).scalar(), F.array().cast("array<int>"))


def _pieces(rows: DataFrame, text: str, wanted: DataFrame, key: str, piece) -> DataFrame:
    sized = rows.withColumn("_length", F.explode(_lengths(wanted, key))).where(F.col("_length") <= F.char_length(text))
    return sized.withColumn("_piece", piece(F.col("_length"))).join(wanted.withColumn("_piece", F.col(key)), "_piece").drop("_piece", "_length")


def joined_by_prefix(rows: DataFrame, text: str, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with each row of ``wanted`` whose ``key`` their ``text`` begins with; nulls match nothing."""
    return _pieces(rows, text, wanted, key, lambda n: F.substring(text, F.lit(1), n))


def joined_by_suffix(rows: DataFrame, text: str, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with each row of ``wanted`` whose ``key`` their ``text`` ends in; nulls match nothing."""
    return _pieces(rows, text, wanted, key, lambda n: F.substring(text, F.char_length(text) - n + 1, n))


def contained(texts: DataFrame, text: str, wanted: DataFrame, key: str) -> DataFrame:
    """The different ``key``s of ``wanted`` that some ``text`` contains, under that name; the empty one is in any text."""
    needles = wanted.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    size = F.when(F.char_length("_key") == 0, 0).otherwise(F.pow(F.lit(2), F.floor(F.log2(F.char_length("_key")))).cast("int"))
    needles = needles.withColumn("_size", size).withColumn("_hash", F.xxhash64("_size", F.substring("_key", F.lit(1), F.col("_size"))))
    sizes = F.coalesce(needles.agg(F.collect_set("_size")).scalar(), F.array().cast("array<int>"))  # at most one for each power of two
    whole = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_id", F.xxhash64("_text"))
    sized = whole.withColumn("_size", F.explode(sizes)).where(F.col("_size") <= F.char_length("_text"))
    places = F.sequence(F.lit(1), F.when(F.col("_size") == 0, 1).otherwise(F.char_length("_text") - F.col("_size") + 1))
    hashes = F.array_distinct(F.transform(places, lambda i: F.xxhash64("_size", F.substring("_text", i, F.col("_size")))))
    windows = sized.select("_id", F.explode(hashes).alias("_hash"))
    met = windows.join(needles.select("_key", "_hash"), "_hash").select("_id", "_key").distinct()
    return met.join(whole, "_id").where(F.contains("_text", "_key")).select(F.col("_key").alias(key)).distinct()
