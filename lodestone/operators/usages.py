"""Where symbols are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_lax
from ..functions.records import usage_type
from ..functions.text import line_at
from .search import latest


def definitions(symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The definition of each wanted (repository_id, name[, path]): the first by path and line."""
    of = files.select(F.col("id").alias("file_id"), F.col("path").alias("def_path"))
    found = symbols.select(F.col("id").alias("symbol_id"), "repository_id", "name", "kind", "line_start", "line_end", "file_id").join(of, "file_id").join(wanted, ["repository_id", "name"])
    if "path" in wanted.columns:
        found = found.where(F.col("path").isNull() | (F.col("path") == F.col("def_path"))).drop("path")
    return latest(found, ["repository_id", "name"], ["def_path", "line_start", "symbol_id"])


def find_usages(symbols: DataFrame, references: DataFrame, files: DataFrame, wanted: DataFrame, include_definitions: bool = False, include_tests: bool = True) -> DataFrame:
    """(repository_id, name, kind, defined_in, file, line, column, usage_type, context) of many symbols at once.

    A reference counts by name or by the id of its symbol. A symbol without a definition has no usages.
    """
    where = definitions(symbols, files, wanted)
    refs = references.select("repository_id", F.col("symbol_name").alias("_name"), F.col("target_symbol_id").alias("_target"), "line_number", "column_number", "reference_type", "file_id")
    by_name = refs.join(where.drop("file_id"), (refs["repository_id"] == where["repository_id"]) & (F.col("_name") == F.col("name"))).drop(refs["repository_id"])
    by_id = refs.join(where.drop("file_id"), (refs["repository_id"] == where["repository_id"]) & (F.col("_target") == F.col("symbol_id"))).drop(refs["repository_id"])
    found = by_name.unionByName(by_id.where(~F.col("_name").eqNullSafe(F.col("name"))))  # each reference once
    text = files.select(F.col("id").alias("file_id"), F.col("path").alias("file"), "content")
    found = found.join(text, "file_id")
    if not include_tests:
        found = found.where(~is_test_lax(F.col("file"), folders=True))
    if not include_definitions:
        found = found.where(~((F.col("file") == F.col("def_path")) & F.col("line_number").between(F.col("line_start"), F.col("line_end"))))
    return found.select(
        "repository_id",
        "name",
        "kind",
        F.concat("def_path", F.lit(":"), F.col("line_start").cast("string")).alias("defined_in"),
        "file",
        F.col("line_number").alias("line"),
        F.col("column_number").alias("column"),
        usage_type(F.col("reference_type")).alias("usage_type"),
        line_at(F.col("content"), F.col("line_number")).alias("context"),
    )


def usage_summary(usages: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for each wanted symbol: total_usages, files_with_usages; unknown ones are defined in "unknown"."""
    totals = usages.groupBy("repository_id", "name").agg(F.first("kind").alias("kind"), F.first("defined_in").alias("defined_in"), F.count("*").alias("total_usages"), F.count_distinct("file").alias("files_with_usages"))
    none = {"total_usages": 0, "files_with_usages": 0, "kind": "unknown", "defined_in": "unknown"}
    return wanted.select("repository_id", "name").join(totals, ["repository_id", "name"], "left").fillna(none)
