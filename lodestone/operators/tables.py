"""Writes on immutable tables: upserts, deletes with what follows from them, merges, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TABLES
from ..functions.paths import detect_language, normalize_path
from ..functions.records import row_id
from .search import latest


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None, replace: bool = True) -> DataFrame:
    """``old`` with the rows of ``new``; on equal keys the new row wins, or with ``replace=False`` the old one.

    Of several new rows with one key the first by ``order`` counts.
    """
    new = latest(new, keys, order) if order else new.dropDuplicates(keys)
    if replace:
        return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_any(old: DataFrame, new: DataFrame, uniques: tuple[tuple[str, ...], ...], order: list) -> DataFrame:
    """An upsert that drops old rows which agree with a new one on any unique key."""
    for keys in uniques:
        new = latest(new, list(keys), order)
    kept = reduce(lambda rows, keys: rows.join(new.select(*keys).where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), list(keys), "left_anti"), uniques, old)
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def delete(tables: dict[str, DataFrame], name: str, gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` whose key is in ``gone`` (id), and what refers to them.

    References that cascade go with them, all the way down; others become null. Join after
    join: nothing is collected.
    """
    out = dict(tables)
    ids = gone.select("id").distinct()
    for child, spec in TABLES.items():
        if child not in out or child == name:
            continue
        for column, parent in spec.cascade.items():
            if parent == name and "id" not in out[child].columns:  # nothing refers to such rows
                out[child] = out[child].join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*out[child].columns)
            elif parent == name:
                rows = out[child].join(ids.select(F.col("id").alias(column)), column, "left_semi").select("id")
                out = delete(out, child, rows)
        for column, parent in spec.set_null.items():
            if parent == name:
                flag = ids.select(F.col("id").alias(column), F.lit(True).alias("_gone"))
                found = out[child].join(flag, column, "left")
                out[child] = found.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*out[child].columns)
    out[name] = out[name].join(ids.select(F.col("id").alias(key)), key, "left_anti").select(*tables[name].columns)
    return out


def delete_files(tables: dict[str, DataFrame], repository_id: str, paths: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete files by path, and the (path) that were there."""
    wanted = paths.select(normalize_path(F.col("path")).alias("path")).distinct()
    found = tables["indexed_files"].where(F.col("repository_id") == repository_id).join(wanted, "path", "left_semi")
    return delete(tables, "indexed_files", found.select("id")), found.select("path")


def apply_deletions(tables: dict[str, DataFrame], entries: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete by manifest entries (table, id); also (table, deleted), the rows that were really there."""
    counts = []
    for name in [t for t in tables if t in TABLES]:
        ids = entries.where(F.col("table") == name).select("id").distinct()
        if "id" in tables[name].columns:
            counts.append(tables[name].join(ids, "id", "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted")))
            tables = delete(tables, name, ids)
    return tables, reduce(DataFrame.unionByName, counts)


def file_rows(files: DataFrame, repository_id: str, now) -> DataFrame:
    """(path, content, dependencies) as rows of indexed_files, with the same ids on every run."""
    path = normalize_path(F.col("path"))
    return files.select(
        row_id(F.lit(repository_id), path).alias("id"),
        F.lit(repository_id).alias("repository_id"),
        path.alias("path"),
        "content",
        detect_language(path).alias("language"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("content_hash"),
        F.lit(now).cast("timestamp").alias("indexed_at"),
        F.to_json(F.struct("dependencies")).alias("metadata"),
    )


def symbol_rows(symbols: DataFrame, files: DataFrame, repository_id: str, now) -> DataFrame:
    """Extracted symbols with the ids of their files; symbols of unknown files are left out."""
    of = files.where(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), "path")
    flags = F.to_json(F.struct("column_start", "column_end", "is_exported", "is_async", "access_modifier"))
    return symbols.join(of, "path").select(
        row_id("file_id", "name", F.col("line_start").cast("string"), "kind", F.col("column_start").cast("string")).alias("id"), "file_id", F.lit(repository_id).alias("repository_id"), "name", "kind", "line_start", "line_end", "signature", "documentation", flags.alias("metadata"), F.lit(now).cast("timestamp").alias("created_at")
    )


def reference_rows(references: DataFrame, files: DataFrame, symbols: DataFrame, repository_id: str, now) -> DataFrame:
    """Extracted references with the ids of their files and, where target file and name are known, of their symbols."""
    of = files.where(F.col("repository_id") == repository_id).select(F.col("id").alias("file_id"), "path")
    target = files.where(F.col("repository_id") == repository_id).select(F.col("id").alias("_file"), F.col("path").alias("target_file_path"))
    named = latest(symbols.select(F.col("file_id").alias("_file"), F.col("name").alias("_name"), F.col("id").alias("target_symbol_id"), "line_start"), ["_file", "_name"], ["line_start", "target_symbol_id"]).drop("line_start")
    found = references.join(of, "path").join(target, "target_file_path", "left").withColumn("_name", F.coalesce(F.col("metadata.importedName"), F.col("target_name")))
    found = found.join(named, ["_file", "_name"], "left")
    return found.select(
        row_id("file_id", "target_name", "reference_type", F.col("line_number").cast("string"), F.col("column_number").cast("string")).alias("id"), "file_id", F.lit(repository_id).alias("repository_id"), F.col("target_name").alias("symbol_name"), "target_symbol_id", "target_file_path", "line_number", "column_number", "reference_type", F.to_json("metadata").alias("metadata"), F.lit(now).cast("timestamp").alias("created_at")
    ).dropDuplicates(["id"])


def replace_for(old: DataFrame, new: DataFrame, key: str, replaced: DataFrame) -> DataFrame:
    """``old`` without the rows of the replaced keys, and the new rows: delete, then insert."""
    return old.join(replaced.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge_three(ours: DataFrame, theirs: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of either side, theirs first; what only the base had is gone, and one side's delete is undone by the other."""
    sides = [(latest(s, [key], [F.col(order).desc()]) if order else s.dropDuplicates([key])) for s in (ours, theirs)]
    left, right = (s.select(F.col(key), F.struct(*ours.columns).alias(n)) for s, n in zip(sides, ("_ours", "_theirs"), strict=True))
    return left.join(right, key, "full_outer").select(F.coalesce("_theirs", "_ours").alias("_row")).select("_row.*").orderBy(key)


def changed_by_time(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): added, modified or deleted, of (path, indexed_at) against (path, modified_at)."""
    both = indexed.select("path", "indexed_at").join(found.select("path", "modified_at"), "path", "full_outer")
    status = F.when(F.col("indexed_at").isNull(), "added").when(F.col("modified_at").isNull(), "deleted").when(F.col("modified_at") > F.col("indexed_at"), "modified")
    return both.select("path", status.alias("status")).where("status is not null")


def statistics(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """One row with the count of each table."""
    counts = reduce(DataFrame.unionByName, [tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names])
    return counts.groupBy().pivot("name", names).agg(F.first("n"))


def prune(entries: DataFrame, now, days: int, terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Entries without the ended ones that are older."""
    old = F.col("started_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return entries.where(~(F.col("status").isin(*terminal) & old))


def batch_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.sum("total_cost_usd").alias("total_cost_usd"))


def touch(rows: DataFrame, key: str, value: str, column: str, now) -> DataFrame:
    return rows.withColumn(column, F.when(F.col(key) == value, F.lit(now).cast("timestamp")).otherwise(F.col(column)))


def ensure_repository(repositories: DataFrame, full_name: str, now, git_url: str | None = None, branch: str = "main") -> tuple[DataFrame, str]:
    """The repositories with this one, and its id."""
    spark = repositories.sparkSession
    found = repositories.where(F.col("full_name") == full_name).select("id").first()
    if found:
        return repositories, found.id
    row = spark.range(1).select(row_id(F.lit(full_name)).alias("id"), F.lit(full_name.rsplit("/", 1)[-1]).alias("name"), F.lit(full_name).alias("full_name"), F.lit(git_url).alias("git_url"), F.lit(branch).alias("default_branch"), F.lit(None).cast("timestamp").alias("last_indexed_at"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"), F.lit("{}").alias("metadata"))
    return repositories.unionByName(row), row.first().id


def resolve_repository(repositories: DataFrame, name: str | None) -> str | None:
    """A repository's id by its id or full name; none given: the newest."""
    if name is None:
        newest = repositories.agg(F.max_by("id", F.struct("created_at", "id")).alias("id")).first()
        return newest.id
    if len(name) in (36, 64) and set(name.lower()) <= set("0123456789abcdef-"):
        return name
    found = repositories.where(F.col("full_name") == name).select("id").first()
    return found.id if found else None
