"""JSON lines: export, import, validation and deletion manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import SYNCED, TABLES
from ..operators.tables import apply_deletions, upsert_any

MANIFEST = ".deletions.jsonl"
STATE = ".export-state.json"
MAX_MANIFEST = 10 * 1024 * 1024


class ManifestError(ValueError):
    pass


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines of a file that aren't blank, numbered from 1.

    A row's position in its partition and the row counts of the partitions before it give its number.
    """
    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id()).select("value", F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each partition
    return rows.join(starts, "part").where(F.trim("value") != "").select((F.col("start") + F.col("at") + 1).alias("line"), "value")


def validate(spark: SparkSession, path: str) -> DataFrame:
    """One row: valid, line_count, errors (line numbers)."""
    rows = read_lines(spark, path).withColumn("bad", F.try_parse_json("value").isNull())
    out = rows.agg(F.count("*").alias("line_count"), F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("line")))).alias("errors"))
    return out.select((F.size("errors") == 0).alias("valid"), "line_count", "errors")


def read_table(spark: SparkSession, path: str, name: str, required: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a table from JSON lines, with their line, and (line, error) of those that are left out."""
    table = TABLES[name]
    rows = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = rows.withColumn("_json", F.try_parse_json("value"))
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*[F.lit(c) for c in (table.required if required is None else required)]), F.coalesce(keys, F.array().cast("array<string>")))
    parsed = parsed.withColumn("_error", F.when(F.col("_json").isNull(), F.lit("not JSON")).when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", "))))
    good = parsed.where("_error is null").select("_at", F.from_json("value", table.schema).alias("_row")).select("_at", "_row.*")
    return good, parsed.where("_error is not null").select(F.col("_at").alias("line"), F.col("_error").alias("error"))


def import_table(spark: SparkSession, path: str, name: str, old: DataFrame, required: tuple[str, ...] | None = None, ignore_conflicts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with the rows of a file, the last of equal keys winning, or old ones with ``ignore_conflicts``; and the errors."""
    rows, errors = read_table(spark, path, name, required)
    uniques = TABLES[name].unique
    if ignore_conflicts:
        for keys in uniques:
            rows = rows.join(old.select(*keys).distinct(), list(keys), "left_anti")
    return upsert_any(old, rows, uniques, [F.col("_at").desc()]), errors


def import_all(spark: SparkSession, folder: str, tables: dict[str, DataFrame], names: tuple[str, ...] = SYNCED) -> dict[str, DataFrame]:
    """Deletions first, then each table whose file is there, parents before children."""
    entries = load_manifest(spark, f"{folder}/{MANIFEST}")
    if entries is not None:
        tables, _ = apply_deletions(tables, entries)
    for name in names:
        if exists(spark, at := f"{folder}/{name}.jsonl"):
            tables[name], _ = import_table(spark, at, name, tables[name])
    return tables


def content_hash(rows: DataFrame) -> str:
    """A hash of all rows in any order: counts and sums are combined before the shuffle."""
    line = F.to_json(F.struct(*rows.columns))
    found = rows.select(line.alias("j")).agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(j))").alias("x"), F.expr("sum(cast(xxhash64(j, 1) as decimal(38,0)))").alias("s")).first()
    return f"{found.n}:{found.x}:{found.s}"


def export(rows: DataFrame, path: str, exclude: tuple[str, ...] = ()) -> None:
    """One JSON object a line; Spark writes a folder of files."""
    columns = [c for c in rows.columns if c not in exclude]
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("overwrite").text(path)


def export_all(spark: SparkSession, tables: dict[str, DataFrame], folder: str, force: bool = False, names: tuple[str, ...] = SYNCED, exclude: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Export each table whose content has changed since the last export; what happened to each."""
    state, done = read_text(spark, f"{folder}/{STATE}"), {}
    known = json.loads(state) if state else {}
    for name in [n for n in names if n in tables]:
        mark = content_hash(tables[name])
        if not force and known.get(name) == mark:
            done[name] = "unchanged"
            continue
        export(tables[name], f"{folder}/{name}.jsonl", (exclude or {}).get(name, ()))
        known[name], done[name] = mark, "exported"
    write_text(spark, f"{folder}/{STATE}", json.dumps(known))
    clear_manifest(spark, folder)
    return done


def load_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(table, id, deleted_at) of a manifest's valid lines; too large a file or too many bad lines are an error."""
    text = read_text(spark, path, MAX_MANIFEST)
    if text is None:
        return None
    lines = [x for x in text.strip().split("\n") if x]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    entry = F.from_json("value", "table string, id string, deleted_at string")
    rows = raw.select(entry.alias("e")).select("e.*").withColumn("at", F.try_to_timestamp("deleted_at"))
    good = rows.where(F.col("table").isin(*SYNCED) & (F.trim("id") != "") & F.col("at").isNotNull())
    bad = len(lines) - good.count()
    if bad > 10 and bad > 0.1 * len(lines):
        raise ManifestError(f"too many invalid entries: {bad} of {len(lines)}")
    return good.select("table", F.trim("id").alias("id"), F.col("at").alias("deleted_at"))


def record_deletion(spark: SparkSession, folder: str, table: str, ident: str, deleted_at: str) -> None:
    if table not in SYNCED:
        raise ManifestError(f"deletions of {table} aren't recorded")
    old = read_text(spark, f"{folder}/{MANIFEST}") or ""
    write_text(spark, f"{folder}/{MANIFEST}", old + json.dumps({"table": table, "id": ident, "deleted_at": deleted_at}) + "\n")


def clear_manifest(spark: SparkSession, folder: str) -> None:
    write_text(spark, f"{folder}/{MANIFEST}", "")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at, fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str, most: int | None = None) -> str | None:
    """A small file of state, or None."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    if most is not None and fs.getFileStatus(at).getLen() > most:
        raise ManifestError(f"{path} is larger than {most} bytes")
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _at(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
