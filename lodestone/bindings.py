"""The driver's tables as an index of code: parts are files and symbols, line items are references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of a part's file, by its type.
FOLDERS = {"MEDIUM": "src/db/", "STANDARD": "src/api/", "LARGE": "src/indexer/", "PROMO": "tests/", "SMALL": "docs/", "ECONOMY": "app/src/mcp/"}
#: Kind of a part's symbol, by its type.
KINDS = {"MEDIUM": "function", "STANDARD": "class", "LARGE": "interface", "PROMO": "type", "SMALL": "constant", "ECONOMY": "variable"}
#: Type of a reference, by its line number.
TYPES = ["import", "re_export", "export_all", "dynamic_import", "call", "type_reference", "property_access"]
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(column: str, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column))


def _sql_case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def part_path() -> Column:
    return F.concat(_map("p_type", FOLDERS), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".ts"))


def content() -> Column:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return F.concat(F.lit("import { a } from './part_"), size, F.lit("';\nexport function fn_"), key, F.lit("() {\n  return call_"), size, F.lit("();\n}\nexport const c_"), key, F.lit(" = 1;\n"))


#: A source with every form of symbol and reference; # stands for the part's number.
RICH = """/** Loads a record. */
export class Loader#<T extends Base> extends Base implements Port {
  private cache: Map<string, T> = make();
  static async load(id: string, ...rest: string[]): Promise<T> {
    return await fetch#(id, rest);
  }
  get size() { return this.cache.size; }
}
export { one, two as three } from './parts/p#';
export * from "./all";
/* limits */
export const limit = 10, make = async (a, b) => a < b;
export enum Kind { A, B }
export interface Port { run(): void }
export type Id = string | number;
const lazy = () => import('./lazy/m#');
export default function main() { return lazy().then(m => m.run()); }
import * as all from './all';
import def, { named as other, type Only } from '@lib/x#';
import './effects';
"""
#: What is in it, by hand: (name, kind, first line, last line, signature, comment, async, access), and (name, type, line, source).
RICH_SYMBOLS = [
    ("Loader#", "class", 2, 8, None, "Loads a record.", False, None), ("cache", "property", 3, 3, None, "Loads a record.", False, "private"), ("load", "method", 4, 6, "(id, ...rest) => Promise<T>", "Loads a record.", True, None),
    ("size", "method", 7, 7, "()", None, False, None), ("limit", "constant", 12, 12, None, "limits", False, None), ("make", "function", 12, 12, "(a, b)", "limits", True, None), ("Kind", "enum", 13, 13, None, "limits", False, None),
    ("Port", "interface", 14, 14, None, "limits", False, None), ("Id", "type", 15, 15, None, "limits", False, None), ("main", "function", 17, 17, "()", None, False, None),
]
RICH_REFERENCES = [
    ("T", "type_reference", 2, None), ("Base", "type_reference", 2, None), ("Base", "type_reference", 2, None), ("Port", "type_reference", 2, None), ("Map", "type_reference", 3, None), ("make", "call", 3, None), ("Promise", "type_reference", 4, None),
    ("T", "type_reference", 4, None), ("fetch#", "call", 5, None), ("cache", "property_access", 7, None), ("size", "property_access", 7, None), ("one", "re_export", 9, "./parts/p#"), ("two", "re_export", 9, "./parts/p#"), ("*", "export_all", 10, "./all"),
    ("./lazy/m#", "dynamic_import", 16, "./lazy/m#"), ("lazy", "call", 17, None), ("then", "call", 17, None), ("then", "property_access", 17, None), ("run", "call", 17, None), ("run", "property_access", 17, None), ("all", "import", 18, "./all"),
    ("def", "import", 19, "@lib/x#"), ("other", "import", 19, "@lib/x#"), ("Only", "import", 19, "@lib/x#"), ("./effects", "import", 20, "./effects"),
]
#: A tail that no strict parser takes, and what is wrong with it: (line, column, message).
BROKEN = "const s = 'open\nfunction broken(a {\n  return [1, 2;\n}}\n"
BROKEN_PROBLEMS = [(21, 10, "unterminated string"), (22, 15, "'(' is not closed"), (23, 9, "'[' is not closed"), (24, 1, "'}' closes nothing")]


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a source with every form for each part; those of odd parts are broken."""
    key = F.col("p_partkey")
    whole = F.replace(F.lit(RICH), F.lit("#"), key.cast("string"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/rich_"), key.cast("string"), F.lit(".tsx")).alias("path"), F.when(key % 2 == 1, F.concat(whole, F.lit(BROKEN))).otherwise(whole).alias("content"))


def sql_values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.lit("main").alias("repository_id"), part_path().alias("path"), content().alias("content"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval(F.col("p_size"))).alias("indexed_at"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.concat(F.lit("s"), key).alias("id"), F.concat(F.lit("f"), key).alias("file_id"), F.lit("main").alias("repository_id"), F.translate("p_name", " ", "_").alias("name"), _map("p_type", KINDS).alias("kind"),
        F.lit(2).alias("line_start"), F.lit(4).alias("line_end"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("documentation"), F.format_string('{"is_exported":%s}', (F.col("p_size") > 25).cast("string")).alias("metadata"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item refers from its part's file to the file of the part that has its supplier's number."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    target = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_suppkey"), part_path().alias("target_file_path"), F.translate("p_name", " ", "_").alias("symbol_name"))
    line = F.col("l_linenumber")
    of = F.element_at(F.array(*[F.lit(t) for t in TYPES]), line)
    return items.join(target, "l_suppkey").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("file_id"), F.lit("main").alias("repository_id"), "symbol_name",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_symbol_id"), F.when(of != "dynamic_import", F.col("target_file_path")).alias("target_file_path"), line.cast("int").alias("line_number"), F.lit(0).alias("column_number"), of.alias("reference_type"),
        F.format_string('{"importSource":"%s"}', F.col("target_file_path")).alias("metadata"),
    )


#: The same three tables for DuckDB, as the beginning of a WITH.
_PATH = f"{_sql_case('p_type', FOLDERS)} || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts'"
_CONTENT = "'import { a } from ''./part_' || p_size || ''';' || chr(10) || 'export function fn_' || p_partkey || '() {' || chr(10) || '  return call_' || p_size || '();' || chr(10) || '}' || chr(10) || 'export const c_' || p_partkey || ' = 1;' || chr(10)"
SQL = f"""
files AS (SELECT 'f' || p_partkey AS id, 'main' AS repository_id, {_PATH} AS path, {_CONTENT} AS content, TIMESTAMP '{NOW}' - to_days(p_size) AS indexed_at FROM part),
symbols AS (SELECT 's' || p_partkey AS id, 'f' || p_partkey AS file_id, 'main' AS repository_id, replace(p_name, ' ', '_') AS name, {_sql_case('p_type', KINDS)} AS kind, 2 AS line_start, 4 AS line_end, p_size > 25 AS exported FROM part),
refs AS (
  SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, 'f' || l_partkey AS file_id, 'main' AS repository_id, replace(p_name, ' ', '_') AS symbol_name, 's' || l_suppkey AS target_symbol_id,
    CASE WHEN l_linenumber <> 4 THEN {_PATH} END AS target_file_path, {_PATH} AS source, l_linenumber AS line_number, ({TYPES!r})[l_linenumber] AS reference_type
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN part ON p_partkey = l_suppkey
),
edges AS (SELECT DISTINCT f.path AS src, r.target_file_path AS dst FROM refs r JOIN files f ON r.file_id = f.id JOIN files t ON t.path = r.target_file_path WHERE reference_type IN ('import', 're_export', 'export_all'))"""
