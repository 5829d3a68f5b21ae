"""Change impact: affected files, tests, risk, warnings and texts, for one request or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import impact_test_paths, is_test
from ..operators.graph import reached

MAX_INDIRECT = 20

# Labels and sentences of an impact report.
COVERAGE = {"good": "Good test coverage - most affected files have tests", "moderate": "Moderate test coverage - some affected files lack tests", "low": "Low test coverage - many affected files lack tests. Consider adding tests."}
WARNINGS = {
    "database": "Database migration detected - verify SQLite schema changes in app/src/db/sqlite-schema.sql",
    "auth": "Authentication changes detected - verify rate limiting and RLS policies are updated",
    "api": "API changes detected - update API documentation and consider versioning if breaking",
    "schema": "Schema/type changes detected - verify all consumers are updated to avoid runtime errors",
    "breaking": "Breaking changes detected - ensure proper deprecation notices and migration guides are provided",
}
WARNED_BY = {"database": ["migration", "db/", "database/"], "auth": ["auth", "middleware"], "api": ["api/", "routes"], "schema": ["schema", "types"]}
DEPLOYMENT = {"feature": "New feature deployment", "refactor": "Refactoring deployment (no user-facing changes expected)", "fix": "Bug fix deployment", "other": "Maintenance deployment"}
SIZES = {"large": "Large-scale changes affecting 50+ files", "medium": "Medium-scale changes affecting 10+ files", "small": "Small-scale changes affecting <10 files"}
RISKS = {"high": "HIGH RISK - recommend staging deployment and gradual rollout", "medium": "MEDIUM RISK - recommend testing in staging before production", "low": "LOW RISK - safe for direct production deployment"}


def affected_files(requests: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(request, path, reason, change_requirement, direct_dependents_count, indirect_dependents_count).

    ``requests`` has (request, ord, path), in the order in which paths are named. Known files count as
    modified, unknown ones as new. Dependents to depth two are to be reviewed, at most twenty indirect
    ones a file; a file keeps the first reason that it gets.
    """
    asked = requests.withColumn("_n", F.row_number().over(Window.partitionBy("request", "path").orderBy("ord"))).where("_n = 1").drop("_n")
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    asked = asked.join(known, "path", "left")
    nodes = reached(edges, asked.where("known").select(F.col("path").alias("root")).distinct(), 2)
    counts = nodes.groupBy("root").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))
    ranked = nodes.withColumn("_n", F.row_number().over(Window.partitionBy("root", "depth").orderBy("node"))).where(f"depth = 1 OR _n <= {MAX_INDIRECT}")
    own = asked.join(counts, asked["path"] == counts["root"], "left").select(
        "request", F.struct("ord", F.lit(0).alias("depth"), F.col("path").alias("at")).alias("order"), "path",
        F.when(F.col("known"), "Direct modification").otherwise("New file to be created").alias("reason"), F.when(F.col("known"), "update").otherwise("test").alias("change_requirement"),
        F.coalesce("direct", F.lit(0)).alias("direct_dependents_count"), F.coalesce("indirect", F.lit(0)).alias("indirect_dependents_count"),
    )
    others = asked.join(ranked, asked["path"] == ranked["root"]).select(
        "request", F.struct("ord", "depth", F.col("node").alias("at")).alias("order"), F.col("node").alias("path"),
        F.concat(F.when(F.col("depth") == 1, "Directly depends on ").otherwise("Indirectly depends on "), F.col("root")).alias("reason"), F.lit("review").alias("change_requirement"),
        F.lit(0).cast("long").alias("direct_dependents_count"), F.lit(0).cast("long").alias("indirect_dependents_count"),
    )
    first = Window.partitionBy("request", "path").orderBy("order")
    return own.unionByName(others).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "order")


def _tests_of(affected: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request, sources, affected), and (request, path, there): the tests that are affected or may belong to a source, each once."""
    # so many tasks, as paths are few bytes but much work
    spread = affected.select("request", "path").repartition(int(affected.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request", "path")
    flagged = spread.withColumn("test", is_test(F.col("path")))
    candidates = flagged.where(~F.col("test")).select("request", F.explode(impact_test_paths(F.col("path"))).alias("path")).distinct()
    # as in imports, paths may be many though few bytes
    there = candidates.join(files.select("path").distinct().withColumn("there", F.lit(True)).hint("merge"), "path", "left")
    tests = flagged.where("test").select("request", "path", F.lit(True).alias("there")).unionByName(there.select("request", "path", F.coalesce("there", F.lit(False)).alias("there")))
    sizes = flagged.groupBy("request").agg(F.count_if(~F.col("test")).alias("sources"), F.count("*").alias("affected"))
    return sizes, tests.groupBy("request", "path").agg(F.max("there").alias("there"))


def test_scope(affected: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each request: test_files, recommended_test_files, sources, coverage_ratio, coverage_impact."""
    sizes, tests = _tests_of(affected, files)
    lists = tests.groupBy("request").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.col("path")))).alias("test_files"), F.array_sort(F.collect_list(F.when(~F.col("there"), F.col("path")))).alias("recommended_test_files"))
    out = sizes.join(lists, "request", "left")
    ratio = F.when(F.col("sources") > 0, F.size("test_files") / F.col("sources")).otherwise(0.0)
    impact = F.when(ratio >= 0.8, COVERAGE["good"]).when(ratio >= 0.5, COVERAGE["moderate"]).otherwise(COVERAGE["low"])
    return out.withColumns({"coverage_ratio": ratio, "coverage_impact": impact})


def test_counts(affected: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each request: sources, affected, tests, recommended; no row holds a list, so a request may affect any number of files."""
    sizes, tests = _tests_of(affected, files)
    counts = tests.groupBy("request").agg(F.count_if("there").alias("tests"), F.count_if(~F.col("there")).alias("recommended"))
    return sizes.join(counts, "request", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tests", "recommended")})


test_scope.__test__ = test_counts.__test__ = False


def risk_level(affected: Column, sources: Column, tests: Column, breaking: Column) -> Column:
    ratio = F.when(sources > 0, tests / sources).otherwise(1.0)
    return F.when(breaking | (affected > 50) | (ratio < 0.3), "high").when((affected > 10) | (ratio < 0.6), "medium").otherwise("low")


def warnings(paths: Column, change_type: Column, breaking: Column) -> Column:
    named = lambda parts: F.exists(paths, lambda p: F.lit(False) | _any(p, parts))
    rules = [(WARNINGS[k], named(parts) & ((change_type == "refactor") if k == "schema" else F.lit(True))) for k, parts in WARNED_BY.items()]
    return F.array_compact(F.array(*[F.when(holds, F.lit(text)) for text, holds in [*rules, (WARNINGS["breaking"], breaking)]]))


def _any(path: Column, parts: list[str]) -> Column:
    found = F.contains(path, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(path, F.lit(p))
    return found


def _pick(by: Column, texts: dict[str, str], otherwise: str) -> Column:
    out = F.lit(texts[otherwise])
    for k, t in texts.items():
        out = F.when(by == k, F.lit(t)).otherwise(out)
    return out


def deployment(change_type: Column, affected: Column, risk: Column) -> Column:
    size = F.when(affected > 50, SIZES["large"]).when(affected > 10, SIZES["medium"]).otherwise(SIZES["small"])
    return F.concat_ws(". ", _pick(change_type, DEPLOYMENT, "other"), size, _pick(risk, RISKS, "low"))


def summary(change_type: Column, affected: Column, tests: Column, coverage: Column, risk: Column, breaking: Column) -> Column:
    return F.concat_ws(
        " ",
        F.concat(F.lit("Change type: "), change_type, F.lit(". "), affected.cast("string"), F.lit(" files affected (including dependents).")),
        F.concat(F.lit("Test scope: "), tests.cast("string"), F.lit(" test files identified. "), coverage),
        F.concat(F.lit("Risk level: "), F.upper(risk), F.lit(".")),
        F.when(breaking, F.lit("WARNING: Breaking changes included.")),
    )


def analyze(requests: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each of ``requests`` (request, change_type, breaking_changes, files_to_modify, files_to_create, files_to_delete)."""
    none = F.array().cast("array<string>")
    paths = F.concat(*[F.coalesce(c, none) for c in ("files_to_modify", "files_to_create", "files_to_delete")])
    asked = requests.select("request", "change_type", F.coalesce("breaking_changes", F.lit(False)).alias("breaking"), paths.alias("paths"))
    affected = affected_files(asked.select("request", F.posexplode("paths").alias("ord", "path")), edges, files)
    scope = test_scope(affected, files)
    lists = affected.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("path", "reason", "change_requirement", "direct_dependents_count", "indirect_dependents_count"))).alias("affected_files"))
    found = asked.join(scope, "request", "left").join(lists, "request", "left")
    found = found.withColumns({"affected": F.coalesce("affected", F.lit(0)), "sources": F.coalesce("sources", F.lit(0)), "tests": F.size(F.coalesce("test_files", none)), "coverage_impact": F.coalesce("coverage_impact", F.lit(COVERAGE["low"]))})
    found = found.withColumn("risk_level", risk_level(F.col("affected"), F.col("sources"), F.col("tests"), F.col("breaking")))
    c = F.col
    return found.select(
        "request", "affected_files", "test_files", "recommended_test_files", "coverage_impact", "risk_level",
        warnings(c("paths"), c("change_type"), c("breaking")).alias("architectural_warnings"),
        none.alias("conflicts"),
        deployment(c("change_type"), c("affected"), c("risk_level")).alias("deployment_impact"),
        summary(c("change_type"), c("affected"), c("tests"), c("coverage_impact"), c("risk_level"), c("breaking")).alias("summary"),
    )


def pull_request_conflicts(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """(request, number, files): open pull requests (number, path) that touch a file of a request (request, path)."""
    return requests.join(changes, "path").groupBy("request", "number").agg(F.array_sort(F.collect_set("path")).alias("files"))
