"""Implementation specs against conventions and the index, and expertise against the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fingerprints import joined_by_suffix

# Conventions of a spec, and the sentences of its report.
MIGRATION = r"^\d{14}_[a-z0-9_-]+\.sql$"
TEST_ENDINGS = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")
ALIASES = ["@api/", "@auth/", "@db/", "@indexer/", "@mcp/", "@validation/", "@queue/", "@shared/"]
CONDITIONS = {
    "errors": "Fix %d validation error(s) before implementation",
    "schema": "Verify SQLite schema changes in app/src/db/sqlite-schema.sql",
    "migrations": "Run migration sync validation: bun run test:validate-migrations",
    "document": "Document breaking changes in PR description",
    "guide": "Provide migration guide for affected consumers",
    "flag": "Consider feature flag for gradual rollout",
    "tests": "Add test files before merging to maintain coverage",
    "dependencies": "Verify %d new dependencies are necessary and compatible",
    "suite": "Run full test suite before creating PR",
    "docs": "Update documentation if APIs or schemas change",
}
FIXES = {
    "conflict": "Remove from files_to_create or rename the file",
    "migration": "Use format: YYYYMMDDHHMMSS_description.sql (e.g., 20251108120000_add_oauth_providers.sql)",
    "ending": "Rename to use .test.ts or .spec.ts extension",
    "alias": "Consider using existing aliases: " + ", ".join(ALIASES),
    "tests": "Add test files for new implementation files to maintain test coverage",
    "more tests": "Consider adding more test files to achieve at least 1:1 ratio",
    "version": "Specify an exact version or version range",
    "mocks": "Consider using real service instances instead of mocks (see /anti-mock)",
}
SPEC = "feature_name string, files_to_create array<struct<path:string>>, files_to_modify array<struct<path:string>>, migrations array<struct<filename:string>>, dependencies_to_add array<struct<name:string,version:string>>, breaking_changes boolean"


def _testy(path: Column) -> Column:
    return F.contains(path, F.lit("test")) | F.contains(path, F.lit("spec"))


def issues(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(spec, severity, type, message, affected_resource, suggested_fix): what breaks a convention, of many specs at once."""
    made = specs.select("spec", F.explode("files_to_create.path").alias("path"))
    planned = made.unionByName(specs.select("spec", F.explode("files_to_modify.path").alias("path")))
    def row(df: DataFrame, severity: str, kind: str, message: Column, at: str | None, fix: str) -> DataFrame:
        resource = F.col(at) if at else F.lit(None).cast("string")
        return df.select("spec", F.lit(severity).alias("severity"), F.lit(kind).alias("type"), message.alias("message"), resource.alias("affected_resource"), F.lit(FIXES[fix]).alias("suggested_fix"))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    there = made.join(files.select("path").distinct(), "path", "left_semi")
    migrations = specs.select("spec", F.explode("migrations.filename").alias("filename"))
    named = planned.where(_testy(F.col("path")) & ~reduce(lambda a, b: a | b, [F.endswith("path", F.lit(e)) for e in TEST_ENDINGS]))
    top = F.regexp_extract("path", "^app/src/([^/]+)/", 1)
    aliased = planned.where(F.col("path").rlike(r"\.tsx?$") & ~_testy(F.col("path")) & (top != "") & ~F.concat(F.lit("@"), top, F.lit("/")).isin(ALIASES)).withColumn("top", top)
    created = F.coalesce("files_to_create.path", F.array().cast("array<string>"))
    sizes = specs.select("spec", F.size(F.filter(created, lambda p: ~_testy(p))).alias("sources"), F.size(F.filter(created, _testy)).alias("tests"))
    added = specs.select("spec", F.explode("dependencies_to_add").alias("d")).select("spec", "d.*")
    return reduce(
        DataFrame.unionByName,
        [
            row(there, "error", "file_conflict", text("File already exists: ", F.col("path")), "path", "conflict"),
            row(migrations.where(~F.col("filename").rlike(MIGRATION)), "error", "naming_convention", text("Invalid migration filename: ", F.col("filename")), "filename", "migration"),
            row(named, "warning", "naming_convention", text("Test file should use .test.ts or .spec.ts extension: ", F.col("path")), "path", "ending"),
            row(aliased, "warning", "path_alias", text("File in app/src/", F.col("top"), "/ but no standard path alias exists"), "path", "alias"),
            row(sizes.where("sources > 0 AND tests = 0"), "warning", "test_coverage", text("No test files specified for ", F.col("sources").cast("string"), " implementation file(s)"), None, "tests"),
            row(sizes.where("sources > 2 AND tests / sources < 0.5"), "warning", "test_coverage", text("Low test coverage ratio: ", F.col("tests").cast("string"), " tests for ", F.col("sources").cast("string"), " implementation files"), None, "more tests"),
            row(added.where(F.coalesce("version", F.lit("")) == ""), "warning", "dependency", text("No version specified for dependency: ", F.col("name")), "name", "version"),
            row(added.where(F.col("name").contains("mock") | F.col("name").contains("stub")), "warning", "dependency", text("Mocking library detected: ", F.col("name"), ". The project follows antimocking philosophy."), "name", "mocks"),
        ],
    )


def validate(specs: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each spec: valid, errors, warnings, approval_conditions, risk_assessment, summary."""
    found = issues(specs, files).groupBy("spec").agg(
        F.array_sort(F.collect_list(F.when(F.col("severity") == "error", F.struct("type", "message", "affected_resource", "suggested_fix")))).alias("errors"),
        F.array_sort(F.collect_list(F.when(F.col("severity") == "warning", F.struct("type", "message", "affected_resource", "suggested_fix")))).alias("warnings"),
    )
    rows = specs.join(found, "spec", "left")
    count = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    rows = rows.withColumns({"n_errors": count("errors"), "n_warnings": count("warnings"), "n_files": count("files_to_create") + count("files_to_modify"), "n_migrations": count("migrations"), "n_added": count("dependencies_to_add"), "breaking": F.coalesce("breaking_changes", F.lit(False)), "tested": F.coalesce(F.exists("files_to_create.path", _testy), F.lit(False))})
    c = F.col
    when = lambda holds, text, *args: F.when(holds, F.format_string(text, *args) if args else F.lit(text))
    conditions = F.array_compact(
        F.array(
            when(c("n_errors") > 0, CONDITIONS["errors"], c("n_errors")),
            *[when(c("n_migrations") > 0, CONDITIONS[k]) for k in ("schema", "migrations")],
            *[when(c("breaking"), CONDITIONS[k]) for k in ("document", "guide", "flag")],
            when(~c("tested"), CONDITIONS["tests"]),
            when(c("n_added") > 0, CONDITIONS["dependencies"], c("n_added")),
            F.lit(CONDITIONS["suite"]),
            F.lit(CONDITIONS["docs"]),
        )
    )
    factors = F.array_compact(
        F.array(
            when(c("n_errors") > 0, "%d blocking errors", c("n_errors")),
            when(c("n_warnings") > 3, "%d warnings", c("n_warnings")),
            when(c("breaking"), "breaking changes"),
            when(c("n_migrations") > 0, "%d database migrations", c("n_migrations")),
            when(c("n_files") > 20, "%d files affected", c("n_files")),
        )
    )
    named = F.array_join(factors, ", ")
    risk = (
        F.when(F.size(factors) == 0, F.lit("LOW RISK - Spec follows conventions and has no blocking issues"))
        .when((F.size(factors) >= 3) | c("breaking"), F.concat(F.lit("HIGH RISK - "), named, F.lit(". Requires careful review and testing.")))
        .otherwise(F.concat(F.lit("MEDIUM RISK - "), named, F.lit(". Standard review process recommended.")))
    )
    summary = F.concat_ws(
        " ",
        F.concat(F.lit("Validation for feature: "), c("feature_name"), F.lit(".")),
        F.when(c("n_errors") > 0, F.format_string("FAILED - %d error(s) must be fixed.", c("n_errors"))).otherwise("PASSED - No blocking errors."),
        when(c("n_warnings") > 0, "%d warning(s) for review.", c("n_warnings")),
        F.format_string("%d files planned.", c("n_files")),
        when(c("n_migrations") > 0, "%d migration(s) included.", c("n_migrations")),
    )
    return rows.select("spec", (c("n_errors") == 0).alias("valid"), "errors", "warnings", conditions.alias("approval_conditions"), risk.alias("risk_assessment"), summary.alias("summary"))


def expertise_files(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(name, kind, file_path, status) of expertise entries (name, kind, file_path): valid, stale or missing.

    A path fits any indexed path that ends in it, without regard to case; an entry without one is
    valid.
    """
    wanted = entries.where("file_path is not null").select("file_path", F.lower("file_path").alias("_low")).distinct()
    there = joined_by_suffix(files.select(F.lower("path").alias("_path")), "_path", wanted, "_low").select("file_path").distinct().withColumn("_there", F.lit(True))
    found = entries.join(there, "file_path", "left")
    status = F.when(F.col("file_path").isNull() | F.col("_there"), "valid").when(F.col("kind") == "key_file", "missing").otherwise("stale")
    return found.select("name", "kind", "file_path", status.alias("status"))


def expertise_age(entries: DataFrame, now, days: int = 180) -> DataFrame:
    """Entries (name, timestamp) with a status: stale beyond so many days, no-date without a timestamp."""
    old = F.datediff(F.lit(now).cast("timestamp"), "timestamp") > days
    return entries.withColumn("status", F.when(F.col("timestamp").isNull(), "no-date").when(old, "stale").otherwise("valid"))


def recent_patterns(patterns: DataFrame, now, days: int = 30, limit: int = 20, domain: str | None = None, repository_id: str | None = None) -> DataFrame:
    """The newest patterns of the last days, 1 to 365, of a domain by its prefix."""
    days, limit = max(1, min(365, days)), max(1, min(100, limit))
    found = patterns.where(F.col("created_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    if domain:
        found = found.where(F.col("pattern_type").ilike(f"{domain}:%"))
    if repository_id:
        found = found.where(F.col("repository_id") == repository_id)
    return found.orderBy(F.desc("created_at"), "id").limit(limit)


def new_patterns(entries: DataFrame, patterns: DataFrame, domain: str) -> DataFrame:
    """Expertise patterns (name, ...) whose type ``domain:name`` isn't known yet."""
    return entries.withColumn("pattern_type", F.concat(F.lit(f"{domain}:"), "name")).join(patterns.select("pattern_type").distinct(), "pattern_type", "left_anti")
