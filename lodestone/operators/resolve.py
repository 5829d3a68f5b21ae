"""Imports to files: relative paths, extensions, index files and path aliases, as one join."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import folder_of, join_relative
from ..functions.text import let
from .fingerprints import joined_by_prefix

# Extensions and index files in the order in which they are tried, and what an import's extension may stand for.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]
INDEX_FILES = ["index.ts", "index.tsx", "index.js", "index.jsx"]
SUBSTITUTED = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}


@dataclass
class Aliases:
    """The ``paths`` of a tsconfig: pattern to templates, in order."""

    base: str = "."
    paths: dict[str, list[str]] = field(default_factory=dict)
    folder: str = ""

    def rows(self) -> list[tuple[str, str, bool, str, int]]:
        """(prefix, suffix, wildcard, template, order); a pattern that begins with ``*`` is left out."""
        out = []
        for pattern, templates in self.paths.items():
            prefix, star, suffix = pattern.partition("*")
            if star and not prefix:
                continue
            for t in templates:
                out.append((prefix, suffix.partition("*")[0], bool(star), str(PurePosixPath(self.folder, self.base, t)), len(out)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "prefix string, suffix string, wildcard boolean, template string, ord int")


def _with_extensions(path: Column) -> Column:
    return F.array(*[F.concat(path, F.lit(e)) for e in EXTENSIONS], *[F.concat(path, F.lit(f"/{i}")) for i in INDEX_FILES])


def relative_candidates(source: Column, from_path: Column) -> Column:
    """The paths that a relative import may mean, best first."""

    def choices(path: Column) -> Column:
        out = _with_extensions(path)
        for e in reversed(EXTENSIONS):
            exact = [path] + ([F.concat(F.regexp_replace(path, rf"\{e}$", ""), F.lit(SUBSTITUTED[e]))] if e in SUBSTITUTED else [])
            out = F.when(F.endswith(path, F.lit(e)), F.array(*exact)).otherwise(out)
        return out

    return let(join_relative(folder_of(from_path), source), choices)


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows of ``imports`` (repository_id, source, from_path, ...) with ``target_file_path``, or null.

    All candidates of all imports meet the files in one join by repository and path; the best that
    is there wins. An import meets the aliases by its beginnings of the lengths that their prefixes have.
    Files and imports are never broadcast, however few bytes they have on disk: coded columns
    make a table of millions of paths look small, and the driver would hold all of them.
    """
    key = ["repository_id", "source", "from_path"]
    # so many tasks, as paths are few bytes but much work
    asked = imports.select(*key).repartition(int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).distinct()
    candidates = asked.where(F.col("source").startswith(".")).select(*key, F.posexplode(relative_candidates(F.col("source"), F.col("from_path"))).alias("at", "path"))
    if aliases is not None:
        fits = F.when(F.col("wildcard"), F.col("source").endswith(F.col("suffix"))).otherwise(F.col("source") == F.col("prefix"))
        star = F.expr("substring(source, length(prefix) + 1, length(source) - length(prefix) - length(suffix))")
        path = F.when(F.col("wildcard"), F.replace(F.col("template"), F.lit("*"), star)).otherwise(F.col("template"))
        mapped = joined_by_prefix(asked.where(~F.col("source").startswith(".")), "source", aliases, "prefix").where(fits).withColumn("_path", join_relative(F.lit(""), path))
        mapped = mapped.select(*key, "ord", F.posexplode(_with_extensions(F.col("_path"))).alias("k", "path")).select(*key, (F.col("ord") * 100 + F.col("k")).cast("int").alias("at"), "path")
        candidates = candidates.unionByName(mapped)
    there = files.select("repository_id", "path").distinct()
    best = candidates.join(there.hint("merge"), ["repository_id", "path"]).groupBy(*key).agg(F.min_by("path", "at").alias("target_file_path"))
    return imports.join(best.hint("merge"), key, "left")


def read_tsconfig(text: str, folder: str = "") -> Aliases | None:
    """Aliases of a tsconfig's text; comments or no ``paths`` give none."""
    try:
        options = json.loads(text).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return None
    return Aliases(options.get("baseUrl", "."), options["paths"], folder) if options.get("paths") else None
