"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "json": "json",
    "py": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "cpp": "cpp",
    "c": "c",
    "h": "c",
}


def normalize_path(path: Column) -> Column:
    """Forward slashes, without one leading slash and then one leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/", ""), r"^\./", "")


def detect_language(path: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.substring_index(path, ".", -1))), F.lit("unknown"))


def is_test_lax(path: Column, folders: bool = False) -> Column:
    """Any path with "test" or "spec" in it, in any place; so ``latest.ts`` counts as well."""
    found = path.contains("test") | path.contains("spec")
    return found | path.contains("__tests__") if folders else found


def is_test(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.") | path.contains("/tests/") | path.contains("/__tests__/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def purpose(path: Column) -> Column:
    """The last folder and the file name."""
    return F.substring_index(path, "/", -2)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(ts|tsx|js|jsx)$", "")


def _beside(path: Column) -> list[Column]:
    stem = without_extension(path)
    return [F.concat(stem, F.lit(x)) for x in (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")]


def impact_test_paths(path: Column) -> Column:
    """Where change impact looks for the tests of a source file."""
    name = without_extension(base_name(path))
    return F.array(*_beside(path), F.concat(F.lit("tests/"), name, F.lit(".test.ts")), F.concat(F.lit("__tests__/"), name, F.lit(".test.ts")))


def context_test_paths(path: Column) -> Column:
    """Where task context looks for the tests of a source file."""
    name, folder = without_extension(base_name(path)), F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    tests = F.concat(F.lit("tests/"), F.regexp_replace(path, r"\.(ts|tsx)$", ".test.ts"))
    return F.array(*_beside(path), F.concat(folder, F.lit("/__tests__/"), name, F.lit(".test.ts")), tests)


def join_relative(folder: Column, relative: Column) -> Column:
    """``folder/relative`` with ``.`` and ``..`` worked out; leading ``..`` that leave the root stay."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: (p != "") & (p != "."))
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
    walk = lambda done, p: F.when((p == "..") & up(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def like_any(path: Column, patterns: list[str]) -> Column:
    """SQL LIKE without regard to the case of A-Z, as a disjunction; no pattern fits nothing."""
    found = F.lit(False)
    for p in patterns:
        found = found | path.ilike(p)
    return found
