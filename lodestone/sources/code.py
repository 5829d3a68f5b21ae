"""Source trees: files, their changes, and the configuration beside them."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path, PurePosixPath

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dependencies
from ..operators.resolve import Aliases
from ..operators.tables import changed_by_time

# Folders that are never read, and the extensions that are.
IGNORED = [
    ".git",
    "node_modules",
    "vendor",
    "build",
    "dist",
    "out",
    "target",
    ".angular",
    ".cache",
    ".next",
    ".nuxt",
    ".nx",
    ".output",
    ".parcel-cache",
    ".svelte-kit",
    ".turbo",
    ".vercel",
    ".vite",
    "coverage",
    "__pycache__",
    ".pytest_cache",
    "venv",
    ".venv",
    "env",
]
EXTENSIONS = ["ts", "tsx", "js", "jsx", "cjs", "mjs", "json", "sql"]
MAX_CONFIG_DEPTH, MAX_EXTENDS = 3, 10


def supported(path):
    """Whether a relative path is read: its extension, in any case, and none of its folders ignored."""
    folders = "|".join(x.replace(".", r"\.") for x in IGNORED)
    return path.rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$") & ~path.rlike(rf"(^|/)({folders})/")


def crawl(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, dependencies, modified_at) of a source tree, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.expr(f"substring(path, {len(base) + 2})")
    files = raw.select(path.alias("path"), F.expr("try_validate_utf8(CAST(content AS STRING))").alias("content"), F.col("modificationTime").alias("modified_at")).where(supported(F.col("path")) & F.col("content").isNotNull())
    found = F.when(F.lower("path").endswith(".sql"), F.array().cast("array<string>")).otherwise(dependencies(F.col("content")))
    return files.select("path", "content", found.alias("dependencies"), "modified_at")


def _git(root: str, *arguments: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else None


def changed_by_git(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame | None:
    """(path, status) of what git has changed since ``base`` and of untracked files; None where git fails."""
    diff, status = _git(root, "diff", "--name-status", "--no-renames", base), _git(root, "status", "--porcelain", "--untracked-files=all")
    if diff is None or status is None:
        return None
    found = {}
    for line in diff.splitlines():
        mark, _, path = line.partition("\t")
        found[path] = {"A": "added", "D": "deleted"}.get(mark[:1], "modified")
    for line in status.splitlines():
        if line.startswith("?? "):
            found.setdefault(line[3:].strip('"'), "added")
    return spark.createDataFrame(sorted(found.items()), "path string, status string").where(supported(F.col("path")))


def detect_changes(spark: SparkSession, root: str, indexed: DataFrame, use_git: bool | None = None, base: str = "HEAD") -> DataFrame:
    """(path, status), by git where there is a repository, and by times where not or where git fails."""
    if use_git if use_git is not None else Path(root, ".git").is_dir():
        by_git = changed_by_git(spark, root, base)
        if by_git is not None:
            return by_git
    return changed_by_time(indexed, crawl(spark, root))


def current_revision(root: str) -> str | None:
    found = _git(root, "rev-parse", "HEAD")
    return found.strip() if found else None


def default_branch(root: str) -> str:
    """The remote's head, else the current branch, else main or master."""
    remote = _git(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD")
    if remote:
        return remote.strip().partition("/")[2]
    current = _git(root, "branch", "--show-current")
    if current and current.strip():
        return current.strip()
    return "master" if _git(root, "rev-parse", "--verify", "master") else "main"


def prepare_repository(root: str | None) -> dict:
    if not root or not Path(root).is_dir():
        raise ValueError("a local path is needed")
    return {"path": str(Path(root).resolve()), "branch": default_branch(root), "revision": current_revision(root), "full_name": f"local/{Path(root).resolve().name}"}


def _options(path: Path, depth: int = 0) -> dict | None:
    """Compiler options of a tsconfig and of what it extends; its own paths go before."""
    try:
        config = json.loads(path.read_text())
    except (OSError, ValueError):
        return None
    options = config.get("compilerOptions") or {}
    if (parent := config.get("extends")) and depth < MAX_EXTENDS:
        other = (path.parent / parent).with_suffix(".json") if not parent.endswith(".json") else path.parent / parent
        above = _options(other, depth + 1) or {}
        options = above | options | {"paths": (above.get("paths") or {}) | (options.get("paths") or {})}
    return options


def find_aliases(root: str) -> Aliases | None:
    """The aliases of the first tsconfig or jsconfig that has paths: the root's, then those of folders, level by level."""
    folders = [Path(root)]
    for _ in range(MAX_CONFIG_DEPTH + 1):
        for folder in folders:
            for name in ("tsconfig.json", "jsconfig.json"):
                options = _options(folder / name)
                if options and options.get("paths"):
                    at = PurePosixPath(folder.relative_to(root)).as_posix()
                    return Aliases(options.get("baseUrl", "."), options["paths"], "" if at == "." else at)
        folders = sorted(x for f in folders for x in f.iterdir() if x.is_dir() and x.name not in IGNORED and not x.name.startswith("."))
    return None


def read_expertise(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """(name, kind, file_path, description, timestamp) of an expertise file, or what is wrong with it."""
    try:
        data = yaml.safe_load(Path(path).read_text()) or {}
    except OSError:
        return None, f"Expertise file not found: {path}"
    except yaml.YAMLError as e:
        return None, f"Failed to parse expertise.yaml: {e}"
    rows = [(name, "pattern", (p or {}).get("file_path"), (p or {}).get("description"), str(t) if (t := (p or {}).get("timestamp")) else None) for name, p in (data.get("patterns") or {}).items()]
    rows += [(k["path"], "key_file", k["path"], None, None) for k in (data.get("core_implementation") or {}).get("key_files") or [] if k.get("path")]
    out = spark.createDataFrame(rows, "name string, kind string, file_path string, description string, timestamp string")
    return out.withColumn("timestamp", F.try_to_timestamp("timestamp")), None


def project_root(path: str, most: int = 10) -> str:
    """The nearest folder above a file that has a package, a tsconfig or a git folder; else the path's first folder."""
    folder = PurePosixPath(path).parent
    for at in [folder, *folder.parents][:most]:
        if any(Path(at, marker).exists() for marker in ("package.json", "tsconfig.json", ".git")):
            return str(at)
    parts = PurePosixPath(path).parts
    return f"/{parts[1]}" if path.startswith("/") and len(parts) > 1 else str(folder)
