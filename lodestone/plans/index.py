"""Indexing: a whole tree, changed files, and what watchers hand over."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TEXT_COLUMNS
from ..functions.paths import normalize_path
from ..operators import extract, resolve, search, tables
from ..operators.graph import EDGE_TYPES
from ..sources import code, jsonl
from ..staging import discard, staged
from ..store import Store

POSTINGS = ("file_postings", "file_lengths")
INDEX = ("repositories", "indexed_files", "indexed_symbols", "indexed_references")


def _located(found: DataFrame, files: DataFrame, aliases: DataFrame | None, repository_id: str, compatible: bool) -> DataFrame:
    """References with ``target_file_path``: of every reference to a module, or of imports only when compatible."""
    kinds = ["import"] if compatible else [*EDGE_TYPES, "dynamic_import"]
    source = F.when(F.col("reference_type").isin(kinds), F.col("metadata")["importSource"])
    asked = found.select("*", F.lit(repository_id).alias("repository_id"), source.alias("source"), F.col("path").alias("from_path"))
    return resolve.resolve_imports(asked, files, aliases).drop("repository_id", "source", "from_path")


def index_files(store: Store, repository_id: str, files: DataFrame, now, aliases: DataFrame | None = None, gone: DataFrame | None = None, sweep: bool = False, compatible: bool = False, kept: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """The index tables after (path, content, dependencies) were read again and the paths ``gone`` deleted.

    Symbols and references of the files are replaced, imports are resolved against all files. With
    ``sweep`` files of the repository that weren't read are removed. Files are parsed once, into a checkpoint, which
    is added to ``kept`` for the caller to discard when the tables are written.
    """
    ready = store.postings()
    old = store.tables(*INDEX) | (ready or {n: store.table(n).limit(0) for n in POSTINGS})
    rows = tables.file_rows(files, repository_id, now)
    if sweep:
        gone = old["indexed_files"].where(F.col("repository_id") == repository_id).join(rows.select("path"), "path", "left_anti").select("path")
    if gone is not None:
        old, _ = tables.delete_files(old, repository_id, gone)
    known = tables.upsert(old["indexed_files"], rows, ["repository_id", "path"])
    read = files.select(normalize_path(F.col("path")).alias("path"), "content")
    parsed = staged(extract.parsed(read, ("symbols", "references")))
    if kept is not None:
        kept.append(parsed)
    symbols = tables.replace_for(old["indexed_symbols"], tables.symbol_rows(extract.rows_of(parsed, "symbols"), known, repository_id, now), "file_id", rows.select(F.col("id").alias("file_id")))
    found = _located(extract.rows_of(parsed, "references"), known, aliases, repository_id, compatible)
    references = tables.replace_for(old["indexed_references"], tables.reference_rows(found, known, symbols, repository_id, now), "file_id", rows.select(F.col("id").alias("file_id")))
    # grams of the names that are new, or of all where there are none that hold
    grams = store.grams()
    new = symbols.join(rows.select(F.col("id").alias("file_id")), "file_id", "left_semi") if grams else symbols
    of_names = search.name_grams(new)
    if grams:
        stay = symbols.join(rows.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(F.col("id").alias("symbol_id"))
        of_names = grams["symbol_grams"].join(stay, "symbol_id", "left_semi").unionByName(of_names)
    # the postings of what was read again, or of all files where there are none that hold
    texts = known.join(rows.select("id"), "id", "left_semi") if ready else known
    ids = texts.select(F.col("id").alias("file_id"))
    made = search.postings(texts, "id", TEXT_COLUMNS["indexed_files"]).withColumnRenamed("key", "file_id")
    sizes = search.lengths(texts, "id", TEXT_COLUMNS["indexed_files"]).withColumnRenamed("key", "file_id")
    return {
        "indexed_files": known, "indexed_symbols": symbols, "indexed_references": references,
        "file_postings": tables.replace_for(old["file_postings"], made, "file_id", ids), "file_lengths": tables.replace_for(old["file_lengths"], sizes, "file_id", ids),
        "symbol_grams": of_names,
    }


def index_repository(spark: SparkSession, store: Store, root: str, now, full_name: str | None = None, sweep: bool = True) -> dict:
    """Index a source tree; counts of what the repository now has."""
    place = code.prepare_repository(root)
    aliases = code.find_aliases(root)
    ident = tables.ensure_repository(store.table("repositories"), full_name or place["full_name"], now, branch=place["branch"])[1]

    kept: list[DataFrame] = []

    def change() -> dict[str, DataFrame]:
        repositories, _ = tables.ensure_repository(store.table("repositories"), full_name or place["full_name"], now, branch=place["branch"])
        changed = index_files(store, ident, code.crawl(spark, root), now, aliases.table(spark) if aliases else None, sweep=sweep, kept=kept)
        return changed | {"repositories": tables.touch(repositories, "id", ident, "last_indexed_at", now)}

    store.update(change)
    for rows in kept:
        discard(rows)
    counts = {n: store.table(n).where(F.col("repository_id") == ident).count() for n in INDEX[1:]}
    return {"repository_id": ident, **counts}


def handle_changes(spark: SparkSession, store: Store, root: str, repository_id: str, now: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """A handler for ``streaming.watch.watch``: deletes first, then reads each changed file again."""

    def handle(events: DataFrame, batch: int) -> None:
        changed = [r.path for r in events.where("type <> 'delete'").collect()]  # file events of one batch of a watcher
        gone = events.where("type = 'delete'").select("path")
        texts = []
        for path in changed:
            try:
                texts.append((path, Path(root, path).read_text()))
            except (OSError, UnicodeDecodeError):
                continue
        from ..functions.text import dependencies

        files = spark.createDataFrame(texts, "path string, content string").select("*", dependencies(F.col("content")).alias("dependencies"))
        aliases = code.find_aliases(root)
        kept: list[DataFrame] = []
        store.update(lambda: index_files(store, repository_id, files, now(), aliases.table(spark) if aliases else None, gone, kept=kept))
        for rows in kept:
            discard(rows)

    return handle


def handle_sync(spark: SparkSession, store: Store, folder: str) -> Callable[[DataFrame, int], None]:
    """A handler that imports the sync folder and applies its deletions again afterwards."""

    def handle(lines: DataFrame, batch: int) -> None:
        if lines.limit(1).count():
            import_folder(spark, store, folder)

    return handle


def import_folder(spark: SparkSession, store: Store, folder: str) -> dict[str, int]:
    def change() -> dict[str, DataFrame]:
        changed = jsonl.import_all(spark, folder, store.tables(*jsonl.SYNCED))
        entries = jsonl.load_manifest(spark, f"{folder}/{jsonl.MANIFEST}")
        return changed if entries is None else tables.apply_deletions(changed, entries)[0]

    store.update(change)
    return {n: store.table(n).count() for n in jsonl.SYNCED if store.exists(n)}


def is_indexed(store: Store, repository_id: str) -> bool:
    return not store.table("indexed_files").where(F.col("repository_id") == repository_id).limit(1).isEmpty()


def ensure_indexed(spark: SparkSession, store: Store, root: str, now) -> dict:
    """Index the repository that a folder belongs to, unless it is; ``local/<name>`` where git has one."""
    at = Path(root).resolve()
    top = next((p for p in (at, *at.parents) if (p / ".git").exists()), at)
    found = tables.resolve_repository(store.table("repositories"), f"local/{top.name}")
    if found and is_indexed(store, found):
        return {"repository_id": found, "indexed": False}
    return index_repository(spark, store, str(top), now) | {"indexed": True}
