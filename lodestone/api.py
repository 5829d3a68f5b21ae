"""The engine: one method for each tool, over a store."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import purpose
from .operators import graph, tables, usages
from .operators.search import latest, recent
from .plans import context, impact, index, memory, validation
from .plans import search as searching
from .sources import code, jsonl
from .store import Store

# The tools and the tier of each.
TOOLS = {
    "search": "core",
    "index_repository": "core",
    "list_recent_files": "core",
    "search_dependencies": "core",
    "find_usages": "core",
    "analyze_change_impact": "core",
    "get_index_statistics": "core",
    "validate_implementation_spec": "expertise",
    "sync_export": "sync",
    "sync_import": "sync",
    "generate_task_context": "core",
    "record_decision": "memory",
    "record_failure": "memory",
    "record_insight": "memory",
    "get_domain_key_files": "expertise",
    "validate_expertise": "expertise",
    "sync_expertise": "expertise",
    "get_recent_patterns": "expertise",
}
TIERS = {"core": {"core"}, "default": {"core", "sync"}, "memory": {"core", "sync", "memory"}, "full": {"core", "sync", "memory", "expertise"}}


def tools(tier: str = "default") -> list[str]:
    """Tools of a tier; an unknown tier is the default one."""
    return [t for t, k in TOOLS.items() if k in TIERS.get(tier, TIERS["default"])]


def normalize_filters(filters: Any, repository: Any = None) -> searching.Filters:
    """Filters of a request; what has the wrong type is left out. ``repository`` finds an id by name."""
    f = filters if isinstance(filters, dict) else {}
    text = lambda k: f[k] if isinstance(f.get(k), str) and f[k] else None
    many = lambda k: [x for x in f[k] if isinstance(x, str)] if isinstance(f.get(k), list) else []
    found = repository(f["repository"]) if repository and text("repository") else None
    flag = f.get("exported_only") if isinstance(f.get("exported_only"), bool) else None
    return searching.Filters(found, text("glob"), many("exclude"), text("language"), many("symbol_kind"), flag, text("decision_scope"), text("pattern_type"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(UTC).replace(tzinfo=None)) -> None:
        self.spark, self.store, self.now = spark, Store(spark, root), clock

    def call(self, tool: str, **arguments: Any) -> Any:
        if tool not in TOOLS:
            raise ValueError(f"unknown tool: {tool}")
        return getattr(self, tool)(**arguments)

    def repository(self, name: str | None = None) -> str | None:
        return tables.resolve_repository(self.store.table("repositories"), name)

    def _edges(self, repository_id: str | None, types: tuple[str, ...] = graph.EDGE_TYPES) -> DataFrame:
        found = graph.edges_of(self.store.table("indexed_references"), self.store.table("indexed_files"), types)
        return (found.where(F.col("repository_id") == repository_id) if repository_id else found).select("src", "dst").distinct()

    def _files(self, repository_id: str | None) -> DataFrame:
        files = self.store.table("indexed_files")
        return files.where(F.col("repository_id") == repository_id) if repository_id else files

    def search(self, query: str, scope: list[str] | None = None, filters: dict | None = None, limit: int | None = None, output: str | None = None, context_lines: int = 3, seen_tips: list[str] | None = None) -> dict:
        if not isinstance(query, str):
            raise ValueError("query must be a string")
        if output is not None and output not in searching.FORMS:
            raise ValueError(f"output must be one of: {', '.join(searching.FORMS)}")
        names = ("indexed_files", "indexed_symbols", "decisions", "patterns", "failures")
        return searching.response(self.store.tables(*names) | self.store.postings() | self.store.grams(), query, scope, normalize_filters(filters, self.repository), limit, output, context_lines, seen_tips)

    def index_repository(self, local_path: str, repository: str | None = None) -> dict:
        return index.index_repository(self.spark, self.store, local_path, self.now(), repository)

    def list_recent_files(self, limit: int = 10, repository: str | None = None) -> list[dict]:
        rows = recent(self._files(self.repository(repository) if repository else None), "indexed_at", limit, ["path"])
        return [r.asDict() for r in rows.select("path", "language", "indexed_at").collect()]

    def search_dependencies(self, file_path: str, direction: str = "both", depth: int = 1, include_tests: bool = True, reference_types: list[str] | None = None, repository: str | None = None) -> dict:
        if direction not in ("both", "dependents", "dependencies"):
            raise ValueError("direction must be both, dependents or dependencies")
        if not 1 <= depth <= graph.MAX_DEPTH:
            raise ValueError(f"depth must be 1 to {graph.MAX_DEPTH}")
        ident = self.repository(repository)
        edges, roots = self._edges(ident, tuple(reference_types or graph.EDGE_TYPES)), self.spark.createDataFrame([(file_path,)], "root string")
        out: dict[str, Any] = {"file_path": file_path, "direction": direction, "depth": depth}
        for name, along, tests in (("dependents", edges, include_tests), ("dependencies", graph.reverse(edges), True)):
            if direction in ("both", name):
                row = graph.dependency_result(along, roots, depth, tests).first()
                out[name] = {"direct": row.direct, "indirect": row.indirect, "cycles": row.cycles, "count": len(row.direct) + sum(map(len, row.indirect.values()))}
        if "dependencies" in out:
            own = self._files(ident).where(F.col("path") == file_path).select(F.col("id").alias("file_id"))
            lost = graph.unresolved(self.store.table("indexed_references").join(own, "file_id", "left_semi"))
            out["unresolved_imports"] = sorted(r.source for r in lost.collect())
        return out

    def find_usages(self, symbol: str, file: str | None = None, include_definitions: bool = False, include_tests: bool = True, repository: str | None = None) -> dict:
        wanted = self.spark.createDataFrame([(self.repository(repository), symbol, file)], "repository_id string, name string, path string")
        own = self.store.tables("indexed_symbols", "indexed_references", "indexed_files")
        found = usages.find_usages(own["indexed_symbols"], own["indexed_references"], own["indexed_files"], wanted, include_definitions, include_tests)
        where = usages.definitions(own["indexed_symbols"], own["indexed_files"], wanted).first()
        rows = found.select("file", "line", "column", "usage_type", "context").orderBy("file", "line", "column").collect()
        return {"symbol": symbol, "defined_in": f"{where.def_path}:{where.line_start}" if where else "unknown", "kind": where.kind if where else "unknown", "usages": [r.asDict() for r in rows], "total_usages": len(rows), "files_with_usages": len({r.file for r in rows})}

    def analyze_change_impact(self, change_type: str, description: str = "", files_to_modify: list[str] | None = None, files_to_create: list[str] | None = None, files_to_delete: list[str] | None = None, breaking_changes: bool = False, repository: str | None = None) -> dict:
        ident = self.repository(repository)
        schema = "request string, change_type string, breaking_changes boolean, files_to_modify array<string>, files_to_create array<string>, files_to_delete array<string>"
        request = self.spark.createDataFrame([("r", change_type, breaking_changes, files_to_modify, files_to_create, files_to_delete)], schema)
        files = self._files(ident)
        row = impact.analyze(request, self._edges(ident), files).first().asDict(recursive=True)
        row.pop("request")
        return row | {"last_indexed_at": files.agg(F.max("indexed_at").alias("t")).first().t}

    def get_index_statistics(self) -> dict:
        names = ["repositories", "indexed_files", "indexed_symbols", "indexed_references", "decisions", "patterns", "failures"]
        row = tables.statistics(self.store.tables(*names), names).first().asDict()
        return row | {"summary": f"{row['indexed_files']} files, {row['indexed_symbols']} symbols and {row['indexed_references']} references in {row['repositories']} repositories"}

    def validate_implementation_spec(self, feature_name: str, files_to_create: list[dict] | None = None, files_to_modify: list[dict] | None = None, migrations: list[dict] | None = None, dependencies_to_add: list[dict] | None = None, breaking_changes: bool = False, repository: str | None = None) -> dict:
        paths = lambda xs: [(x["path"],) for x in xs or []]
        row = ("s", feature_name, paths(files_to_create), paths(files_to_modify), [(m["filename"],) for m in migrations or []], [(d["name"], d.get("version")) for d in dependencies_to_add or []], breaking_changes)
        spec = self.spark.createDataFrame([row], f"spec string, {validation.SPEC}")
        out = validation.validate(spec, self._files(self.repository(repository))).first().asDict(recursive=True)
        out.pop("spec")
        return out | {k: out[k] or [] for k in ("errors", "warnings")}

    def sync_export(self, folder: str, force: bool = False) -> dict[str, str]:
        return jsonl.export_all(self.spark, self.store.tables(*jsonl.SYNCED), folder, force)

    def sync_import(self, folder: str) -> dict[str, int]:
        return index.import_folder(self.spark, self.store, folder)

    def generate_task_context(self, files: list[str], max_impacted_files: int = 20, repository: str | None = None) -> dict:
        ident = self.repository(repository)
        asked = self.spark.createDataFrame(list(enumerate(files)), "ord int, path string")
        own = self._files(ident)
        rows = context.task_context(asked, own, self.store.table("indexed_symbols"), self._edges(ident), max_impacted_files).orderBy("ord").drop("ord").collect()
        changed = context.recent_changes(own, self.now()).collect()
        return {"files": [r.asDict(recursive=True) for r in rows], "recent_changes": [r.asDict() for r in changed], "stale": context.is_stale(own, self.now()).first().stale}

    def _record(self, table: str, repository: str | None, values: dict) -> str:
        row = memory.record(self.spark, table, values, self.now(), self.repository(repository) if repository else None)
        ident = row.first().id
        self.store.update(lambda: {table: tables.upsert(self.store.table(table), row, ["id"])})
        return ident

    def record_decision(self, repository: str | None = None, **values: Any) -> str:
        return self._record("decisions", repository, values)

    def record_failure(self, repository: str | None = None, **values: Any) -> str:
        return self._record("failures", repository, values)

    def record_insight(self, **values: Any) -> str:
        return self._record("insights", None, values)

    def get_domain_key_files(self, domain: str, limit: int = 10, repository: str | None = None) -> list[dict]:
        found = graph.domain_key_files(self._edges(self.repository(repository) if repository else None), domain, limit)
        return [r.asDict() for r in found.select(F.col("dst").alias("path"), "dependents", purpose(F.col("dst")).alias("purpose")).collect()]

    def validate_expertise(self, domain: str, expertise_path: str | None = None, repository: str | None = None) -> dict:
        entries, error = code.read_expertise(self.spark, expertise_path or f".claude/agents/experts/{domain}/expertise.yaml")
        if entries is None:
            return {"domain": domain, "valid": False, "error": error, "valid_patterns": [], "stale_patterns": [], "missing_key_files": [], "summary": {"total": 0, "valid": 0, "stale": 0}}
        rows = validation.expertise_files(entries, self._files(self.repository(repository) if repository else None)).orderBy("name").collect()
        of = lambda kind, status: [r for r in rows if r.kind == kind and r.status == status]
        good, stale, missing = of("pattern", "valid"), of("pattern", "stale"), of("key_file", "missing")
        return {
            "domain": domain, "valid": not stale and not missing, "valid_patterns": [{"name": r.name, **({"file_path": r.file_path} if r.file_path else {})} for r in good],
            "stale_patterns": [{"name": r.name, "reason": f"File not found: {r.file_path}"} for r in stale], "missing_key_files": [r.file_path for r in missing], "summary": {"total": len(good) + len(stale), "valid": len(good), "stale": len(stale)},
        }

    def sync_expertise(self, domain: str, expertise_path: str | None = None, dry_run: bool = False) -> dict:
        entries, error = code.read_expertise(self.spark, expertise_path or f".claude/agents/experts/{domain}/expertise.yaml")
        if entries is None:
            return {"domain": domain, "synced": 0, "error": error}
        latest_of = latest(entries.where("kind = 'pattern'"), ["name"], ["file_path"])
        shaped = lambda new: new.select(F.sha2("pattern_type", 256).alias("id"), F.lit(None).cast("string").alias("repository_id"), "pattern_type", "file_path", F.coalesce("description", "name").alias("description"), F.lit(None).cast("string").alias("example"), F.lit(self.now()).cast("timestamp").alias("created_at"), F.lit("{}").alias("metadata"))
        of = lambda old: shaped(validation.new_patterns(latest_of, old, domain))
        count = of(self.store.table("patterns")).count()
        if not dry_run and count:
            self.store.update(lambda: {"patterns": (old := self.store.table("patterns")).unionByName(of(old))})
        return {"domain": domain, "synced": count, "dry_run": dry_run}

    def get_recent_patterns(self, days: int = 30, limit: int = 20, domain: str | None = None, repository: str | None = None) -> list[dict]:
        found = validation.recent_patterns(self.store.table("patterns"), self.now(), days, limit, domain, self.repository(repository) if repository else None)
        return [r.asDict() for r in found.collect()]
