"""Unified search: one table of results for each scope, output forms and tips."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import TEXT_COLUMNS
from ..functions.text import char_snippet, line_snippets
from ..operators.search import clamp_limit, postings_hits, search, search_symbols

SCOPES = ("code", "symbols", "decisions", "patterns", "failures")
FORMS = ("full", "paths", "compact", "snippet")


@dataclass
class Filters:
    repository_id: str | None = None
    glob: str | None = None
    exclude: list[str] = field(default_factory=list)
    language: str | None = None
    symbol_kind: list[str] = field(default_factory=list)
    exported_only: bool | None = None
    decision_scope: str | None = None
    pattern_type: str | None = None
    #: As the reference does: globs and languages are read and not applied.
    compatible: bool = True

    def active(self) -> bool:
        return bool(self.glob or self.language or self.repository_id or self.symbol_kind or self.exported_only is not None or self.decision_scope or self.pattern_type or self.exclude)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` is any folders, ``*`` stays in one."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    of = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(of.get(p, re.escape(p)) for p in parts) + "$"


def _repository(filters: Filters) -> Column:
    return F.lit(True) if filters.repository_id is None else F.col("repository_id") == filters.repository_id


def code(files: DataFrame, query: str, filters: Filters, limit: int | None = None, postings: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """The best files for a phrase, by their postings where there are any, and else by a scan of all texts."""
    shown = _repository(filters)
    if not filters.compatible:
        if filters.glob:
            shown = shown & F.col("path").rlike(glob_pattern(filters.glob))
        for g in filters.exclude:
            shown = shown & ~F.col("path").rlike(glob_pattern(g))
        if filters.language:
            shown = shown & (F.col("language") == filters.language)
    if postings is None or lengths is None:
        return search(files, TEXT_COLUMNS["indexed_files"], query, limit, shown, ["path", "id"])
    hits = postings_hits(postings.withColumnRenamed("file_id", "key"), lengths.withColumnRenamed("file_id", "key"), query).withColumnRenamed("key", "id")
    # the best are chosen without their texts; at most clamp_limit rows are broadcast
    best = files.join(hits, "id").where(shown).select("id", "tf", "dl", "score", "path").orderBy("score", "path", "id").limit(clamp_limit(limit)).drop("path")
    return files.join(F.broadcast(best), "id").select(*files.columns, "tf", "dl", "score").orderBy("score", "path", "id")


def search_code(files: DataFrame, query: str, filters: Filters | None = None, limit: int | None = None) -> DataFrame:
    """The older form of a code search: path and a snippet of characters."""
    return code(files, query, filters or Filters(), limit).select("path", char_snippet(F.col("content"), query).alias("snippet"), "score")


def memory(rows: DataFrame, columns: list[str], query: str, filters: Filters, limit: int | None = None) -> DataFrame:
    """Decisions or failures by phrase, with ``relevance``, the rank without its sign."""
    shown = _repository(filters)
    if filters.decision_scope and "scope" in rows.columns:
        shown = shown & (F.col("scope") == filters.decision_scope)
    return search(rows, columns, query, limit, shown, ["id"]).withColumn("relevance", F.abs("score"))


def patterns(rows: DataFrame, query: str, filters: Filters, limit: int | None = None, file: str | None = None) -> DataFrame:
    """The newest patterns; the query's text counts only when not compatible."""
    found = rows.where(_repository(filters))
    if filters.pattern_type:
        found = found.where(F.col("pattern_type") == filters.pattern_type)
    if file:
        found = found.where(F.col("file_path") == file)
    if not filters.compatible and query:
        found = found.where(F.col("description").ilike(f"%{query}%"))
    return found.orderBy(F.desc("created_at"), "id").limit(clamp_limit(limit))


def results(tables: dict[str, DataFrame], query: str, scopes: list[str] | None = None, filters: Filters | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """A lazy table for each scope; the limit is for each."""
    filters = filters or Filters()
    make = {
        "code": lambda: code(tables["indexed_files"], query, filters, limit, tables.get("file_postings"), tables.get("file_lengths")),
        "symbols": lambda: search_symbols(tables["indexed_symbols"], tables["indexed_files"], query, filters.symbol_kind, filters.exported_only or None, filters.repository_id, limit, tables.get("symbol_grams")),
        "decisions": lambda: memory(tables["decisions"], TEXT_COLUMNS["decisions"], query, filters, limit),
        "patterns": lambda: patterns(tables["patterns"], query, filters, limit),
        "failures": lambda: memory(tables["failures"], TEXT_COLUMNS["failures"], query, filters, limit),
    }
    unknown = set(scopes or []) - set(make)
    if unknown:
        raise ValueError(f"unknown scope: {', '.join(sorted(unknown))}")
    return {s: make[s]() for s in scopes or ["code"]}


COMPACT = {"code": ["path"], "symbols": ["name", "kind", "path"], "decisions": ["title", "scope"], "patterns": ["pattern_type", "file_path"], "failures": ["title", "problem"]}


def shaped(scope: str, rows: DataFrame, form: str, query: str, context: int = 3) -> DataFrame:
    """The columns of a form; snippets of other scopes than code are compact."""
    if form == "paths":
        path = next((c for c in ("path", "file_path") if c in rows.columns), None)
        return rows.select((F.coalesce(path, F.lit("unknown")) if path else F.lit("unknown")).alias("path"))
    if form == "snippet" and scope == "code":
        return rows.select("path", line_snippets(F.col("content"), query, context).alias("matches"))
    if form in ("compact", "snippet"):
        out = rows.select(*COMPACT[scope])
        return out.withColumn("match_count", F.lit(1)) if scope == "code" else out
    return rows


def default_form(scopes: list[str]) -> str:
    return "compact" if "code" in scopes else "full"


def tagged(found: dict[str, DataFrame]) -> DataFrame:
    """All scopes in one table: scope, title, path, score."""
    parts = []
    for scope, rows in found.items():
        title = next(c for c in ("title", "name", "pattern_type", "path") if c in rows.columns)
        path = next((c for c in ("path", "file_path") if c in rows.columns), None)
        parts.append(rows.select(F.lit(scope).alias("scope"), F.col(title).alias("title"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"), (F.col("score") if "score" in rows.columns else F.lit(None).cast("double")).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Words that call for a tip, and the tips.
STRUCTURES = ["function", "class", "interface", "type", "method", "component"]
TIPS = {
    "empty": "No results found. Try broader search terms or fewer filters.",
    "filtered": "Your search has active filters. Try removing some to broaden results.",
    "structure": "You searched for \"{query}\" in code. Try scope: ['symbols'] with filters: {{symbol_kind: ['{word}']}} for precise structural discovery.",
    "path": 'Query "{query}" looks like a file path. Consider using search_dependencies tool to find files that depend on this file or its dependencies.',
    "exported": "Found {n} symbols. Add filters: {{exported_only: true}} to narrow to public API only.",
    "repository": 'Found {n} results across all repositories. Add filters: {{repository: "owner/repo"}} to narrow to a specific repository.',
    "files": 'Found {n} code results. Try filters: {{glob: "**/*.ts"}} or {{language: "typescript"}} to narrow file types.',
    "why": "Query contains \"why/reason/decision\". Try scope: ['decisions'] to search architectural decisions and rationale.",
    "how": "Query asks \"how to\". Try scope: ['patterns'] to search coding patterns and conventions from this codebase.",
    "error": "Query mentions errors/issues. Try scope: ['failures'] to learn from past mistakes and avoid repeated failures.",
    "scopes": "Tip: You can search multiple scopes simultaneously. Try scope: ['code', 'symbols'] for broader discovery.",
    "compact": 'Returning {n} full results. Use output: "compact" for summary view or output: "paths" for file paths only.',
}
ASKS = {"why": (r"\b(why|reason|decision|chose|choice)\b", "decisions"), "how": (r"\b(how|pattern|best practice|convention)\b", "patterns"), "error": (r"\b(error|bug|fail|issue|problem|fix)\b", "failures")}
FILE_NAME = r"[\w\-./]+\.(ts|tsx|js|jsx|py|rs|go|java)"
MAX_TIPS = 2


def tips(query: str, scopes: list[str], filters: Filters, counts: dict[str, int], seen: list[str] | None = None) -> list[str]:
    """At most two tips, the urgent ones first; those seen before are left out afterwards."""
    total, found = sum(counts.values()), []
    word = next((w for w in STRUCTURES if w in query.lower()), None)
    rules = [
        (0, "empty", total == 0),
        (0, "filtered", total == 0 and filters.active()),
        (0, "structure", word is not None and "symbols" not in scopes),
        (0, "path", "code" in scopes and re.fullmatch(FILE_NAME, query, re.I) is not None),
        (1, "exported", "symbols" in scopes and filters.exported_only is None and counts.get("symbols", 0) > 10),
        (1, "repository", not filters.repository_id and total > 20),
        (1, "files", "code" in scopes and not filters.glob and not filters.language and counts.get("code", 0) > 15),
        *[(0, name, scope not in scopes and re.search(pattern, query, re.I) is not None) for name, (pattern, scope) in ASKS.items()],
        (2, "scopes", scopes == ["code"]),
        (2, "compact", total > 30),
    ]
    size = {"exported": counts.get("symbols", 0), "files": counts.get("code", 0)}
    for rank, name, holds in sorted(rules, key=lambda r: r[0]):
        if holds:
            found.append(TIPS[name].format(query=query, word=word, n=size.get(name, total)))
    return [t for t in found[:MAX_TIPS] if t not in (seen or [])]


def response(tables: dict[str, DataFrame], query: str, scopes: list[str] | None = None, filters: Filters | None = None, limit: int | None = None, form: str | None = None, context: int = 3, seen: list[str] | None = None) -> dict:
    """What a caller gets: results by scope, counts and tips. At most 100 rows a scope are collected."""
    scopes, filters = scopes or ["code"], filters or Filters()
    form = form or default_form(scopes)
    found = {s: [r.asDict(recursive=True) for r in shaped(s, rows, form, query, context).collect()] for s, rows in results(tables, query, scopes, filters, limit).items()}
    counts = {s: len(rows) for s, rows in found.items()}
    out = {"query": query, "scopes": scopes, "results": {s: [r["path"] for r in rows] if form == "paths" else rows for s, rows in found.items()}, "counts": {"total": sum(counts.values()), **counts}}
    return out | ({"tips": t} if (t := tips(query, scopes, filters, counts, seen)) else {})
