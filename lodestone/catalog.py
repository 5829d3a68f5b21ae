"""The tables: schemas, keys, checks and versions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """A table: its schema, keys that are unique, what refers to what, and allowed values."""

    schema: str
    unique: tuple[tuple[str, ...], ...] = (("id",),)
    cascade: dict[str, str] = field(default_factory=dict)
    set_null: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()  # files hold ranges of these, so that a reader skips the others

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", self.schema)]


# The names of kinds, types, scopes and phases that rows may have.
SYMBOL_KINDS = ("function", "class", "interface", "type", "variable", "constant", "method", "property", "module", "namespace", "enum", "enum_member")
REFERENCE_TYPES = ("import", "re_export", "export_all", "dynamic_import", "call", "extends", "implements", "property_access", "type_reference", "variable_reference")
DECISION_SCOPES = ("architecture", "pattern", "convention", "workaround")
INSIGHT_TYPES = ("discovery", "failure", "workaround")
PHASES = ("analysis", "plan", "build", "improve")

TABLES = {
    "repositories": Table("id string, name string, full_name string, git_url string, default_branch string, last_indexed_at timestamp, created_at timestamp, updated_at timestamp, metadata string", (("id",), ("full_name",)), required=("id", "name")),
    "indexed_files": Table("id string, repository_id string, path string, content string, language string, size_bytes bigint, content_hash string, indexed_at timestamp, metadata string", (("id",), ("repository_id", "path")), {"repository_id": "repositories"}, required=("id", "repository_id", "path")),
    "indexed_symbols": Table("id string, file_id string, repository_id string, name string, kind string, line_start int, line_end int, signature string, documentation string, metadata string, created_at timestamp", (("id",),), {"file_id": "indexed_files", "repository_id": "repositories"}, allowed={"kind": SYMBOL_KINDS}, required=("id", "file_id", "name")),
    "indexed_references": Table(
        "id string, file_id string, repository_id string, symbol_name string, target_symbol_id string, target_file_path string, line_number int, column_number int, reference_type string, metadata string, created_at timestamp",
        (("id",),), {"file_id": "indexed_files", "repository_id": "repositories"}, {"target_symbol_id": "indexed_symbols"}, {"reference_type": REFERENCE_TYPES}, ("id", "file_id", "symbol_name"),
    ),
    "file_postings": Table("token string, file_id string, column string, positions array<int>", (("token", "file_id", "column"),), {"file_id": "indexed_files"}, sort=("token", "file_id")),
    "file_lengths": Table("file_id string, dl bigint", (("file_id",),), {"file_id": "indexed_files"}),
    "symbol_grams": Table("gram string, symbol_id string", (("gram", "symbol_id"),), {"symbol_id": "indexed_symbols"}, sort=("gram", "symbol_id")),
    "projects": Table("id string, user_id string, org_id string, name string, description string, created_at timestamp, updated_at timestamp, metadata string", (("id",), ("user_id", "name"), ("org_id", "name")), required=("id", "name")),
    "project_repositories": Table("id string, project_id string, repository_id string, added_at timestamp", (("project_id", "repository_id"),), {"project_id": "projects", "repository_id": "repositories"}),
    "decisions": Table("id string, repository_id string, title string, context string, decision string, scope string, rationale string, alternatives array<string>, related_files array<string>, created_at timestamp, updated_at timestamp, metadata string", allowed={"scope": DECISION_SCOPES}),
    "failures": Table("id string, repository_id string, title string, problem string, approach string, failure_reason string, related_files array<string>, created_at timestamp, metadata string"),
    "patterns": Table("id string, repository_id string, pattern_type string, file_path string, description string, example string, created_at timestamp, metadata string"),
    "insights": Table("id string, session_id string, content string, insight_type string, related_file string, created_at timestamp, metadata string", allowed={"insight_type": INSIGHT_TYPES}),
    "workflow_contexts": Table("id bigint, workflow_id string, phase string, context_data string, created_at timestamp, updated_at timestamp", (("workflow_id", "phase"),), allowed={"phase": PHASES}),
    "agent_sessions": Table("id string, repository_id string, agent_type string, task_summary string, outcome string, files_modified array<string>, started_at timestamp, ended_at timestamp, metadata string"),
    "workflow_metrics": Table("id bigint, issue_number int, started_at timestamp, completed_at timestamp, success boolean, duration_ms bigint, input_tokens bigint, output_tokens bigint, total_cost_usd double, pr_url string, error_message string, session_id string"),
    "schema_migrations": Table("id bigint, name string, applied_at timestamp, checksum string", (("name",),)),
}

#: Tables that are exported, imported and deleted from by sync, parents first.
SYNCED = ("repositories", "indexed_files", "indexed_symbols", "indexed_references", "projects", "project_repositories")
#: Columns of full-text search.
TEXT_COLUMNS = {"indexed_files": ["path", "content"], "decisions": ["title", "context", "decision", "rationale"], "failures": ["title", "problem", "approach", "failure_reason"], "insights": ["content"]}


def checked(name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose values are allowed, and the rest."""
    fits = F.lit(True)
    for column, values in TABLES[name].allowed.items():
        fits = fits & (F.col(column).isNull() | F.col(column).isin(*values))
    return rows.where(fits), rows.where(~fits)


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    text: str

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


def parse_migration(filename: str, text: str) -> Migration | None:
    found = re.fullmatch(r"(\d+)_(.+)\.sql", filename)
    return Migration(int(found[1]), filename.removesuffix(".sql"), text) if found else None


def pending(files: dict[str, str], applied: dict[str, str | None]) -> tuple[list[Migration], list[str]]:
    """Migrations to apply, in order of their numbers, and the names of applied ones whose text has changed since."""
    known = sorted(filter(None, (parse_migration(f, t) for f, t in files.items())), key=lambda m: m.version)
    return [m for m in known if m.name not in applied], [m.name for m in known if applied.get(m.name) not in (None, m.checksum)]


def apply_migrations(store, files: dict[str, str], run: Callable[[Migration], None], now) -> tuple[list[str], list[str]]:
    """Run pending migrations in order, each recorded when it is done; the names applied, and those that have drifted.

    The first that fails ends the run, and what was applied before it stays.
    """
    rows = {r["name"]: r["checksum"] for r in store.table("schema_migrations").collect()}
    todo, drifted = pending(files, rows)
    done = []
    for migration in todo:
        run(migration)
        row = store.spark.range(1).select(F.lit(len(rows) + len(done) + 1).cast("long").alias("id"), F.lit(migration.name).alias("name"), F.lit(now).cast("timestamp").alias("applied_at"), F.lit(migration.checksum).alias("checksum"))
        store.update(lambda row=row: {"schema_migrations": store.table("schema_migrations").unionByName(row)})
        done.append(migration.name)
    return done, drifted
