"""What is recorded: decisions, failures, insights, patterns, workflow contexts and metrics."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import DECISION_SCOPES, INSIGHT_TYPES, PHASES, TABLES
from ..functions.records import row_id
from ..operators.fingerprints import contained
from ..operators.tables import upsert

REQUIRED = {"decisions": ("title", "context", "decision"), "failures": ("title", "problem", "approach", "failure_reason"), "insights": ("content", "insight_type")}
LISTS = ("alternatives", "related_files")
CHOICES = {"scope": DECISION_SCOPES, "insight_type": INSIGHT_TYPES}


def record(spark: SparkSession, table: str, values: dict[str, Any], now, repository_id: str | None = None) -> DataFrame:
    """One validated row; the same values at the same time have the same id."""
    values = dict(values)
    if table == "decisions":
        values["scope"] = values.get("scope") or "pattern"
    for name in REQUIRED[table]:
        if not isinstance(values.get(name), str):
            raise ValueError(f"Missing or invalid required parameter: {name}")
    for name, choices in CHOICES.items():
        if name in values and values[name] not in choices:
            raise ValueError(f"Parameter '{name}' must be one of: {', '.join(choices)}")
    for name in LISTS:
        if values.get(name) is not None and not isinstance(values[name], list):
            raise ValueError(f"Parameter '{name}' must be an array")
    schema, columns = TABLES[table].schema, TABLES[table].columns
    row = {c: values.get(c) for c in columns} | {"metadata": json.dumps(values.get("metadata") or {})}
    if "repository_id" in columns:
        row["repository_id"] = repository_id
    out = spark.createDataFrame([tuple(None if c in ("created_at", "updated_at") else row[c] for c in columns)], schema)
    stamped = out.withColumns({c: F.lit(now).cast("timestamp") for c in ("created_at", "updated_at") if c in columns})
    return stamped.withColumn("id", row_id(F.lit(table), F.to_json(F.struct(*[c for c in columns if c != "id"]))))


def sync_decisions(spark: SparkSession, decisions: DataFrame, domain: str, expertise: dict, now) -> DataFrame:
    """Decisions with those of an expertise file, by title and scope: operations are patterns, patterns are conventions."""
    rows = [(f"{domain}:{n}", "pattern", o.get("when") or "", o.get("approach") or o.get("pattern") or "", o.get("rationale") or "") for n, o in (expertise.get("key_operations") or {}).items()]
    rows += [(f"{domain}:pattern:{n}", "convention", "\n".join(p.get("notes") or []), p.get("structure") or "", None) for n, p in (expertise.get("patterns") or {}).items()]
    new = spark.createDataFrame(rows, "title string, scope string, context string, decision string, rationale string")
    old = decisions.select("title", "scope", F.col("id").alias("_id"), F.col("created_at").alias("_created"))
    stamp = F.lit(now).cast("timestamp")
    new = new.join(old, ["title", "scope"], "left").withColumns({"id": F.coalesce("_id", row_id("title", "scope")), "created_at": F.coalesce("_created", stamp), "updated_at": stamp})
    full = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(dict(decisions.dtypes)[c]).alias(c) for c in decisions.columns])
    return upsert(decisions, full, ["title", "scope"])


def sync_insights(spark: SparkSession, insights: DataFrame, domain: str, expertise: dict, now) -> DataFrame:
    """Insights with the known issues of an expertise file whose first fifty characters no insight contains."""
    rows = [(i["issue"][:50], f"[{domain}] {i['issue']}\nImpact: {i.get('impact') or 'Unknown'}\nStatus: {i.get('status') or 'Unknown'}\nResolution: {i.get('resolution') or 'None'}", "workaround" if i.get("status") == "resolved" else "discovery") for i in expertise.get("known_issues") or []]
    new = spark.createDataFrame(rows, "_key string, content string, insight_type string")
    known = contained(insights, "content", new, "_key")
    fresh = new.join(known, "_key", "left_anti").withColumns({"id": row_id("content"), "created_at": F.lit(now).cast("timestamp")})
    return insights.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(dict(insights.dtypes)[c]).alias(c) for c in insights.columns]))


def put_context(spark: SparkSession, contexts: DataFrame, workflow: str, phase: str, data: dict, now) -> DataFrame:
    if phase not in PHASES or data.get("phase", phase) != phase:
        raise ValueError(f"phase {phase!r} is unknown or not that of the data")
    stamp = F.lit(now).cast("timestamp")
    old = contexts.where((F.col("workflow_id") == workflow) & (F.col("phase") == phase)).select("id", "created_at").first()
    top = contexts.agg(F.max("id").alias("id")).first().id or 0
    row = spark.range(1).select(F.lit(old.id if old else top + 1).cast("long").alias("id"), F.lit(workflow).alias("workflow_id"), F.lit(phase).alias("phase"), F.lit(json.dumps(data)).alias("context_data"), (F.lit(old.created_at) if old else stamp).cast("timestamp").alias("created_at"), stamp.alias("updated_at"))
    return upsert(contexts, row, ["workflow_id", "phase"])


def clear_contexts(contexts: DataFrame, workflow: str) -> tuple[DataFrame, int]:
    gone = contexts.where(F.col("workflow_id") == workflow).count()
    return contexts.where(F.col("workflow_id") != workflow), gone


def add_metrics(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """Metrics of runs with ids that go on from the last."""
    top = metrics.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))
    new = rows.withColumn("id", F.row_number().over(Window.orderBy("started_at", "issue_number")).cast("long") + top.scalar())  # the runs of one batch
    return metrics.unionByName(new.select(*metrics.columns))
