"""Small state of runs: checkpoints, manifests, events. Files of one driver, each written whole and renamed."""

from __future__ import annotations

import json
import os
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "issueNumber int, startedAt string, status string, durationMs bigint, costUsd double"


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_suffix(".tmp")
    temporary.write_text(text)
    os.replace(temporary, path)


def _read(path: Path):
    try:
        return json.loads(path.read_text())
    except (OSError, ValueError):
        return None


def write_checkpoint(folder: str, data: dict) -> None:
    _write(Path(folder, f"{data['issueNumber']}.json"), json.dumps(data, indent=2))


def read_checkpoint(folder: str, issue: int) -> dict | None:
    return _read(Path(folder, f"{issue}.json"))


def clear_checkpoint(folder: str, issue: int) -> None:
    Path(folder, f"{issue}.json").unlink(missing_ok=True)


def list_checkpoints(folder: str) -> list[dict]:
    """All that can be read."""
    return [x for p in sorted(Path(folder).glob("*.json")) if (x := _read(p)) is not None]


def read_manifest(path: str) -> list[dict]:
    return (_read(Path(path)) or {}).get("entries", [])


def update_manifest(path: str, entry: dict) -> list[dict]:
    """Merge an entry by issueNumber and startedAt."""
    key = lambda e: (e["issueNumber"], e["startedAt"])
    found = {key(e): e for e in read_manifest(path)}
    found[key(entry)] = found.get(key(entry), {}) | entry
    _write(Path(path), json.dumps({"entries": list(found.values())}))
    return list(found.values())


def manifest_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([tuple(e.get(c.split()[0]) for c in MANIFEST.split(", ")) for e in read_manifest(path)], MANIFEST)


def append_events(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").json(folder)


def workflow_id(issue: int, now: datetime) -> str:
    return f"adw-{issue}-{now.strftime('%Y-%m-%dT%H%M%S')}{now.microsecond // 1000:03d}"


def text_of_messages(messages: list[dict]) -> str:
    """The text blocks of an assistant's messages."""
    blocks = [b for m in messages if m.get("type") == "assistant" and isinstance(m["message"].get("content"), list) for b in m["message"]["content"]]
    return "\n\n".join(b["text"] for b in blocks if b.get("type") == "text")
