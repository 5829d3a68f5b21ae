"""Outputs against a small part of JSON Schema."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict}


def _errors(schema: dict, value: Any, path: str) -> list[tuple[str, str]]:
    kind, at = schema.get("type"), path or "root"
    if kind == "number":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return [(at, f"Expected number, received {_name(value)}")]
        out = [(at, f"Number must be at least {schema['minimum']}")] if "minimum" in schema and value < schema["minimum"] else []
        return out + ([(at, f"Number must be at most {schema['maximum']}")] if "maximum" in schema and value > schema["maximum"] else [])
    if kind not in _TYPES:
        return []
    if not isinstance(value, _TYPES[kind]):
        return [(at, f"Expected {kind}, received {_name(value)}")]
    if kind == "string":
        rules = [
            ("pattern" in schema and not re.search(schema.get("pattern", ""), value), f"Must match pattern: {schema.get('pattern')}"),
            (len(value) < schema.get("minLength", 0), f"String must have at least {schema.get('minLength')} characters"),
            (len(value) > schema.get("maxLength", len(value)), f"String must have at most {schema.get('maxLength')} characters"),
        ]
        return [(at, text) for broken, text in rules if broken]
    join = lambda k: f"{path}.{k}" if path else str(k)
    if kind == "array":
        return [e for i, v in enumerate(value) for e in _errors(schema.get("items") or {}, v, join(i))]
    out = []
    for key, inner in (schema.get("properties") or {}).items():
        if key in value:
            out += _errors(inner, value[key], join(key))
        elif key in (schema.get("required") or []):
            out.append((join(key), "Required"))
    return out


def _name(value: Any) -> str:
    return {type(None): "null", bool: "boolean", str: "string", list: "array", dict: "object"}.get(type(value), "number")


def validate_output(schema: dict, output: str) -> dict:
    """{valid} or {valid, errors: [{path, message}]}; objects and arrays are read as JSON."""
    value: Any = output
    try:
        if schema.get("type") in ("object", "array"):
            try:
                value = json.loads(output)
            except ValueError:
                return {"valid": False, "errors": [{"path": "root", "message": f"Expected JSON {schema['type']}, received non-JSON string"}]}
        found = _errors(schema, value, "")
    except (re.error, TypeError, AttributeError) as e:
        return {"valid": False, "errors": [{"path": "schema", "message": str(e)}]}
    return {"valid": False, "errors": [{"path": p, "message": m} for p, m in found]} if found else {"valid": True}


def is_valid(schema: dict, output: Column) -> Column:
    """Whether each output fits, in batches."""

    @F.arrow_udf("boolean")
    def run(outputs):
        import pyarrow as pa

        return pa.array([None if x is None else validate_output(schema, x)["valid"] for x in outputs.to_pylist()], pa.bool_())

    return run(output)


def file_path_output(extension: str | None = None) -> dict:
    return {"type": "string", "pattern": "^[^/]" if extension is None else rf"^[^/].*{extension.replace('.', chr(92) + '.')}$"}


def markdown_output(sections: list[str]) -> dict:
    return {"type": "string", "pattern": "^" + "".join(rf"(?=[\s\S]*{re.escape(s)})" for s in sections) + r"[\s\S]*$"}


def plain_text_output(min_length: int | None = None, max_length: int | None = None, pattern: str | None = None) -> dict:
    return {"type": "string"} | {k: v for k, v in (("minLength", min_length), ("maxLength", max_length), ("pattern", pattern)) if v is not None}
