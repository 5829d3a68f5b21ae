"""Column functions on records: ids, hashes, JSON, masks, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of key names whose values are masked. A key is compared in lower case, so those with capitals never match.
SENSITIVE = [
    "apiKey",
    "api_key",
    "apikey",
    "token",
    "password",
    "secret",
    "authorization",
    "bearer",
    "key",
    "private_key",
    "privateKey",
    "client_secret",
    "clientSecret",
    "access_token",
    "accessToken",
    "refresh_token",
    "refreshToken",
    "session",
    "cookie",
]
MASK = "[REDACTED]"

# Reference type to usage type; others stay as they are.
USAGE_TYPES = {
    "import": "import",
    "call": "call",
    "re_export": "re_export",
    "export_all": "re_export",
    "type_reference": "type_reference",
    "extends": "type_reference",
    "implements": "type_reference",
    "property_access": "property_access",
    "variable_reference": "variable_reference",
    "dynamic_import": "import",
}


def row_id(*keys: str | Column) -> Column:
    """The same id for the same keys, so that a task that runs again makes the same row."""
    return F.sha2(F.concat_ws("\u0001", *keys), 256)


def usage_type(reference_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in USAGE_TYPES.items() for x in kv]), reference_type), reference_type)


def masked(context: Column) -> Column:
    """A map of strings whose sensitive keys have masked values."""
    hidden = lambda k: F.exists(F.array(*[F.lit(s) for s in SENSITIVE]), lambda s: F.contains(F.lower(k), s))
    return F.transform_values(context, lambda k, v: F.when(hidden(k), F.lit(MASK)).otherwise(v))


def mask(context: dict) -> dict:
    """``masked`` for nested Python records."""
    hide = lambda k: any(s in k.lower() for s in SENSITIVE)
    return {k: MASK if hide(k) else mask(v) if isinstance(v, dict) else v for k, v in context.items()}


def format_duration(ms: Column) -> Column:
    seconds = ms / 1000
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.format_string("%.1f", F.pmod(seconds, F.lit(60))), F.lit("s"))
    return F.when(ms.isNull(), F.lit("-")).when(seconds >= 60, minutes).otherwise(F.format_string("%.1fs", seconds))


def format_cost(cost: Column) -> Column:
    return F.when(cost.isNull(), F.lit("-")).otherwise(F.format_string("$%.4f", cost.cast("double")))


def pad_column(value: Column, width: int) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 1), F.lit("…"))).otherwise(F.rpad(value, width, " "))


# The bold names of a report's fields, what stands where one is missing, the folder of specifications, and endings of files (".js" reads ".json" too).
FIELDS = {"domain": ("Domain", "github"), "requirements": ("Requirements", None), "issue_type": ("Type", "unknown")}
SPECS = "/docs/specs/"
ENDINGS = (".ts", ".js", ".md", ".yaml")


def _field(output: Column, name: str) -> Column:
    """What follows a bold field name and its colon, or null."""
    label = f"**{name}**:"
    at = F.locate(label, output)
    return F.when(at > 0, F.substring(output, at + len(label), F.length(output)))


def parse_analysis(output: Column) -> Column:
    """domain, requirements and issue_type of an agent's report: two fields are a word, one goes on to the next bold text."""
    out = []
    for field, (name, default) in FIELDS.items():
        rest = _field(output, name)
        value = F.regexp_replace(F.substring_index(rest, "**", 1), r"^\s+|\s+$", "") if default is None else F.get(F.filter(F.split(rest, r"\s+"), lambda w: w != ""), F.lit(0))
        out.append(F.coalesce(F.nullif(value, F.lit("")), output if default is None else F.lit(default)).alias(field))
    return F.struct(*out)


def _end(text: Column, part: str) -> Column:
    """The offset behind the last place of a part, 0 without one."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at + 1).otherwise(0)


def _absolute(output: Column) -> Column:
    """The words of a text that hold a slash, from it on."""
    return F.transform(F.filter(F.split(output, r"\s+"), lambda w: F.contains(w, F.lit("/"))), lambda w: F.substring(w, F.locate("/", w), F.length(w)))


def spec_path(output: Column) -> Column:
    """The first absolute path of a specification, or null."""
    cut = F.transform(_absolute(output), lambda w: F.substring(w, F.lit(1), _end(w, ".md")))
    return F.get(F.filter(cut, lambda w: F.substring(w, F.lit(3), F.length(w) - 6).contains(SPECS)), F.lit(0))


def file_paths(output: Column) -> Column:
    """The different absolute paths with one of ENDINGS, in order; a word goes up to its last ending."""
    cut = F.transform(_absolute(output), lambda w: F.substring(w, F.lit(1), F.greatest(*[_end(w, e) for e in ENDINGS])))
    long = lambda w: F.length(w) > F.when(w.endswith(".yaml"), 6).otherwise(4)
    return F.array_distinct(F.filter(cut, long))


def migration_version(filename: Column) -> Column:
    """The number that a migration's file name begins with, or null."""
    return F.nullif(F.regexp_extract(filename, r"^(\d+)_.+\.sql$", 1), F.lit("")).cast("int")
