"""Full text against the FTS of sqlite3, snippets and functions against plain Python."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, records, schemas, text
from lodestone.operators import search
from lodestone.plans.search import Filters, glob_pattern, tips

WORDS = ["alpha", "beta", "Gamma", "delta_x", "naïve", "a-b", "fooBar", "x"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, f"src/{rng.choice(WORDS)}/{i}.ts", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(100, "empty", ""), (101, "nul", None)]


def fts(corpus, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path, content)")
    db.executemany("insert into t(rowid, path, content) values (?, ?, ?)", corpus)
    phrase = '"' + query.replace('"', '""') + '"'
    return {r[0]: r[1] for r in db.execute("select rowid, bm25(t) from t where t match ? order by 2", (phrase,))}


@pytest.mark.parametrize("query", ["alpha", "beta gamma", "delta_x", "a-b", "naive", "x x", "alpha OR beta", "foobar", '"beta"', "src alpha", "nowhere", "AND NOT"])
def test_phrases_rank_as_fts5(spark, corpus, query):
    rows = spark.createDataFrame(corpus, "id long, path string, content string")
    want = fts(corpus, query)
    scanned = {r.id: r.score for r in search.phrase_hits(rows, ["path", "content"], query).collect()}
    assert scanned == pytest.approx(want, rel=1e-6)
    index, sizes = search.postings(rows, "id", ["path", "content"]), search.lengths(rows, "id", ["path", "content"])
    assert {r.key: r.score for r in search.search_postings(index, sizes, query, 100).collect()} == pytest.approx(want, rel=1e-6)


def test_many_phrases_at_once(spark, corpus):
    rows = spark.createDataFrame(corpus, "id long, path string, content string")
    queries = ["alpha", "beta gamma", "nowhere", "--"]
    found = search.search_many(rows, "id", ["path", "content"], queries, 100).collect()
    for q in queries:
        assert {r.key: r.score for r in found if r.query == q} == pytest.approx(fts(corpus, q) if q != "--" else {}, rel=1e-6)


def test_empty_query_and_limits(spark, corpus):
    rows = spark.createDataFrame(corpus, "id long, path string, content string")
    assert search.search(rows, ["content"], " -- ").count() == 0
    assert search.search(rows, ["content"], "alpha", 3, ties=["id"]).count() == 3
    assert [search.clamp_limit(x) for x in (None, 0, 5, 500)] == [20, 1, 5, 100]


def brute_snippets(content, needle, context):
    lines = content.split("\n")
    return [(i + 1, x, lines[max(0, i - context) : i], lines[i + 1 : i + 1 + context]) for i, x in enumerate(lines) if needle.lower() in x.lower()] if content and needle else []


@pytest.mark.parametrize("context", [0, 1, 3, 10])
def test_line_snippets(spark, context):
    texts = ["one\nTwo needle\nthree\nneedle\n", "needle", "", None, "no\nmatch", "ünï NEEDLE\n\nx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.line_snippets(F.col("t"), "needle", context).alias("s")).collect()
    assert [[(x.line, x.content, x.context_before, x.context_after) for x in r.s] for r in rows] == [brute_snippets(t or "", "needle", context) for t in texts]


def test_char_snippet(spark):
    long = "a " * 80 + "Needle  here" + " b" * 80
    texts = [long, "needle", "nothing " * 40, "short\n\ntext"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.char_snippet(F.col("t"), "needle")).collect()]
    assert got[0].startswith("…") and got[0].endswith("…") and "Needle here" in got[0] and len(got[0]) <= 128
    assert got[1] == "needle" and got[2].endswith("…") and len(got[2]) <= 121 and got[3] == "short text"


def test_functions(spark):
    row = spark.createDataFrame([("\\src\\A.Test.TSX", "import a from 'x';\nexport { b } from \"y\"; const z = require('z'); import('x')", {"apiKey": "1", "user": "2", "X-Token": "3", "monkey": "4"}, 61_500)], "p string, c string, m map<string,string>, ms long")
    r = row.select(
        paths.normalize_path(F.col("p")).alias("p"), paths.detect_language(F.lit("a.B.Tsx")).alias("l"), paths.detect_language(F.lit("README")).alias("u"), text.dependencies(F.col("c")).alias("d"), records.masked(F.col("m")).alias("m"), records.format_duration(F.col("ms")).alias("t"),
        paths.join_relative(F.lit("src/a"), F.lit("../../../b/./c")).alias("j"), text.line_of_offset(F.col("c"), F.lit(25)).alias("o"), records.format_cost(F.lit(1.5)).alias("cost"), records.pad_column(F.lit("abcdef"), 4).alias("pad"),
        records.parse_analysis(F.lit("**Domain**: web\n**Type**: bug\n**Requirements**: do\nit **X**")).alias("a"), records.file_paths(F.lit("see /a/b.ts and /c/d.md /a/b.ts")).alias("f"), records.spec_path(F.lit("at /r/docs/specs/x/y.md.")).alias("s"),
        paths.context_test_paths(F.lit("src/a/b.ts")).alias("ct"), paths.impact_test_paths(F.lit("src/a/b.tsx")).alias("it"), records.migration_version(F.lit("004_memory.sql")).alias("mv"),
    ).first()
    assert (r.p, r.l, r.u, r.d) == ("src/A.Test.TSX", "typescript", "unknown", ["x", "y", "z"])
    assert r.m == {"apiKey": "[REDACTED]", "user": "2", "X-Token": "[REDACTED]", "monkey": "[REDACTED]"} and records.mask({"a": {"password": 1, "b": [2]}}) == {"a": {"password": "[REDACTED]", "b": [2]}}
    assert (r.t, r.j, r.o, r.cost, r.pad, r.mv) == ("1m 1.5s", "../b/c", 2, "$1.5000", "abc…", 4)
    assert r.a.asDict() == {"domain": "web", "requirements": "do\nit", "issue_type": "bug"} and r.f == ["/a/b.ts", "/c/d.md"] and r.s == "/r/docs/specs/x/y.md"
    assert r.ct[-2:] == ["src/a/__tests__/b.test.ts", "tests/src/a/b.test.ts"] and r.it[-2:] == ["tests/b.test.ts", "__tests__/b.test.ts"]


@pytest.mark.parametrize(
    ("schema", "output", "paths_"),
    [
        ({"type": "string", "minLength": 3}, "ab", ["root"]),
        ({"type": "object", "required": ["a"], "properties": {"a": {"type": "number", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}}}, '{"a": 0, "b": ["x", 1]}', ["a", "b.1"]),
        ({"type": "object", "required": ["a"], "properties": {"a": {"type": "boolean"}}}, "{}", ["a"]),
        ({"type": "array"}, "nope", ["root"]),
        ({"type": "string", "pattern": "("}, "x", ["schema"]),
        (schemas.file_path_output(".md"), "docs/a.md", []),
        (schemas.file_path_output(), "/abs", ["root"]),
        (schemas.markdown_output(["## A", "## B"]), "x\n## B\n## A", []),
    ],
)
def test_output_schemas(schema, output, paths_):
    found = schemas.validate_output(schema, output)
    assert found["valid"] == (not paths_) and [e["path"] for e in found.get("errors", [])] == paths_


def test_tips():
    assert tips("find function", ["code"], Filters(), {"code": 0})[0].startswith("No results") and len(tips("why function error", ["code"], Filters(), {"code": 40})) == 2
    first = tips("src/a.ts", ["code"], Filters(), {"code": 1})
    assert "search_dependencies" in first[0] and tips("src/a.ts", ["code"], Filters(), {"code": 1}, first) == []
    assert "exported_only" in tips("x", ["symbols"], Filters(repository_id="r"), {"symbols": 11})[0]


def test_globs():
    import re

    assert re.match(glob_pattern("**/*.ts"), "a/b/c.ts") and re.match(glob_pattern("**/*.ts"), "c.ts") and not re.match(glob_pattern("src/*.ts"), "src/a/b.ts")


@pytest.mark.parametrize("query", ["alpha", "beta gamma", "x x", "naive", "a b", "a"])
def test_marked_snippets_as_fts5(spark, query):
    rng = random.Random(4)
    between = [" ", " ", " ", ". ", ": ", ",", ".\n", "\t", " - "]
    corpus = [(i, rng.choice(["", "(", ". "]) + "".join(rng.choice(WORDS) + rng.choice(between) for _ in range(rng.randrange(0, 90 if i % 2 else 30)))) for i in range(150)]
    corpus += [(200 + k, " ".join(["w"] * k + ["x"] * 40 + ["v"] * 50)) for k in (0, 5, 40)] + [(300, " ".join(f"w{i}" for i in range(60)) + ". " + " ".join(f"v{i}" for i in range(28)) + " alpha beta gamma x x x naïve a b a " + "z. " * 30)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content)")
    db.executemany("insert into t(rowid, content) values (?, ?)", corpus)
    want = dict(db.execute("select rowid, snippet(t, 0, '<mark>', '</mark>', '...', 32) from t where t match ?", (f'"{query}"',)))
    assert want
    rows = spark.createDataFrame(corpus, "id long, content string").where(F.col("id").isin(list(want)))
    assert {r.id: r.s for r in rows.select("id", text.token_snippet(F.col("content"), text.query_tokens(query)).alias("s")).collect()} == want


def test_marked_snippets_without_a_hit(spark):
    texts = ["nothing here", "", None, "--", "w " * 40]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.token_snippet(F.col("t"), ["alpha"])).collect()]
    assert got == ["nothing here", "", None, "--", " ".join(["w"] * 32) + "..."]
