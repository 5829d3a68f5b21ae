"""Walks, cycles and impact against plain searches on random graphs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, resolve
from lodestone.plans import impact, validation


def brute(edges, root, depth):
    """Walks against the edges, and closed ones, as the recursion defines them."""
    into = {}
    for s, d in edges:
        into.setdefault(d, []).append(s)
    walks = [(s, 1, (s,)) for s in into.get(root, [])]
    found, closed = list(walks), set()
    while walks:
        nxt = []
        for node, k, path in walks:
            if k >= depth:
                continue
            for s in into.get(node, []):
                if s in path:
                    closed.add((*path, s))
                else:
                    nxt.append((s, k + 1, (*path, s)))
        found += nxt
        walks = nxt
    return {(k, n) for n, k, _ in found}, closed


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(26)})
    df, roots = spark.createDataFrame(edges, "src string, dst string"), [f"n{i}" for i in range(4)]
    found, cycles = graph.walks(df, spark.createDataFrame([(r,) for r in roots], "root string"), 4)
    got, closed = found.select("root", "depth", "node").distinct().collect(), cycles.collect()
    for r in roots:
        nodes, loops = brute(edges, r, 4)
        assert {(x.depth, x.node) for x in got if x.root == r} == nodes
        assert {tuple(x.path) for x in closed if x.root == r} == loops


def test_results_on_random_graphs(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(20)})
    roots = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("alone",)], "root string")
    rows = {r.root: r for r in graph.dependency_result(spark.createDataFrame(edges, "src string, dst string"), roots, 4).collect()}
    assert len(rows) == 10 and rows["alone"].direct == []
    for root, r in rows.items():
        nodes, loops = brute(edges, root, 4)
        assert r.direct == sorted(n for k, n in nodes if k == 1) and {tuple(c) for c in r.cycles} == loops
        assert r.indirect == {f"depth_{k}": sorted(n for d, n in nodes if d == k) for k in range(2, 5) if any(d == k for d, _ in nodes)}


def result(spark, edges, root, depth, tests=True):
    return graph.dependency_result(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(root,)], "root string"), depth, tests).first()


def test_scenarios(spark):
    chain = [("middle", "base"), ("top", "middle"), ("__tests__/base.test", "base")]
    assert result(spark, chain, "base", 1).direct == ["__tests__/base.test", "middle"]
    deep = result(spark, chain, "base", 2, tests=False)
    assert deep.direct == ["middle"] and deep.indirect == {"depth_2": ["top"]}
    two = result(spark, [("a", "b"), ("b", "a")], "a", 3)
    assert two.cycles and all({"a", "b"} == set(c) for c in two.cycles) and "a" in two.indirect["depth_2"]
    assert any(set(c) == {"a", "b", "c"} for c in result(spark, [("a", "b"), ("b", "c"), ("c", "a")], "a", 5).cycles)
    assert result(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "d", 5).cycles == []
    none = result(spark, chain, "top", 2)
    assert (none.direct, none.indirect, none.cycles) == ([], {}, [])
    with pytest.raises(ValueError):
        result(spark, chain, "base", 6)


@pytest.mark.parametrize(("edges", "n"), [([("a", "b"), ("b", "a")], 1), ([("a", "b"), ("b", "c"), ("c", "a")], 1), ([("a", "a")], 1), ([("a", "b"), ("b", "c")], 0), ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], 2)])
def test_find_cycles(spark, edges, n):
    found = graph.find_cycles(edges)
    assert len(found) == n and all(c[0] == c[-1] for c in found)
    assert graph.cycles_by_repository(spark.createDataFrame([("r", *e) for e in edges], "repository_id string, src string, dst string")).count() == n


def test_very_long_chain_has_no_recursion_limit():
    assert graph.find_cycles([(i, i + 1) for i in range(50_000)] + [(50_000, 0)])[0][0] == 0


def test_distinct_cycles(spark):
    paths = spark.createDataFrame([(["x", "b", "c", "b"],), (["c", "b", "c"],), (["d", "d"],)], "path array<string>")
    assert sorted(r.cycle for r in graph.distinct_cycles(paths).collect()) == [["b", "c"], ["d"]]


def test_import_resolution(spark):
    files = [("r", p) for p in ("src/a.ts", "src/b/index.ts", "src/c.js", "src/c.ts", "src/d.tsx", "lib/api/x.ts", "lib/db/index.js", "up.ts")] + [("other", "src/z.ts")]
    asked = {
        ("./a", "src/m.ts"): "src/a.ts", ("./b", "src/m.ts"): "src/b/index.ts", ("./c", "src/m.ts"): "src/c.ts", ("./c.js", "src/m.ts"): "src/c.js", ("./a.js", "src/m.ts"): "src/a.ts", ("./d.jsx", "src/m.ts"): "src/d.tsx", ("../up", "src/m.ts"): "up.ts", ("../src/./a", "src/m.ts"): "src/a.ts",
        ("./z", "src/m.ts"): None, ("./none", "src/m.ts"): None, ("react", "src/m.ts"): None, ("@api/x", "src/m.ts"): "lib/api/x.ts", ("@db", "src/m.ts"): "lib/db/index.js", ("@api/none", "src/m.ts"): None, (".", "src/b/x.ts"): "src/b/index.ts",
    }
    aliases = resolve.Aliases("lib", {"@api/*": ["nowhere/*", "api/*"], "@db": ["db"], "*": ["src/*"]})
    got = resolve.resolve_imports(spark.createDataFrame([("r", *k) for k in asked], "repository_id string, source string, from_path string"), spark.createDataFrame(files, "repository_id string, path string"), aliases.table(spark))
    assert {(r.source, r.from_path): r.target_file_path for r in got.collect()} == asked
    assert resolve.read_tsconfig("{ // c\n}") is None and resolve.read_tsconfig('{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}').paths == {"@/*": ["src/*"]}


def test_impact(spark):
    names = ["src/a.ts", "src/b.ts", "src/c.ts", "src/a.test.ts", "src/db/migration.ts"] + [f"src/m{i:02}.ts" for i in range(30)]
    edges = [("src/b.ts", "src/a.ts"), ("src/c.ts", "src/b.ts")] + [(f"src/m{i:02}.ts", "src/b.ts") for i in range(30)]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    requests = spark.createDataFrame([("one", "refactor", True, ["src/a.ts", "src/new.ts", "src/a.ts"], None, ["src/db/migration.ts"]), ("none", "fix", None, None, [], None)], "request string, change_type string, breaking_changes boolean, files_to_modify array<string>, files_to_create array<string>, files_to_delete array<string>")
    rows = {r.request: r for r in impact.analyze(requests, spark.createDataFrame(edges, "src string, dst string"), files).collect()}
    one = {x.path: x for x in rows["one"].affected_files}
    assert one["src/a.ts"].change_requirement == "update" and one["src/a.ts"].indirect_dependents_count == 31 and one["src/new.ts"].reason == "New file to be created"
    assert one["src/b.ts"].reason == "Directly depends on src/a.ts" and sum(x.reason.startswith("Indirectly") for x in one.values()) == 20
    assert rows["one"].test_files == ["src/a.test.ts"] and "tests/new.test.ts" in rows["one"].recommended_test_files and rows["one"].risk_level == "high" and len(rows["one"].architectural_warnings) == 2
    assert rows["one"].summary.startswith(f"Change type: refactor. {len(one)} files affected") and rows["one"].summary.endswith("Breaking changes included.")
    assert rows["none"].risk_level == "low" and "0 files affected" in rows["none"].summary and "Bug fix deployment. Small-scale" in rows["none"].deployment_impact


def test_specs(spark):
    files = spark.createDataFrame([("src/there.ts",)], "path string")
    bad = ("bad", "x", [("src/there.ts",), ("app/src/odd/a.ts",), ("app/src/api/b.ts",), ("test/x.js",)], [], [("1_x.sql",), ("20250101000000_ok.sql",)], [("mocker", None), ("fine", "1.0")], True)
    good = ("good", "y", [("a.ts",), ("a.test.ts",)], [("b.ts",)], [], [], None)
    rows = {r.spec: r for r in validation.validate(spark.createDataFrame([bad, good], f"spec string, {validation.SPEC}"), files).collect()}
    assert not rows["bad"].valid and Counter(e.type for e in rows["bad"].errors) == {"file_conflict": 1, "naming_convention": 1}
    assert Counter(w.type for w in rows["bad"].warnings) == {"naming_convention": 1, "path_alias": 1, "test_coverage": 1, "dependency": 2}
    assert all(x.suggested_fix for x in rows["bad"].errors + rows["bad"].warnings) and rows["bad"].errors[0].suggested_fix == validation.FIXES["conflict"]
    assert rows["bad"].risk_assessment.startswith("HIGH RISK - 2 blocking errors, 5 warnings, breaking changes, 2 database migrations.")
    assert rows["good"].valid and rows["good"].risk_assessment.startswith("LOW") and rows["good"].summary == "Validation for feature: y. PASSED - No blocking errors. 3 files planned." and len(rows["good"].approval_conditions) == 2


def test_domains(spark):
    files = spark.createDataFrame([("src/db/a.ts",), ("docs/x.md",), (".claude/agents/e.md",)], "path string").withColumn("indexed_at", F.current_timestamp())
    assert {r.domain for r in graph.available_domains(files).collect()} == {"database", "documentation", "claude-config", "agent-authoring"}
    edges = spark.createDataFrame([("x", "src/db/a.ts"), ("y", "src/db/a.ts"), ("x", "src/db/a.ts"), ("x", "docs/x.md")], "src string, dst string")
    assert [tuple(r) for r in graph.domain_key_files(edges, "database").collect()] == [("src/db/a.ts", 2)] and graph.domain_key_files(edges, "unknown").count() == 0
