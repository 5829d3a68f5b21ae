"""Extraction, tables, store, sync, streams and the engine from end to end."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.api import TOOLS, Engine, normalize_filters, tools
from lodestone.operators import extract, tables
from lodestone.plans import index, memory
from lodestone.sources import code, jsonl, state
from lodestone.store import Store
from lodestone.streaming import watch

NOW = datetime(2024, 1, 31)
SOURCES = {
    "src/utils.ts": "/** Adds. */\nexport function add(a: number, b: number): number {\n  return a + b;\n}\nexport const LIMIT = 3;\n",
    "src/api/main.ts": 'import { add } from "../utils";\nimport type { T } from "@lib/types";\nexport { LIMIT } from "../utils";\nexport class Service {\n  private n = 1;\n  async run(x: T): Promise<number> {\n    return add(x.v, this.n);\n  }\n}\n',
    "src/lib/types.ts": "export interface T { v: number }\n",
    "src/utils.test.ts": 'import { add } from "./utils";\nadd(1, 2);\n',
    "node_modules/x/i.js": "no",
    "db/a.sql": "select 1",
    "README.md": "no",
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["src/lib/*"]}}}',
}


@pytest.fixture
def tree(tmp_path):
    for name, content in SOURCES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(content)
    return tmp_path / "tree"


def test_crawl(spark, tree):
    rows = {r.path: r for r in code.crawl(spark, str(tree)).collect()}
    assert set(rows) == {"src/utils.ts", "src/api/main.ts", "src/lib/types.ts", "src/utils.test.ts", "db/a.sql", "tsconfig.json"}
    assert rows["src/api/main.ts"].dependencies == ["../utils", "@lib/types"] and rows["db/a.sql"].dependencies == []


def test_git_changes(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", ".")
    run("commit", "-m", "x")
    (tree / "src/utils.ts").write_text("changed")
    (tree / "src/new.ts").write_text("new")
    (tree / "db/a.sql").unlink()
    found = code.detect_changes(spark, str(tree), spark.createDataFrame([], "path string, indexed_at timestamp"))
    assert {(r.path, r.status) for r in found.collect()} == {("src/utils.ts", "modified"), ("src/new.ts", "added"), ("db/a.sql", "deleted")}
    assert code.default_branch(str(tree)) == "main" and len(code.current_revision(str(tree))) == 40


def test_extraction_never_fails(spark):
    broken = ["function f( {", "class {{{", "`${`${", "/* open", "'", "export const", "import", "}", "a</b>c<", "\x00é漢", None]
    files = spark.createDataFrame([(f"{i}.ts", c) for i, c in enumerate(broken)], "path string, content string")
    assert extract.symbols(files).count() >= 0 and extract.references(files).count() >= 0


def test_symbols_and_references():
    f = extract.File(SOURCES["src/api/main.ts"])
    assert [(s["name"], s["kind"], s["line_start"], s["line_end"], s["access_modifier"]) for s in f.symbols()] == [("Service", "class", 4, 9, None), ("n", "property", 5, 5, "private"), ("run", "method", 6, 8, None)]
    refs = [(r["target_name"], r["reference_type"], r["line_number"]) for r in f.references()]
    for r in [("add", "import", 1), ("T", "import", 2), ("LIMIT", "re_export", 3), ("T", "type_reference", 6), ("add", "call", 7), ("v", "property_access", 7)]:
        assert r in refs
    add = next(extract.File(SOURCES["src/utils.ts"]).symbols())
    assert (add["signature"], add["documentation"], add["is_exported"]) == ("(a, b) => number", "Adds.", True)


def test_engine(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), lambda: NOW)
    done = engine.call("index_repository", local_path=str(tree))
    assert done["indexed_files"] == 6 and done["indexed_symbols"] == 6
    assert engine.index_repository(str(tree)) == done  # the same ids again
    deps = engine.search_dependencies("src/utils.ts", depth=2)
    assert deps["dependents"]["direct"] == ["src/api/main.ts", "src/utils.test.ts"]
    assert engine.search_dependencies("src/utils.ts", "dependents", include_tests=False)["dependents"]["direct"] == ["src/api/main.ts"]
    assert engine.search_dependencies("src/api/main.ts", "dependencies")["dependencies"]["direct"] == ["src/lib/types.ts", "src/utils.ts"]
    used = engine.find_usages("add", include_tests=False)
    assert used["defined_in"] == "src/utils.ts:2" and {(u["line"], u["usage_type"]) for u in used["usages"]} == {(1, "import"), (7, "call")} and used["usages"][1]["context"] == "return add(x.v, this.n);"
    assert engine.find_usages("nothing")["defined_in"] == "unknown"
    found = engine.search("add", ["code", "symbols"])
    assert found["counts"]["symbols"] == 1 and "src/utils.ts" in [r["path"] for r in found["results"]["code"]]
    assert engine.search("add", output="snippet")["results"]["code"][0]["matches"] and engine.search("add", output="paths")["results"]["code"]
    hit = engine.analyze_change_impact("fix", files_to_modify=["src/utils.ts"])
    assert {f["path"] for f in hit["affected_files"]} == {"src/utils.ts", "src/api/main.ts", "src/utils.test.ts"} and hit["test_files"] == ["src/utils.test.ts"]
    context = engine.generate_task_context(["src/utils.ts", "gone.ts"])
    assert context["files"][0]["dependents"] == 2 and context["files"][0]["test_files"] == ["src/utils.test.ts"] and not context["files"][1]["indexed"]
    assert engine.list_recent_files(2)[0]["path"] == "db/a.sql"
    ident = engine.record_decision(title="Use Spark", context="scale", decision="Spark SQL everywhere", related_files=["a"])
    engine.record_failure(title="RDDs", problem="slow", approach="rdd", failure_reason="no codegen")
    engine.record_insight(content="note", insight_type="discovery")
    memory_hit = engine.search("spark sql", ["decisions", "failures"])
    assert memory_hit["counts"] == {"total": 1, "decisions": 1, "failures": 0} and memory_hit["results"]["decisions"][0]["id"] == ident and memory_hit["results"]["decisions"][0]["relevance"] > 0
    with pytest.raises(ValueError, match="title"):
        engine.record_decision(context="x")
    with pytest.raises(ValueError, match="scope"):
        engine.record_decision(title="t", context="c", decision="d", scope="odd")
    stats = engine.get_index_statistics()
    assert (stats["repositories"], stats["decisions"], stats["failures"]) == (1, 1, 1)
    expertise = tmp_path / "expertise.yaml"
    expertise.write_text("patterns:\n  a: {file_path: utils.ts}\n  b: {file_path: none.ts}\n  c: {}\ncore_implementation:\n  key_files:\n    - {path: lost.ts}\n")
    checked = engine.validate_expertise("x", str(expertise))
    assert (checked["summary"], checked["missing_key_files"]) == ({"total": 3, "valid": 2, "stale": 1}, ["lost.ts"]) and "not found" in engine.validate_expertise("x", "nowhere")["error"]
    assert [engine.sync_expertise("x", str(expertise))["synced"] for _ in range(2)] == [3, 0] and len(engine.get_recent_patterns(domain="x")) == 3
    assert engine.validate_implementation_spec("f", [{"path": "src/utils.ts"}])["errors"][0]["type"] == "file_conflict"
    other = Engine(spark, str(tmp_path / "other"), lambda: NOW)
    assert engine.sync_export(str(tmp_path / "sync"))["indexed_files"] == "exported" and engine.sync_export(str(tmp_path / "sync"))["indexed_files"] == "unchanged"
    assert other.sync_import(str(tmp_path / "sync"))["indexed_references"] == done["indexed_references"]
    assert sorted(map(tuple, other.store.table("indexed_symbols").collect()), key=str) == sorted(map(tuple, engine.store.table("indexed_symbols").collect()), key=str)
    assert engine.store.vacuum() > 0 and engine.store.size() > 0 and index.ensure_indexed(spark, engine.store, str(tree / "src"), NOW)["repository_id"]


def test_incremental(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), lambda: NOW)
    ident = engine.index_repository(str(tree))["repository_id"]
    (tree / "src/lib/types.ts").unlink()
    (tree / "src/utils.ts").write_text("export function sum() {}\n")
    events = [("change", "src/utils.ts", 1), ("add", "src/gone.ts", 1), ("delete", "src/gone.ts", 2), ("delete", "src/lib/types.ts", 2), ("change", "node_modules/x/i.js", 3)]
    folder = tmp_path / "events"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"type": t, "path": p, "timestamp": n}) for t, p, n in events))
    stream = watch.watch(watch.event_stream(spark, str(folder)), index.handle_changes(spark, engine.store, str(tree), ident, lambda: NOW), str(tmp_path / "cp"), once=True)
    stream.awaitTermination(120)
    assert stream.exception() is None
    assert {r.name for r in engine.store.table("indexed_symbols").collect()} == {"sum", "Service", "n", "run"}
    assert "src/lib/types.ts" not in {r.path for r in engine.store.table("indexed_files").collect()}
    same_as_a_scan(engine.store, ["sum", "add", "add from utils", "number", "src utils", "nothing at all", ""])


def same_as_a_scan(store, queries):
    """What the postings find is what a scan of all texts finds, with the same scores, and only token rows are read."""
    from lodestone.plans.search import Filters, code

    found, files = store.postings(), store.table("indexed_files")
    assert set(found) == {"file_postings", "file_lengths"}
    for q in queries:
        want, got = (code(files, q, Filters(), 20, *x).select("id", "path", "content", "tf", "dl", F.round("score", 9)).collect() for x in ((), (found["file_postings"], found["file_lengths"])))
        assert list(map(tuple, got)) == list(map(tuple, want)), q
    assert "IN(token" in (plan := code(files, "add from", Filters(), 20, found["file_postings"], found["file_lengths"])._jdf.queryExecution().toString()) or "In(token" in plan


def test_search_by_postings(spark, tree, tmp_path):
    """Postings come with the index, follow what is read again, and are not used once files changed without them."""
    engine = Engine(spark, str(tmp_path / "store"), lambda: NOW)
    assert engine.store.postings() == {}
    engine.index_repository(str(tree))
    same_as_a_scan(engine.store, ["add", "import add", "a number", "utils ts", "zzz"])
    (tree / "src/utils.ts").write_text("export function sum() { return add; }\n")
    engine.index_repository(str(tree))
    same_as_a_scan(engine.store, ["add", "return add", "a number", "utils ts"])
    engine.store.compact()
    same_as_a_scan(engine.store, ["return add"])
    store = engine.store
    store.commit({"indexed_files": store.table("indexed_files").where("path <> 'src/utils.ts'")})
    assert store.postings() == {} and "src/utils.ts" not in [r["path"] for r in engine.search("add")["results"]["code"]]
    store.compact()
    assert store.postings() == {}
    engine.index_repository(str(tree))
    same_as_a_scan(store, ["add", "return add"])


def test_tiers_and_filters():
    assert [len(tools(t)) for t in ("core", "default", "memory", "full", "odd")] == [8, 10, 13, 18, 10] and all(hasattr(Engine, t) for t in TOOLS)
    f = normalize_filters({"glob": 1, "language": "typescript", "exclude": ["a", 2], "exported_only": "yes"})
    assert (f.glob, f.language, f.exclude, f.exported_only) == (None, "typescript", ["a"], None) and normalize_filters(None).active() is False


def test_deletes_follow_keys(spark):
    t = {n: spark.createDataFrame([], catalog.TABLES[n].schema) for n in ("repositories", "indexed_files", "indexed_symbols", "indexed_references")}
    row = lambda n, **v: spark.createDataFrame([tuple(v.get(c) for c in catalog.TABLES[n].columns)], catalog.TABLES[n].schema)
    for f in ("f1", "f2"):
        t["indexed_files"] = t["indexed_files"].union(row("indexed_files", id=f, repository_id="r", path=f"{f}.ts"))
        t["indexed_symbols"] = t["indexed_symbols"].union(row("indexed_symbols", id=f"s{f}", file_id=f, repository_id="r", name="x"))
        t["indexed_references"] = t["indexed_references"].union(row("indexed_references", id=f"r{f}", file_id=f, repository_id="r", symbol_name="x", target_symbol_id="sf1"))
    left, gone = tables.delete_files(t, "r", spark.createDataFrame([("/f1.ts",), ("none.ts",)], "path string"))
    assert [r.path for r in gone.collect()] == ["f1.ts"] and [r.id for r in left["indexed_symbols"].collect()] == ["sf2"]
    assert [(r.id, r.target_symbol_id) for r in left["indexed_references"].collect()] == [("rf2", None)]
    entries = spark.createDataFrame([("indexed_files", "f2"), ("indexed_files", "nope")], "table string, id string")
    _, counts = tables.apply_deletions(t, entries)
    assert {r.table: r.deleted for r in counts.collect()}["indexed_files"] == 1


def test_jsonl(spark, tmp_path):
    lines = ['{"id": "1", "name": "a", "full_name": "x/a"}', "", "oops", '{"id": "2"}', '{"id": "3", "name": "c", "full_name": "x/c"}', '{"id": "3", "name": "d", "full_name": "x/d"}']
    (tmp_path / "repositories.jsonl").write_text("\n".join(lines))
    old = spark.createDataFrame([], catalog.TABLES["repositories"].schema)
    rows, errors = jsonl.import_table(spark, str(tmp_path / "repositories.jsonl"), "repositories", old)
    assert sorted((r.id, r.name) for r in rows.collect()) == [("1", "a"), ("3", "d")] and errors.count() == 2
    check = jsonl.validate(spark, str(tmp_path / "repositories.jsonl")).first()
    assert (check.valid, check.line_count, check.errors) == (False, 5, [3])
    kept, _ = jsonl.import_table(spark, str(tmp_path / "repositories.jsonl"), "repositories", rows.where("id = '1'").withColumn("name", F.lit("old")), ignore_conflicts=True)
    assert {(r.id, r.name) for r in kept.collect()} == {("1", "old"), ("3", "d")}


def test_manifest(spark, tmp_path):
    path = str(tmp_path / jsonl.MANIFEST)
    assert jsonl.load_manifest(spark, path) is None
    jsonl.record_deletion(spark, str(tmp_path), "indexed_files", "f1", "2024-01-01T00:00:00Z")
    assert [(r.table, r.id) for r in jsonl.load_manifest(spark, path).collect()] == [("indexed_files", "f1")]
    with pytest.raises(jsonl.ManifestError):
        jsonl.record_deletion(spark, str(tmp_path), "decisions", "x", "2024-01-01")
    (tmp_path / jsonl.MANIFEST).write_text("\n".join(['{"table": "users", "id": "1", "deleted_at": "2024-01-01"}'] * 12))
    with pytest.raises(jsonl.ManifestError, match="invalid"):
        jsonl.load_manifest(spark, path)
    jsonl.clear_manifest(spark, str(tmp_path))
    assert jsonl.load_manifest(spark, path).count() == 0


def test_merge(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "id string, v string")
    merged = tables.merge_three(side(("a", "1"), ("b", "ours"), ("c", "3")), side(("a", "1"), ("b", "theirs"), ("d", "4")))
    assert [tuple(r) for r in merged.collect()] == [("a", "1"), ("b", "theirs"), ("c", "3"), ("d", "4")]


def test_store_swaps_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.table("decisions").count() == 0
    row = memory.record(spark, "decisions", {"title": "t", "context": "c", "decision": "d"}, NOW)
    store.commit({"decisions": row})
    with pytest.raises(Exception):  # noqa: B017, PT011
        store.commit({"decisions": row.union(row), "failures": spark.range(1).select(F.raise_error(F.lit("no")).alias("id"), *[F.lit(None).alias(c) for c in catalog.TABLES["failures"].columns[1:]])})
    assert store.table("decisions").count() == 1


def test_memory_sync(spark):
    empty = lambda n: spark.createDataFrame([], catalog.TABLES[n].schema)
    expertise = {"key_operations": {"op": {"when": "w", "approach": "a"}}, "patterns": {"p": {"notes": ["x", "y"], "structure": "s"}}, "known_issues": [{"issue": "It breaks", "status": "resolved"}]}
    once = memory.sync_decisions(spark, empty("decisions"), "db", expertise, NOW)
    twice = memory.sync_decisions(spark, once, "db", expertise | {"key_operations": {"op": {"when": "new"}}}, NOW)
    assert sorted((r.title, r.scope, r.context) for r in twice.collect()) == [("db:op", "pattern", "new"), ("db:pattern:p", "convention", "x\ny")]
    insights = memory.sync_insights(spark, empty("insights"), "db", expertise, NOW)
    assert [r.insight_type for r in insights.collect()] == ["workaround"] and memory.sync_insights(spark, insights, "db", expertise, NOW).count() == 1
    contexts = empty("workflow_contexts")
    for data in ({"a": 1}, {"a": 2}):
        contexts = memory.put_context(spark, contexts, "w", "plan", data, NOW)
    assert [json.loads(r.context_data) for r in contexts.collect()] == [{"a": 2}] and memory.clear_contexts(contexts, "w")[1] == 1
    with pytest.raises(ValueError):
        memory.put_context(spark, contexts, "w", "odd", {}, NOW)


def test_state_files(spark, tmp_path):
    state.write_checkpoint(str(tmp_path), {"issueNumber": 3, "phase": "plan"})
    (tmp_path / "9.json").write_text("{")
    assert state.read_checkpoint(str(tmp_path), 3)["phase"] == "plan" and state.read_checkpoint(str(tmp_path), 9) is None and len(state.list_checkpoints(str(tmp_path))) == 1
    state.clear_checkpoint(str(tmp_path), 3)
    at = str(tmp_path / "m" / "manifest.json")
    state.update_manifest(at, {"issueNumber": 1, "startedAt": "t", "status": "running"})
    assert state.update_manifest(at, {"issueNumber": 1, "startedAt": "t", "status": "completed"}) == [{"issueNumber": 1, "startedAt": "t", "status": "completed"}] and state.manifest_table(spark, at).count() == 1
    assert state.workflow_id(7, datetime(2024, 1, 2, 3, 4, 5, 6000)) == "adw-7-2024-01-02T030405006"


def test_migrations():
    files = {"002_b.sql": "b", "010_c.sql": "c", "001_a.sql": "a", "notes.txt": "x"}
    todo, drifted = catalog.pending(files, {"001_a": catalog.Migration(1, "001_a", "a").checksum, "002_b": "other"})
    assert [m.name for m in todo] == ["010_c"] and drifted == ["002_b"]


def test_streamed_windows(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:{m:02}:00") for m in (1, 2, 30)] + [("u", "2024-01-01 02:00:00"), ("v", "2024-01-01 00:10:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"user": u, "ts": t}) for u, t in rows))
    events = spark.readStream.schema("user string, ts timestamp").json(str(tmp_path / "in"))
    q = watch.rate_windows(events, "ts", "user", "1 hour", 2, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.user, r.requests, r.remaining) for r in spark.table("rates").collect()) == [("u", 1, 1), ("u", 3, 0), ("v", 1, 1)]
    batch = spark.createDataFrame(rows, "user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.events for r in watch.debounced(batch, "ts", "5 minutes", ["user"]).collect()) == [1, 1, 1, 2]


def test_server(spark, tmp_path):
    import threading
    import urllib.request

    from lodestone import server

    engine = Engine(spark, str(tmp_path / "s"), lambda: NOW)
    engine.record_decision(title="t", context="c", decision="spark")
    assert len(server.rpc(engine, {"id": 1, "method": "tools/list"}, "full")["result"]["tools"]) == 18
    called = server.rpc(engine, {"id": 2, "method": "tools/call", "params": {"name": "get_index_statistics"}})
    assert json.loads(called["result"]["content"][0]["text"])["decisions"] == 1
    assert server.rpc(engine, {"id": 3, "method": "tools/call", "params": {"name": "odd"}})["error"]["code"] == -32602 and server.rpc(engine, {"method": "initialized"}) is None
    http = server.serve(engine, 0, "default")
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/search?term=x") as r:
        assert json.load(r)["counts"]["total"] == 0
    http.shutdown()
    assert server.answer(engine, "POST", "/validate-output", {"schema": {"type": "string", "minLength": 2}, "output": "a"})[1]["valid"] is False and server.answer(engine, "GET", "/none", {})[0] == 404


def test_store_queries_and_migrations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ran = []
    assert catalog.apply_migrations(store, {"1_a.sql": "a", "2_b.sql": "b"}, lambda m: ran.append(m.name), NOW) == (["1_a", "2_b"], []) and ran == ["1_a", "2_b"]
    assert catalog.apply_migrations(store, {"1_a.sql": "changed", "2_b.sql": "b"}, lambda m: ran.append(m.name), NOW) == ([], ["1_a"])
    assert [r.name for r in store.query("select name from schema_migrations where id > ? order by id", 1).collect()] == ["2_b"] and store.exists("schema_migrations") and not store.exists("decisions")
    store.compact()
    assert store.vacuum() == 2 and store.table("schema_migrations").count() == 2
    metrics = spark.createDataFrame([], catalog.TABLES["workflow_metrics"].schema)
    run = metrics.sparkSession.createDataFrame([(None, 7, NOW, NOW, True, 1, 1, 1, 0.5, None, None, None)] * 2, catalog.TABLES["workflow_metrics"].schema)
    assert sorted(r.id for r in memory.add_metrics(memory.add_metrics(metrics, run), run).collect()) == [1, 2, 3, 4]


def test_problems_and_roots(spark, tmp_path):
    rows = spark.createDataFrame([("a.ts", "function f( {\n"), ("b.ts", "const a = 'x'; f({[1]})"), ("c.ts", "x = 'y\n}")], "path string, content string")
    found = {(r.path, r.line) for r in extract.problems(rows).collect()}
    assert {p for p, _ in found} == {"a.ts", "c.ts"} and ("c.ts", 2) in found
    (tmp_path / "p" / "src").mkdir(parents=True)
    (tmp_path / "p" / "package.json").write_text("{}")
    assert code.project_root(str(tmp_path / "p" / "src" / "x.ts")) == str(tmp_path / "p") and code.project_root("/nowhere/a/b.ts") == "/nowhere"


def references(source):
    return [(r["target_name"], r["reference_type"], r["line_number"], r["column_number"]) for r in extract.File(source).references()]


def test_calls_begin_where_their_expression_does():
    assert references("load()\n  .then(x)\n  .done;") == [("load", "call", 1, 0), ("then", "call", 1, 0), ("then", "property_access", 1, 0), ("done", "property_access", 1, 0)]
    assert references("  new Map();\nnew a.Box(1);\nnew Box(2).open();") == [("Box", "property_access", 2, 4), ("open", "call", 3, 0), ("open", "property_access", 3, 0)]
    assert references("f(a.b, (c || d)[0].e)") == [("f", "call", 1, 0), ("b", "property_access", 1, 2), ("e", "property_access", 1, 7)]


def test_nothing_is_capped():
    """Type arguments of any length, and brackets that close any number of open ones."""
    long = ", ".join(f"T{i}" for i in range(2000))
    assert [s["signature"] for s in extract.File(f"export function f<{long}>(a: X<{long}>): void {{}}").symbols()] == ["(a) => void"]
    deep = "class A { m() { " + "( " * 200 + "} n() {} }\nfunction after() {}\n"
    assert [s["name"] for s in extract.File(deep).symbols()] == ["A", "m", "n", "after"]
    begun = datetime.now()
    list(extract.File("x = a < b\n" * 20_000).references())
    assert (datetime.now() - begun).seconds < 20


def test_a_second_writer_is_found_out(spark, tmp_path):
    from lodestone.store import Conflict

    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("r", "a", "main", None, None)], "id string, full_name string, default_branch string, last_indexed_at timestamp, created_at timestamp")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in catalog.TABLES["repositories"].columns])
    began = two.version()
    assert one.commit({"repositories": rows}) == 1
    with pytest.raises(Conflict):
        two.commit({"repositories": rows.limit(0)}, began)
    assert two.table("repositories").count() == 1 and two.commit({"repositories": rows.limit(0)}) == 2
    assert one.table("repositories").count() == 0 and one.vacuum() == 2 and one.version() == 2


def test_usage_summary(spark):
    from lodestone.operators import usages

    found = spark.createDataFrame([("r", "f", "function", "a.ts", "x.ts", 1), ("r", "f", "function", "a.ts", "x.ts", 2), ("r", "f", "function", "a.ts", "y.ts", 1)], "repository_id string, name string, kind string, defined_in string, file string, line int")
    wanted = spark.createDataFrame([("r", "f"), ("r", "g"), ("s", "f")], "repository_id string, name string")
    rows = {(r.repository_id, r.name): r for r in usages.usage_summary(found, wanted).collect()}
    assert (rows["r", "f"].total_usages, rows["r", "f"].files_with_usages, rows["r", "f"].defined_in) == (3, 2, "a.ts")
    assert all(rows[k].total_usages == 0 and rows[k].kind == "unknown" for k in (("r", "g"), ("s", "f")))


def test_events_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, kind string")
    for _ in range(2):
        state.append_events(rows, str(tmp_path / "events"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "events")).select("n", "kind").collect()] == [(1, "a")] * 2


def test_older_code_search(spark):
    from lodestone.plans.search import Filters, search_code

    columns = catalog.TABLES["indexed_files"].columns
    files = spark.createDataFrame([("1", "src/a.ts", "say hello world to all"), ("2", "src/b.ts", "nothing here")], "id string, path string, content string")
    files = files.select(*[F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rows = search_code(files, "hello world").collect()
    assert [(r.path, r.snippet) for r in rows] == [("src/a.ts", "say hello world to all")] and rows[0].score < 0
    assert search_code(files, "hello", Filters(glob="*.js", compatible=False)).count() == 0


def test_flat_dependencies(spark):
    from lodestone.operators import graph

    edges = spark.createDataFrame([("b", "a"), ("a.test", "a"), ("c", "b"), ("a", "z")], "src string, dst string")
    assert dict(graph.flat_dependencies(edges, "a", 2, True)) == {"dependents": ["a.test", "b", "c"], "dependencies": ["z"], "testFiles": ["a.test"]}
    assert dict(graph.flat_dependencies(edges, "a", 1, False)) == {"dependents": ["b"], "dependencies": ["z"], "testFiles": []}


def test_sync_stream(spark, tmp_path):
    """Changed files of the sync folder are imported once a batch, and its deletions applied again."""
    folder, store = tmp_path / "sync", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    name = "repositories"
    first = spark.createDataFrame([("r1", "one", "o/one"), ("r2", "two", "o/two")], "id string, name string, full_name string")
    full = first.select(*[F.col(c) if c in first.columns else F.lit(None).cast("string").alias(c) for c in catalog.TABLES[name].columns])
    lines = [json.dumps({k: v for k, v in r.asDict().items() if v is not None}) for r in full.collect()]
    (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    stream = watch.files_stream(spark, str(folder))
    run = stream.writeStream.foreachBatch(index.handle_sync(spark, store, str(folder))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None and store.version() == 1 and store.exists(name)
    assert {r.full_name for r in store.table(name).collect()} == {"o/one", "o/two"}
