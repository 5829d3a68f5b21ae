"""Prefix, suffix and containment joins and the grams of names against plain loops, and writers that come between."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import fingerprints as fp
from lodestone.operators import resolve, search
from lodestone.plans import memory, validation
from lodestone.store import Store


def words(rng, n, longest, letters="abé_%"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest + 1))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_by_loops(spark, seed):
    rng = random.Random(seed)
    texts, keys = [*words(rng, 60, 12), None], [*set(words(rng, 25, 5)), None]
    rows, wanted = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(k,) for k in keys], "k string")
    for join, fits in ((fp.joined_by_prefix, str.startswith), (fp.joined_by_suffix, str.endswith)):
        found = join(rows, "t", wanted, "k")
        assert sorted((r.t, r.k) for r in found.collect()) == sorted((t, k) for t in texts if t is not None for k in keys if k is not None and fits(t, k))
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    found = fp.contained(rows, "t", wanted, "k")
    assert sorted(r.k for r in found.collect()) == sorted(k for k in keys if k is not None and any(k in t for t in texts if t))
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_nothing_wanted(spark):
    rows, none = spark.createDataFrame([("abc",), (None,)], "t string"), spark.createDataFrame([], "k string")
    assert not fp.joined_by_prefix(rows, "t", none, "k").collect() and not fp.joined_by_suffix(rows, "t", none, "k").collect() and not fp.contained(rows, "t", none, "k").collect()
    assert fp.contained(rows.limit(0), "t", spark.createDataFrame([("a",)], "k string"), "k").collect() == []


def test_more_entries_than_can_be_broadcast(spark):
    """20,000 entries, aliases and issues, each of which had a limit of 10,000."""
    files = spark.range(20_000).select(F.concat(F.lit("src/Mod_"), "id", F.lit("/File.ts")).alias("path"))
    entries = spark.range(20_000).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 3 == 0, "key_file").otherwise("pattern").alias("kind"), F.concat(F.lit("mod_"), F.col("id") * 2, F.lit("/file.ts")).alias("file_path"))
    found = validation.expertise_files(entries, files)
    counts = {r.status: r["count"] for r in found.groupBy("status").count().collect()}
    gone = [i for i in range(20_000) if i * 2 >= 20_000]
    # "mod_4/file.ts" ends no other path, as an underscore stands before the number
    assert counts == {"valid": 10_000, "missing": sum(i % 3 == 0 for i in gone), "stale": sum(i % 3 != 0 for i in gone)}
    aliases = spark.range(20_000).select(F.concat(F.lit("@m"), "id", F.lit("/")).alias("prefix"), F.lit("").alias("suffix"), F.lit(True).alias("wildcard"), F.concat(F.lit("lib/m"), "id", F.lit("/*")).alias("template"), F.col("id").cast("int").alias("ord"))
    asked = spark.createDataFrame([("r", f"@m{i}/x", "a.ts") for i in (3, 33, 19_999, 20_000)], "repository_id string, source string, from_path string")
    there = spark.createDataFrame([("r", f"lib/m{i}/x.ts") for i in (3, 33, 19_999, 20_000)], "repository_id string, path string")
    got = resolve.resolve_imports(asked, there, aliases)
    assert {r.source: r.target_file_path for r in got.collect()} == {f"@m{i}/x": f"lib/m{i}/x.ts" if i < 20_000 else None for i in (3, 33, 19_999, 20_000)}
    assert "NestedLoop" not in plan(got)


def test_issues_that_insights_contain(spark):
    schema = catalog.TABLES["insights"].schema
    known = "The cache is not cleared when the index is written again, so that old rows stay"
    old = spark.createDataFrame([(f"[a] {known}",)], "content string")
    old = old.select(*[F.col(c) if c == "content" else F.lit(None).alias(c) for c in catalog.TABLES["insights"].columns])
    old = spark.createDataFrame(old.collect(), schema)
    issues = [{"issue": known[:50] + " but it differs behind fifty characters"}, {"issue": "short"}, {"issue": "cache"}, {"issue": "x" * 70, "status": "resolved"}]
    out = memory.sync_insights(spark, old, "d", {"known_issues": issues}, "2024-01-01 00:00:00")
    assert sorted(r.content.split("\n")[0] for r in out.collect()) == sorted([f"[a] {known}", "[d] short", f"[d] {'x' * 70}"])


@pytest.mark.parametrize("query", ["ab", "a", "", "%", "_", "abé", "a%b", "a_b", r"a\_b", r"\%", "ÉA", "ba%_ab", "nowhere"])
def test_names_by_grams(spark, query):
    rng = random.Random(3)
    names = [*words(rng, 200, 9), "ABÉ", "aXb"]
    symbols = spark.createDataFrame([(f"s{i}", "f", "r", n, "function", None, None, 1, 2, None) for i, n in enumerate(names)], "id string, file_id string, repository_id string, name string, kind string, signature string, documentation string, line_start int, line_end int, metadata string")
    files = spark.createDataFrame([("f", "a.ts")], "id string, path string")
    scanned, found = (search.search_symbols(symbols, files, query, limit=100, grams=g) for g in (None, search.name_grams(symbols)))
    assert [(r.name, r.id) for r in scanned.orderBy("name", "id").collect()] == [(r.name, r.id) for r in found.orderBy("name", "id").collect()] or scanned.count() == found.count() == 100


def test_a_commit_between_read_and_commit(spark, tmp_path):
    """Two writers that each add a row: the second reads again, and both rows stay."""
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    schema = catalog.TABLES["file_lengths"].schema
    row = lambda name: spark.createDataFrame([(name, 1)], schema)
    one.commit({"file_lengths": row("first")})
    made = []

    def change():
        out = {"file_lengths": two.table("file_lengths").unionByName(row("second"))}
        if not made:
            one.update(lambda: {"file_lengths": one.table("file_lengths").unionByName(row("between"))})
        made.append(1)
        return out

    two.update(change)
    assert sorted(r.file_id for r in two.table("file_lengths").collect()) == ["between", "first", "second"] and len(made) == 2
