"""Plans that hold for large tables: nothing whole in the driver or in one row."""

import pytest

from lodestone.operators import resolve, topk
from lodestone.plans import impact


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_are_not_broadcast(spark):
    """Small tables would be, and coded columns of large ones look small."""
    files = spark.createDataFrame([("r", f"src/f{i}.ts") for i in range(20)], "repository_id string, path string")
    imports = spark.createDataFrame([("r", f"./f{i}", "src/a.ts") for i in range(25)], "repository_id string, source string, from_path string")
    found = resolve.resolve_imports(imports, files)
    assert "Broadcast" not in planned(found)
    assert {r.source: r.target_file_path for r in found.collect()} == {f"./f{i}": f"src/f{i}.ts" if i < 20 else None for i in range(25)}


def test_scope_of_any_number_of_files(spark):
    """Counts equal the sizes of the lists, and no list is made for them."""
    files = spark.createDataFrame([(f"src/f{i}.ts",) for i in range(30)] + [(f"src/f{i}.test.ts",) for i in range(7)] + [("tests/f9.test.ts",)], "path string")
    affected = files.selectExpr("'all' AS request", "path").union(spark.createDataFrame([("one", "src/f3.ts"), ("test", "a/b.test.ts")], "request string, path string"))
    counted = impact.test_counts(affected, files)
    assert "collect_list" not in planned(counted)
    listed = impact.test_scope(affected, files).collect()
    assert {(r.request, r.sources, r.affected, r.tests, r.recommended) for r in counted.collect()} == {(r.request, r.sources, r.affected, len(r.test_files), len(r.recommended_test_files)) for r in listed}
    assert len(listed) == 3


@pytest.mark.parametrize("query", ["the of", "of", "the nowhere", ""])
def test_an_index_for_one_query(spark, query):
    """Its steps read a checkpoint and no text again, and find what the index of all tokens finds."""
    rows = spark.createDataFrame([(i, "the of " * (i % 7) + "so it is " * (i % 11) + "of the") for i in range(200)] + [(900, None), (901, "")], "id long, text string")
    one, all_ = (topk.build(rows, "id", ["text"], 20, *q) for q in ([query], []))
    assert "regexp" not in planned(one.postings).lower() and "split" not in planned(one.postings) and "split" in planned(all_.postings)
    assert topk.best(one, query, 9).rows.collect() == topk.best(all_, query, 9).rows.collect()
    assert one.totals.collect() == all_.totals.collect()
