"""Files are parsed once for all that an index needs."""

from lodestone.operators import extract
from lodestone.plans import index
from lodestone.store import Store

SOURCE = "import { a as b } from './x';\nexport class K { m() { return b(1); } }\nconst s = 'open\n"


def test_one_parse_yields_all(spark):
    files = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", None), ("c.sql", "select 1"), ("d.ts", "export const d = 1;\n")], "path string, content string")
    parsed = extract.parsed(files).cache()
    for what, own in (("symbols", extract.symbols), ("references", extract.references), ("problems", extract.problems)):
        found, alone = extract.rows_of(parsed, what), own(files)
        assert found.columns == alone.columns == [c.split(" ")[0] for c in extract.YIELDS[what].split(", ")]
        assert sorted(map(repr, found.collect())) == sorted(map(repr, alone.collect())) and found.count() > 0
    reference = extract.references(files).where("reference_type = 'import'").first()
    assert reference.metadata == {"importSource": "./x", "importedName": "a", "importAlias": "b"}


def test_an_index_parses_once(spark, tmp_path):
    store, kept = Store(spark, str(tmp_path / "s")), []
    files = spark.createDataFrame([("src/a.ts", SOURCE, ["./x"]), ("src/x.ts", "export const a = 1;\n", [])], "path string, content string, dependencies array<string>")
    made = index.index_files(store, "r", files, "2024-01-01 00:00:00", kept=kept)
    assert len(kept) == 1
    for rows in made.values():
        assert "MapIn" not in rows._jdf.queryExecution().executedPlan().toString()
    store.commit(made)
    assert {r.name for r in store.table("indexed_symbols").collect()} == {"K", "m", "a"}
    assert store.table("indexed_references").where("target_file_path = 'src/x.ts' and target_symbol_id is not null").count() == 1
    assert {r.symbol_id for r in store.grams()["symbol_grams"].collect()} == {r.id for r in store.table("indexed_symbols").collect()}
