"""The best of an index by bounds of its blocks against a scan of all texts."""

import random

import pytest

from lodestone.operators import search, topk


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([5, 20, 80]))), rng.choice(["w0 w1", "w2", ""])) for i in range(900)]
    rows += [(1000 + i, "rare " * (i + 1) + "w0 w1 " * 3, None) for i in range(30)] + [(2000, None, None), (2001, "x x x x y", "x")]
    return spark.createDataFrame(rows, "id long, text string, title string").cache()


@pytest.fixture(scope="module")
def indexes(corpus):
    out = {blocks: topk.build(corpus, "id", ["title", "text"], blocks) for blocks in (1, 37)}
    for index in out.values():
        index.postings, index.bounds, index.totals = (df.cache() for df in (index.postings, index.bounds, index.totals))
    return out


@pytest.mark.parametrize(("query", "blocks"), [("w0", 37), ("w0 w1", 1), ("w0 w1", 37), ("w1 w1", 37), ("rare", 37), ("x x", 37), ("w5 w0 w2", 37), ("nowhere", 1), ("", 1), ("rare nowhere", 37), ("w2 w0", 37)])
def test_same_as_the_scan(spark, corpus, indexes, query, blocks):
    index = indexes[blocks]
    found = topk.best(index, query, 20, first=2)
    want = search.phrase_hits(corpus, ["title", "text"], query).orderBy("score", "id").limit(20).collect()
    got = found.rows.collect()
    assert [(r.key, r.tf, r.dl) for r in got] == [(r.id, r.tf, r.dl) for r in want]
    if len(search.query_tokens(query)) == 1:
        assert [r.score for r in got] == pytest.approx([r.score for r in want])
    assert found.read <= found.candidates <= blocks


def test_few_blocks_are_read(spark, corpus, tmp_path):
    """The documents with the most of a word are in few blocks, and the index is read back from files."""
    topk.build(corpus, "id", ["text"], 100).write(str(tmp_path / "index"))
    found = topk.best(topk.Index.read(spark, str(tmp_path / "index")), "rare", 3, first=2)
    assert [r.key for r in found.rows.collect()] == [1029, 1028, 1027] and found.read <= 14 < found.candidates
    plan = topk.Index.read(spark, str(tmp_path / "index")).postings.where("token in ('rare') and block in (3, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(token,rare), In(block, [3,5])]" in plan or "In(block, [3,5])" in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert topk.best(topk.build(none, "id", ["text"], 4), "a").rows.collect() == []
