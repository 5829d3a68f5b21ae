"""One domain and one word in every row, and words of any length."""

import threading

from pyspark.sql import functions as F

from lodestone.llm import common, pii

SCHEMA = "doc_id long, text string"


def test_long_words_are_terms(spark):
    long = "q" * 300
    rows = [(0, f"write to {long} at ann@one.example now")] + [(i, f"plain words of row {i} and the rest of them") for i in range(1, 3000)]
    found = pii.sanitised(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 0").first()
    assert (9, 309) in {(s.start, s.end) for s in found.spans if s.kind == "term"}


def test_joins_of_hot_keys_can_be_split(spark):
    """Nothing but exchanges stands below the joins at which all pairs of a domain or of a word meet."""
    docs = spark.createDataFrame([(i, f"the mail of user{i}@one.example is read by the word{i % 7}") for i in range(200)], SCHEMA)
    rows = common.staged(pii.found(docs))
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*").withColumn("entity", F.explode(F.array("entity", "group"))).drop("group")
    plan = pii.disclosing(near, docs, 200)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan and "MapInArrow" not in plan


def test_threads_remove_their_own(spark):
    """What one thread stages stays when another's block ends."""
    ready, go, seen = threading.Event(), threading.Event(), {}

    def other():
        with common.temporary(spark):
            df = common.staged(spark.range(3))
            ready.set()
            go.wait(60)
            seen["rows"] = df.count()

    t = threading.Thread(target=other)
    with common.temporary(spark):
        t.start()
        ready.wait(60)
    go.set()
    t.join()
    assert seen["rows"] == 3
