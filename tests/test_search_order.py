"""Depth-first cycles: fewer edges and one cycle at a time, with the same result."""

import random
from types import GeneratorType

from lodestone.operators import graph


def test_cycles_of_fewer_edges(spark):
    rng = random.Random(4)
    edges = {(r, f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for r in "abc" for _ in range(16)}
    edges |= {(r, f"{c}{i}", f"n{rng.randrange(9)}") for r in "ab" for c in ("a", "z") for i in range(20)} | {("a", "n1", "end"), ("b", "loop", "loop"), ("c", "A", "\U0001f600"), ("c", "\U0001f600", "\uffee"), ("c", "\uffee", "\U0001f600")}
    df = spark.createDataFrame(sorted(edges), "repository_id string, src string, dst string")
    want = sorted((r, c) for r in "abc" for c in graph.find_cycles(sorted((s, d) for x, s, d in edges if x == r)))
    assert sorted((r.repository_id, r.cycle) for r in graph.cycles_by_repository(df).collect()) == want
    kept = graph.toward_search(df)
    assert kept.count() < len(edges) - 50 and kept.where("dst = 'end'").isEmpty()
    assert isinstance(graph.each_cycle([("x", "x")]), GeneratorType)
