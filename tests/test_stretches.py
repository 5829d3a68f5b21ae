"""A search in stretches, whose cycles other tasks list, against the search in one process."""

import random

import pytest

from lodestone.operators import graph


@pytest.mark.parametrize(("stretch", "paths", "listed"), [(1 << 21, 8, 1 << 18), (9, 1, 5), (1, 0, 1)])
def test_cycles_of_stretches(spark, monkeypatch, stretch, paths, listed):
    for name, value in (("STRETCH", stretch), ("PATHS", paths), ("LISTED", listed)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(stretch)
    edges = {r: sorted({(f"{rng.randrange(n):02}", f"{rng.randrange(n):02}") for _ in range(4 * n)}) for r, n in (("one", 25), ("two", 12), ("three", 2))} | {"four": [("a", "a"), ("a", "b")]}
    found = graph.cycles_by_repository(spark.createDataFrame([(r, *e) for r, es in edges.items() for e in es], "repository_id string, src string, dst string"))
    rows = sorted((r.repository_id, r.cycle) for r in found.collect())
    assert rows == sorted((r, c) for r, es in edges.items() for c in graph.find_cycles(es))
    if stretch == 1:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan[: plan.rindex("MapInArrow")]  # cycles aren't listed where they are found
