"""Hops made inside tasks, by numbers, against plain searches, and what they shuffle."""

import random

import numpy as np
import pytest

from lodestone.operators import cells, graph, walked

from .test_graph import brute


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
def test_frontiers_on_random_graphs(depth):
    rng = random.Random(depth)
    for _ in range(150):
        n = rng.randrange(2, 12)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 5 * n))}
        after = {a: sorted(y for x, y in edges if x == a and y != a) for a in range(n)}
        core = walked.Steps(np.array([len(after[k]) for k in range(n)]), np.array([y for k in range(n) for y in after[k]], np.int64))
        first = sorted(edges)
        got = {}
        for hop, (root, node, met) in enumerate(walked.frontiers(core, np.array([a for a, _ in first]), np.array([b for _, b in first]), depth), 2):
            assert len(set(zip(root.tolist(), node.tolist(), strict=True))) == len(root)
            for r, v, m in zip(root.tolist(), node.tolist(), met.tolist(), strict=True):
                got.setdefault(r, set()).update((hop, x) for x in after[v] if x not in m)
        back = [(b, a) for a, b in edges]
        for r in range(n):
            assert got.get(r, set()) == {(d, x) for d, x in brute(back, r, depth)[0] if d > 1}


@pytest.mark.parametrize(("depth", "core"), [(2, 1 << 23), (3, 1 << 23), (4, 1 << 23), (5, 1 << 23), (5, 1)])
def test_cells_in_tasks_and_by_joins(spark, monkeypatch, depth, core):
    """Several blocks, lists of names and batches; with no room for the core, as before."""
    for name, value in (("WIDTH", 4), ("CORE", core), ("NAMES", 3), ("SENT", 5), ("WALKS", 7), ("GROUP", 3)):
        monkeypatch.setattr(cells, name, value)
    if core > 1:
        monkeypatch.setattr(cells, "families", None)  # not needed
    rng = random.Random(depth)
    edges = sorted({(f"n{rng.randrange(13)}", f"n{rng.randrange(13)}") for _ in range(45)} | {(f"leaf{i}", "n1") for i in range(9)})
    found = graph.reached(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"n{i}",) for i in range(13)], "root string"), depth, many=True).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == {(f"n{i}", d, x) for i in range(13) for d, x in brute(edges, f"n{i}", depth)[0]}


def test_no_row_between_hops_is_staged(spark):
    """Sixty roots of a dense core: what goes on from them at later hops stands in no shuffle and no table."""
    edges = [(f"n{i}", f"n{j}") for i in range(60) for j in range(60) if i != j]
    found = graph.reached(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"n{i}",) for i in range(60)], "root string"), 5, many=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "s0" not in plan and plan.count("MapInArrow") == 1
    assert found.count() == 60 * 59 + 4 * 60 * 60


def test_last_hop_has_one_row_for_a_root_and_node():
    """Where many walks lead, sets are replaced by what they have in common: one row, and nothing met that matters."""
    n = 40
    core = walked.Steps(np.full(n, n - 1), np.array([y for x in range(n) for y in range(n) if x != y]))
    last = list(walked.frontiers(core, np.repeat(np.arange(3), n), np.tile(np.arange(n), 3), 5))
    assert len(last) == 4 and all(len(root) == 3 * n for root, _, _ in last[1:])
    assert (last[-1][2] < 0).all()
    one = list(walked.frontiers(walked.Steps(np.ones(2, int), np.array([1, 0])), np.array([0]), np.array([0]), 3))
    assert [x.tolist() for x in one[-1]] == [[0], [1], [[0]]]
