"""Reach by representative families, and components by colouring, against plain searches."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import components, graph, reach

from .test_graph import brute


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def test_families_represent_all_sets():
    rng = random.Random(1)
    for _ in range(200):
        size, left, names = rng.choice([1, 2, 3]), rng.choice([0, 1, 2, 3]), rng.choice([4, 6, 9])
        sets = np.array([rng.sample(range(names), size) for _ in range(rng.randrange(1, 60))])
        groups = np.array([rng.randrange(2) for _ in sets])
        kept = reach.representatives(groups, sets, left)
        for g in (0, 1):
            full, some = ([set(x) for x, y in zip(sets[i].tolist(), groups[i], strict=True) if y == g] for i in (np.arange(len(sets)), kept))
            assert len(some) <= reach.limits(size, left)[0]
            for further in map(set, itertools.combinations(range(names), min(left, names))):
                assert any(not further & x for x in full) == any(not further & x for x in some)


@pytest.mark.parametrize(("depth", "nodes", "n"), [(2, 12, 30), (3, 12, 40), (4, 11, 40), (5, 9, 30), (5, 14, 45)])
def test_reached_on_random_graphs(spark, depth, nodes, n):
    rng = random.Random(depth * nodes)
    edges = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)}
    roots = spark.createDataFrame([(f"n{i}",) for i in range(nodes)] * 2, "root string")
    got = graph.reached(frame(spark, edges), roots, depth).collect()
    assert len(got) == len(set(got))
    for i in range(nodes):
        assert {(r.depth, r.node) for r in got if r.root == f"n{i}"} == brute(sorted(edges), f"n{i}", depth)[0]


def test_rows_of_a_hub_are_bounded(spark):
    """Sixty nodes that all refer to each other have millions of walks of five hops; what is kept has a bound for each root and node."""
    edges = frame(spark, {(f"n{i}", f"n{j}") for i in range(60) for j in range(60) if i != j})
    root = spark.createDataFrame([("n0",)], "root string")
    for rows, most in zip(reach.families(edges, root, 5), [1, 4, 7, 4, 1], strict=True):
        per = rows.groupBy("root", "node").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("firsts")).agg(F.max("n"), F.min("firsts"), F.max("firsts"), F.count("*")).first()
        assert per[0] <= most and per[1] == per[2] == 1 and per[3] in (59, 60)


def test_batches_of_one_pair(spark):
    """A pair of root and node that fills many batches is reduced as one."""
    edges = frame(spark, {(f"a{i}", "r") for i in range(40)} | {(f"b{j}", f"a{i}") for i in range(40) for j in range(12)} | {("hub", f"b{j}") for j in range(12)} | {("next", "hub")})
    root = spark.createDataFrame([("r",)], "root string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        hops = reach.families(edges, root, 5)
        assert hops[2].where("node = 'hub'").count() <= 7 and hops[2].where("node = 'hub' and first").count() == 1
        assert {(r.depth, r.node) for r in reach.reached(edges, root, 5).where("node in ('hub', 'next')").collect()} == {(3, "hub"), (4, "next")}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def strong(edges):
    """By reachability: the smallest node of each node's component, for nodes in a cycle."""
    nodes = {x for e in edges for x in e}
    reach_ = {x: {b for a, b in edges if a == x} for x in nodes}
    while True:
        more = {x: set.union(ys, *(reach_[y] for y in ys)) if ys else ys for x, ys in reach_.items()}
        if more == reach_:
            break
        reach_ = more
    return {x: min(y for y in reach_[x] if x in reach_[y]) for x in nodes if x in reach_[x]}


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 30, 35), (2, 30, 45), (3, 12, 10)])
def test_components_by_reachability(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)} | {("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z3", "y1"), ("y1", "y2"), ("y2", "y1"), ("s", "s")}
    df = frame(spark, edges)
    found = components.strong_components(df)
    expected = strong(edges)
    assert {r.node: r.component for r in found.collect()} == expected and found.count() == len(expected)
    within = components.inside(df, found)
    assert {(r.src, r.dst) for r in within.collect()} == {(a, b) for a, b in edges if a in expected and expected.get(a) == expected.get(b)}


def test_no_cycles(spark):
    assert components.strong_components(frame(spark, {("a", "b"), ("b", "c"), ("a", "c")})).collect() == []
    assert components.strong_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_cycles_and_closed_walks(spark):
    rng = random.Random(9)
    edges = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(24)}
    df = frame(spark, edges)
    found = [tuple(r.cycle) for r in components.simple_cycles(df, components.strong_components(df), 4).collect()]
    nodes = sorted({x for e in edges for x in e})
    expected = {c for k in range(1, 5) for c in itertools.permutations(nodes, k) if c[0] == min(c) and all(e in edges for e in zip(c, [*c[1:], c[0]], strict=True))}
    assert set(found) == expected and len(found) == len(expected) > 3
    roots = spark.createDataFrame([(x,) for x in nodes], "root string")
    for depth in (2, 3, 4):
        rows = {(r.root, *r.path) for r in graph.closed_walks(df, roots, depth).collect()}
        assert rows == {(x, *c) for x in nodes for c in brute(sorted(edges), x, depth)[1]}
