"""Shared parts: connected components and ranks inside groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, components, place, ranked, shared_dir, staged, temporary, values


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)],
        "chain": [(i, i + 1) for i in random.Random(1).sample(range(150), 150)],
        "star": [(700, i) for i in range(600)] + [(-5, 700)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    want = {x: r for x, r in brute([e for e in edges if e[0] != e[1]]).items()}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaab"), rng.randrange(1000)) for _ in range(300)]
    out = ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], F.col("v") % 7, ["v"], "r").collect()
    by = defaultdict(list)
    for r in out:
        by[r.k].append((r.r, r.v))
    for of in by.values():
        assert sorted(x for x, _ in of) == list(range(len(of)))
        assert [v for _, v in sorted(of)] == sorted((v for _, v in of), key=lambda v: (v % 7, v))


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉ Straße İI", "", None, "KK"]
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()]
    assert got == [(t or "").translate(up) for t in texts]


def test_values(spark):
    rows = [("it's", 1), ("back\\slash", 2), ("plain", 3)]
    assert [tuple(r) for r in values(spark, rows, "s string, n bigint").collect()] == rows


def test_what_is_staged_goes(spark):
    import os

    gone = lambda folder: not os.path.exists(folder.removeprefix("file:"))
    outside = staged(spark.range(3).toDF("a"))
    with temporary(spark) as places:
        staged(spark.range(5).toDF("b"))
        kept = staged(spark.range(7).toDF("c"))
        roots = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
        inside = list(places)
        places.remove(place(kept))
    assert len(roots) == 41 and len(inside) == 3 and all(gone(x) == (x != place(kept)) for x in inside)
    assert outside.count() == 3 and kept.count() == 7


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(N(sparkContext=N(getConf=lambda: conf, getCheckpointDir=lambda: None, master="yarn"), conf=conf))
