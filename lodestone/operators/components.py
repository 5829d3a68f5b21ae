"""Strongly connected components by trimming and forward-backward colouring, and the cycles inside them.

Edges are (src, dst). A node without an edge in or out is in no cycle and is trimmed, over and over. Then the
largest name that reaches a node is its colour, and the nodes of a colour that reach the node of that
name are its component. What is left has other components, which the next round finds. Each step is a join
and an aggregation over edges, staged in between; no list of neighbours or members is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import discard, staged

#: Steps that are planned together before a result is staged and looked at.
STEPS = 3


def trimmed(edges: DataFrame) -> DataFrame:
    """The distinct edges, without a self-loop, of nodes that have an edge in and one out, again and again. Staged."""
    now = staged(edges.select("src", "dst").where("src <> dst").distinct())
    n = now.count()
    while n:
        kept = now
        for _ in range(STEPS):
            kept = kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        last, now = now, staged(kept)
        discard(last)
        left = now.count()
        if left == n:
            break
        n = left
    return now


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour, before): the largest name from which a node is reached, its own included. Staged."""
    now = staged(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        grown = now.withColumn("before", F.col("colour"))
        for _ in range(STEPS):
            sent = edges.join(grown.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_sent"))
            grown = grown.join(sent, "node", "left").select("node", F.greatest("colour", "_sent").alias("colour"), "before")
        last, now = now, staged(grown)
        discard(last)
        if now.where("colour <> before").isEmpty():
            return now


def _reaching(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, colour) of the nodes that reach the node their colour is named for by nodes of that colour. Staged."""
    of = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}"))
    inside = staged(edges.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("colour")))
    now = staged(colours.where("node = colour").select("node", "colour"))
    n = now.count()
    while True:
        grown = now
        for _ in range(STEPS):
            before = inside.join(grown.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour")
            grown = grown.union(before).distinct()
        last, now = now, staged(grown)
        discard(last)
        more = now.count()
        if more == n:
            discard(inside)
            return now
        n = more


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that is in a cycle; the component's name is its smallest node.

    A node that is only in an edge to itself is a component of its own. Null ends are no edges.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    found, left = [], trimmed(edges)
    while not left.isEmpty():
        colours = _coloured(left)
        members = _reaching(left, colours)
        found.append(members)
        rest = left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        last, left = left, trimmed(rest)
        discard(last)
        discard(colours)
    if not found:
        return loops.select("node", F.col("node").alias("component"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    names = all_found.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("_n")).where("_n > 1")
    cyclic = all_found.join(names, "colour").select("node", "component")
    return cyclic.union(loops.join(cyclic, "node", "left_anti").select("node", F.col("node").alias("component")))


def inside(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, component) of the edges inside a component, which are those in a cycle."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    return edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("component"))


def toward_cycles(edges: DataFrame, components: DataFrame, depth: int) -> DataFrame:
    """(src, dst) of the edges from which a walk of at most ``depth`` hops can close on itself: those of components, and those that lead to one."""
    near = components.select("node")
    for _ in range(depth - 2):
        near = near.union(edges.join(near.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"))).distinct()
    return edges.select("src", "dst").distinct().join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def simple_cycles(edges: DataFrame, components: DataFrame, length: int) -> DataFrame:
    """(cycle) of at most ``length`` nodes, each once, from its smallest node on; only edges inside components are walked."""
    step = inside(edges, components).select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    now = step.where("_to >= _from").select(F.col("_from").alias("start"), F.array("_from").alias("path"), F.col("_to").alias("at"))
    out = now.where("at = start").select(F.col("path").alias("cycle"))
    for _ in range(1, length):
        open_ = now.where("at <> start").select("start", F.concat("path", F.array("at")).alias("path"))
        last: Column = F.element_at("path", -1)
        now = open_.withColumn("_at", last).join(step, F.col("_at") == F.col("_from")).where((F.col("_to") == F.col("start")) | ((F.col("_to") > F.col("start")) & ~F.array_contains("path", F.col("_to"))))
        now = now.select("start", "path", F.col("_to").alias("at"))
        out = out.union(now.where("at = start").select("path"))
    return out
