"""Dependency graph: k-hop dependents and dependencies, cycles, unresolved imports, key files.

Edges are (src, dst): the file src refers to the file dst. The depth is known when the plan is made
and at most MAX_DEPTH, so each hop is one join of an unrolled plan, and many roots go at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_lax, like_any
from . import cells, components, reach

MAX_DEPTH = 5
EDGE_TYPES = ("import", "re_export", "export_all")

# Domain to LIKE patterns of its paths.
DOMAINS = {
    "database": ["src/db/%", "app/src/db/%"],
    "api": ["src/api/%", "src/mcp/%", "app/src/api/%", "app/src/mcp/%"],
    "indexer": ["src/indexer/%", "app/src/indexer/%"],
    "testing": ["tests/%", "app/tests/%", "__tests__/%"],
    "claude-config": [".claude/%"],
    "agent-authoring": [".claude/agents/%"],
    "automation": [".claude/commands/automation/%"],
    "github": [".github/%"],
    "documentation": ["web/docs/%", "docs/%"],
}


def edges_of(references: DataFrame, files: DataFrame, types: tuple[str, ...] = EDGE_TYPES, by_repository: bool = True) -> DataFrame:
    """(repository_id, src, dst) of references to files that are there; without ``by_repository`` a path of any repository counts."""
    source = files.select(F.col("id").alias("file_id"), F.col("path").alias("src"))
    target = files.select(F.col("path").alias("target_file_path"), F.col("repository_id").alias("_repo"))
    found = references.where(F.col("reference_type").isin(*types)).join(source, "file_id").join(target, "target_file_path")
    if by_repository:
        found = found.where(F.col("_repo") == F.col("repository_id"))
    return found.select("repository_id", "src", F.col("target_file_path").alias("dst"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))


def walked(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, path, closed) of all walks against the edges from the roots, without a repeat, that don't go on within ``depth``.

    ``path`` begins at the node of depth one; ``closed`` is the path with the node that it has
    already, where the next step would have been such a node, and null else. Each hop is one join:
    a walk that has ended keeps a key that no node has, spread evenly, so nothing of it is worked
    out again for the shorter walks, which are the beginnings of these.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    step = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
    none = F.lit(None).cast("array<string>")
    now = roots.select("root").distinct().join(step, F.col("root") == F.col("_from")).select("root", F.array("_to").alias("path"), none.alias("closed"), F.lit(True).alias("open"))
    for _ in range(2, depth + 1):
        ended = F.concat(F.lit("\x00"), F.xxhash64("root", "path", "closed").cast("string"))
        grown = now.withColumn("_at", F.when(F.col("open"), F.element_at("path", -1)).otherwise(ended)).join(step, F.col("_at") == F.col("_from"), "left")
        on, back = F.col("_to").isNotNull(), F.coalesce(F.array_contains("path", F.col("_to")), F.lit(False))
        longer = F.concat("path", F.array("_to"))
        now = grown.select("root", F.when(on & ~back, longer).otherwise(F.col("path")).alias("path"), F.when(back, longer).otherwise(F.col("closed")).alias("closed"), (on & ~back).alias("open"))
    return now.select("root", "path", "closed")


def walks(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """What walks against the edges reach from the roots, and those that close on themselves, each once.

    The first: (root, depth, node); a root in a cycle comes back at a later depth, and a node may have
    several depths. The second: (root, path) of each cycle whose last node repeats one on the
    walk, from walks shorter than ``depth``; depth 1 has none.
    """
    rows = walked(edges, roots, depth)
    found = rows.select("root", F.posexplode("path").alias("at", "node")).select("root", (F.col("at") + 1).alias("depth"), "node").distinct()
    return found, rows.where("closed is not null").select("root", F.col("closed").alias("path")).distinct()


def reached(edges: DataFrame, roots: DataFrame, depth: int, include_tests: bool = True, many: bool = False) -> DataFrame:
    """(root, depth, node), each once: what depends on the roots; ``reverse(edges)`` gives what they depend on.

    A node may have several depths. Walks are not listed: what is carried has a bound for each root and node.
    With ``many`` roots the edges are numbered and dealt into cells, and what is reached isn't shuffled.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    found = (cells if many else reach).reached(edges, roots, depth)
    return found if include_tests else found.where(~is_test_lax(F.col("node")))


def dependency_counts(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth_1, ...) for each root: how many nodes it reaches at each depth, without a list of them."""
    found = cells.counted(edges, roots, depth)
    levels = found.groupBy("root").agg(*[F.max(F.when(F.col("depth") == d, F.col("n"))).alias(f"depth_{d}") for d in range(1, depth + 1)])
    names = [f"depth_{d}" for d in range(1, depth + 1)]
    return roots.select("root").distinct().join(levels.hint("merge"), "root", "left").select("root", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names])


def closed_walks(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, path): the second of ``walks``, over the edges that can lead to a cycle only."""
    back = reverse(edges)  # walks go against the edges
    pruned = components.toward_cycles(back, components.strong_components(back), depth)
    return walks(reverse(pruned), roots, depth)[1]


def dependency_result(edges: DataFrame, roots: DataFrame, depth: int, include_tests: bool = True) -> DataFrame:
    """One row for each root: direct, indirect (map from depth_N), cycles."""
    found = reached(edges, roots, depth, include_tests).select("root", "depth", F.array("node").alias("path"))
    if depth > 1:
        # depth 0 stands for cycles
        found = found.union(closed_walks(edges, roots, depth).select("root", F.lit(0).alias("depth"), "path"))
    levels = found.groupBy("root", "depth").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    nodes = F.when(F.col("depth") > 0, F.flatten("paths"))
    by_root = levels.groupBy("root").agg(
        F.first(F.when(F.col("depth") == 1, nodes), ignorenulls=True).alias("direct"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("depth") > 1, F.struct(F.concat(F.lit("depth_"), F.col("depth").cast("string")).alias("key"), nodes.alias("nodes")))))).alias("indirect"),
        F.first(F.when(F.col("depth") == 0, F.col("paths")), ignorenulls=True).alias("cycles"),
    )
    empty = F.array().cast("array<string>")
    return roots.select("root").distinct().join(by_root, "root", "left").select(
        "root",
        F.coalesce("direct", empty).alias("direct"),
        F.coalesce("indirect", F.create_map().cast("map<string,array<string>>")).alias("indirect"),
        F.coalesce("cycles", F.array().cast("array<array<string>>")).alias("cycles"),
    )


def rotated(cycle) -> Column:
    """A closed walk [a, b, a] as its nodes from the smallest on, the same for each start."""
    open_ = F.slice(cycle, 1, F.size(cycle) - 1)
    at = F.array_position(open_, F.array_min(open_)).cast("int")
    return F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, 1, at - 1))


def cycle_core(cycle) -> Column:
    """The closed part of a walk that ends where it was before."""
    last = F.element_at(cycle, -1)
    return F.slice(cycle, F.array_position(cycle, last).cast("int"), F.size(cycle))


def distinct_cycles(cycles: DataFrame) -> DataFrame:
    """The different cycles, wherever they were entered."""
    return cycles.select(rotated(cycle_core(F.col("path"))).alias("cycle")).distinct()


def find_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Depth-first: one closed list for each edge back onto the current path, in order of the edges."""
    return list(each_cycle(edges))


def each_cycle(edges: Iterable[tuple]) -> Iterator[list]:
    """``find_cycles`` one by one, so that no more than the edges and the current path are held."""
    path: list = []
    for size, node, back in search_steps(edges):
        if back < 0:
            path[size:] = [node]
        else:
            yield [*path[back:size], node]


def search_steps(edges: Iterable[tuple]) -> Iterator[tuple]:
    """(size, node, back) of a depth-first search: behind ``size`` nodes of the path comes the node, which is put there if ``back`` is -1, or stands at that place already."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    done: set = set()
    for start in list(after):
        if start in done:
            continue
        path, at, pending = [start], {start: 0}, [iter(after[start])]
        yield 0, start, -1
        while pending:
            node = next(pending[-1], None)
            if node is None:
                done.add(path[-1])
                del at[path.pop()]
                pending.pop()
            elif node in at:
                yield len(path), node, at[node]
            elif node not in done:
                yield len(path), node, -1
                at[node] = len(path)
                path.append(node)
                pending.append(iter(after.get(node, ())))


def toward_search(edges: DataFrame) -> DataFrame:
    """(repository_id, src, dst) of the edges that a depth-first search by name needs; the others find what is done or has no edge.

    A node without an edge in is met as a start only, in order of names: of such nodes that refer to
    a file, those after the first come when it is done.
    """
    step = edges.select("repository_id", "src", "dst").where("src is not null and dst is not null").distinct()
    on = step.select("repository_id", F.col("src").alias("dst")).distinct().hint("merge")
    step = step.join(on, ["repository_id", "dst"], "left_semi")
    met = edges.select("repository_id", F.col("dst").alias("src")).distinct().withColumn("_met", F.lit(True)).hint("merge")
    step = step.join(met, ["repository_id", "src"], "left").select("repository_id", "src", "dst", F.col("_met").isNotNull().alias("met"))
    first = step.where("NOT met").groupBy("repository_id", "dst").agg(F.min("src").alias("src"))
    return step.where("met").select("repository_id", "src", "dst").unionByName(first)


#: Names of the cycles of one stretch of a search, about, and as a multiple of its path; names that leave a task at once.
STRETCH, PATHS, LISTED = 1 << 21, 8, 1 << 18


def cycles_by_repository(edges: DataFrame) -> DataFrame:
    """(repository_id, cycle) by depth-first search, which has one order, so one repository is searched in a task.

    Of its edges the task holds those of ``toward_search``, by number. Cycles add up to far more than the edges; they
    are not listed there: the search leaves in stretches, each with the path at its beginning, whose cycles any task lists.
    """
    # sorted by bytes, as names are
    dealt = toward_search(edges).repartition("repository_id").sortWithinPartitions("repository_id", "src", "dst")
    parts = dealt.mapInArrow(_searching(STRETCH, PATHS), _STRETCHES)
    spread = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(spread, "repository_id", "stretch").mapInArrow(_cycles_of(LISTED), "repository_id string, cycle array<string>")


_STRETCHES = "repository_id string, stretch int, names array<string>, path array<int>, sizes array<int>, nodes array<int>, backs array<int>"


def _searching(most: int, paths: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches of the searches of the repositories, whose edges come in order."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
        numbers = np.asarray(ends.indices)
        repository, number, path, steps, listed = rows["repository_id"][0].as_py(), 0, [], [], 0
        begin: list = []

        def sent() -> pa.RecordBatch:
            sizes, nodes, backs = np.array(steps, np.int32).T
            own, places = np.unique(np.concatenate([np.array(begin, np.int32), nodes]), return_inverse=True)
            lists = [ends.dictionary.take(pa.array(own)), *(pa.array(x, pa.int32()) for x in (places[: len(begin)], sizes, places[len(begin) :], backs))]
            return pa.RecordBatch.from_arrays([pa.array([repository], pa.string()), pa.array([number], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], [c.split()[0] for c in _STRETCHES.split(", ")])

        for size, node, back in search_steps(zip(numbers[: len(rows)].tolist(), numbers[len(rows) :].tolist(), strict=True)):
            if not steps:
                begin = path[:size]
            steps.append((size, node, back))
            if back < 0:
                path[size:] = [node]
                continue
            listed += size - back + 1
            if listed >= max(most, paths * size):
                yield sent()
                number, steps, listed = number + 1, [], 0
        if listed:
            yield sent()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column("repository_id").to_pylist()
            cuts = [0, *(k for k in range(1, len(of)) if of[k] != of[k - 1]), len(of)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and held[-1].column("repository_id")[0].as_py() != of[begin]:
                    yield from found(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _cycles_of(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cycles of stretches, some at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                names, begin, sizes, nodes, backs = (batch.column(c)[k].values for c in ("names", "path", "sizes", "nodes", "backs"))
                path, sizes, repository = np.zeros(max(len(begin), int(np.max(sizes)) + 1), np.int32), sizes.to_pylist(), batch.column("repository_id")[k].as_py()
                path[: len(begin)] = begin
                flat, ends = [], [0]

                def sent() -> pa.RecordBatch:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.concatenate(flat))))
                    return pa.RecordBatch.from_arrays([pa.array([repository] * (len(ends) - 1), pa.string()), lists], ["repository_id", "cycle"])

                for size, node, back in zip(sizes, nodes.to_pylist(), backs.to_pylist(), strict=True):
                    if back < 0:
                        path[size] = node
                        continue
                    flat += [path[back:size].copy(), path[back : back + 1].copy()]
                    ends.append(ends[-1] + size - back + 1)
                    if ends[-1] >= most:
                        yield sent()
                        flat, ends = [], [0]
                if flat:
                    yield sent()

    return run


def unresolved(references: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(repository_id, source): the modules that references without a target name, each once."""
    found = references.where(F.col("target_file_path").isNull()).select("repository_id", F.get_json_object("metadata", "$.importSource").alias("source"))
    return found.where("source is not null").distinct()


def key_files(edges: DataFrame, patterns: list[str], limit: int, prefix: str = "dst") -> DataFrame:
    """Files under the patterns with the most files that import them, each counted once."""
    found = edges.where(like_any(F.col(prefix), patterns)).groupBy("dst").agg(F.count_distinct("src").alias("dependents"))
    return found.orderBy(F.desc("dependents"), "dst").limit(limit)


def domain_key_files(edges: DataFrame, domain: str, limit: int = 10) -> DataFrame:
    return key_files(edges, DOMAINS.get(domain, []), limit)


def domain_files(files: DataFrame, domain: str, limit: int = 50) -> DataFrame:
    return files.where(like_any(F.col("path"), DOMAINS.get(domain, []))).orderBy(F.desc("indexed_at"), "path").limit(limit).select("path")


def available_domains(files: DataFrame, domains: dict[str, list[str]] = DOMAINS) -> DataFrame:
    """(domain) of those with a file at least, in one scan."""
    hits = F.array_compact(F.array(*[F.when(like_any(F.col("path"), p), F.lit(d)) for d, p in domains.items()]))
    return files.select(F.explode(hits).alias("domain")).distinct()


def flat_dependencies(edges: DataFrame, path: str, depth: int, include_tests: bool) -> Iterator[tuple[str, list[str]]]:
    """(kind, paths) for a command line: dependents, dependencies and, of the dependents shown, the tests."""
    roots = edges.sparkSession.createDataFrame([(path,)], "root string")
    names = lambda df: sorted({r.node for r in df.collect()})  # noqa: E731  a command line shows them all
    dependents = names(reached(edges, roots, depth, include_tests))
    yield "dependents", dependents
    yield "dependencies", names(reached(reverse(edges), roots, depth))
    yield "testFiles", [p for p in dependents if "test" in p or "spec" in p]
