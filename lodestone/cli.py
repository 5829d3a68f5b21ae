"""Command line: ``python -m lodestone.cli ROOT deps|key-files|search|stats ...``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .api import Engine
from .operators import graph


def deps(engine: Engine, path: str, depth: int, include_tests: bool) -> dict[str, list[str]]:
    return {"file": path} | dict(graph.flat_dependencies(engine._edges(engine.repository()), path, depth, include_tests))


def key_files(engine: Engine, domain: str) -> list[dict]:
    """Files of a domain by their direct dependents that aren't tests."""
    edges = engine._edges(engine.repository())
    files = graph.domain_files(engine._files(engine.repository()), domain).selectExpr("path AS root")
    found = graph.reached(edges, files, 1, include_tests=False).groupBy("root").count().orderBy("count", ascending=False)
    return [{"path": r["root"], "dependents": r["count"]} for r in found.collect()]


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root", help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("deps")
    one.add_argument("path")
    one.add_argument("--depth", type=int, default=1)
    one.add_argument("--include-tests", action="store_true")
    commands.add_parser("key-files").add_argument("domain")
    commands.add_parser("search").add_argument("query")
    commands.add_parser("index").add_argument("path")
    commands.add_parser("stats")
    a = parser.parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), a.root)
    run = {"deps": lambda: deps(engine, a.path, a.depth, a.include_tests), "key-files": lambda: key_files(engine, a.domain), "search": lambda: engine.search(a.query), "index": lambda: engine.index_repository(a.path), "stats": engine.get_index_statistics}
    print(json.dumps(run[a.command](), indent=2, default=str))


if __name__ == "__main__":
    main()
