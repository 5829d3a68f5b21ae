"""A stream of the changes of a source tree, as a data source: create, change and delete.

An offset is a listing of the watched files with their times and sizes, so what lies between two
offsets is the difference of two listings, the same whenever it is read again after a failure; its
parts are cut into partitions. No collector outside is needed. The folder must be where the driver can
list it, as a watcher's is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "lodestone_tree"
SCHEMA = "type string, path string, timestamp bigint"
#: Events of a partition.
PART = 10_000


def listing(root: str, ignored: list[str], extensions: list[str]) -> dict[str, list[int]]:
    """Time in nanoseconds and size of each watched file below a folder, by its relative path; folders that go meanwhile are left out."""
    fits, skipped = re.compile(rf"\.({'|'.join(map(re.escape, extensions))})$"), frozenset(ignored)
    out: dict[str, list[int]] = {}
    pending = [""]
    while pending:
        at = pending.pop()
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except OSError:
            continue
        for entry in entries:
            path = f"{at}/{entry.name}" if at else entry.name
            try:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in skipped:
                        pending.append(path)
                elif fits.search(entry.name) and entry.is_file():
                    of = entry.stat()
                    out[path] = [of.st_mtime_ns, of.st_size]
            except OSError:
                continue
    return dict(sorted(out.items()))


def differences(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str, int]]:
    """(type, path, milliseconds) by path; a file that is gone has the time that it had."""
    rows = [("create" if p not in before else "change", p, of[0] // 1_000_000) for p, of in after.items() if before.get(p) != of]
    return sorted(rows + [("delete", p, of[0] // 1_000_000) for p, of in before.items() if p not in after], key=lambda r: r[1])


class Events(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.rows = rows


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.existing = options["path"], options.get("existing", "false").lower() == "true"
        self.ignored, self.extensions = options["ignored"].split(","), options["extensions"].split(",")

    def initialOffset(self) -> dict:
        return {"files": {} if self.existing else listing(self.root, self.ignored, self.extensions)}

    def latestOffset(self, *_: object) -> dict:
        return {"files": listing(self.root, self.ignored, self.extensions)}

    def partitions(self, start: dict, end: dict) -> list[Events]:
        rows = differences(start["files"], end["files"])
        return [Events(rows[i : i + PART]) for i in range(0, max(len(rows), 1), PART)]

    def read(self, partition: Events) -> Iterator[tuple[str, str, int]]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Options: path, existing ("true": files that are there at the start come as created), ignored and extensions, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def changes(spark: SparkSession, root: str, ignored: list[str], extensions: list[str], existing: bool = False) -> DataFrame:
    """The stream of (type, path, timestamp); a change is seen when a file's time or size is another."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format(NAME).option("path", root).option("existing", existing).option("ignored", ",".join(ignored)).option("extensions", ",".join(extensions)).load()
