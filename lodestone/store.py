"""A store of tables: immutable snapshots, and numbered pointer files of which the last names the current one.

A commit writes the changed tables beside the old ones and then adds the next pointer, so readers see
all of it or nothing, and a job that fails leaves the old snapshot. Of two writers that began from
the same pointer the second finds its number taken and fails. Paths may be on any file
system that Spark reads and that renames onto no file that is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .catalog import TABLES

POINTERS = "_commits"
#: What is made of a table: in a pointer, the place of the table that it was made of.
DERIVED = {"_postings_of": ("indexed_files", ("file_postings", "file_lengths")), "_grams_of": ("indexed_symbols", ("symbol_grams",))}


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._utils, self._options = jvm.org.apache.commons.io.IOUtils, jvm.org.apache.hadoop.fs.Options.Rename
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        folder = self._path(f"{self.root}/{POINTERS}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.partition(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def _pointer(self, version: int):
        return self._path(f"{self.root}/{POINTERS}/{version:012d}.json")

    def _places(self, version: int | None = None) -> dict[str, str]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._pointer(version))
        try:
            return json.loads(self._utils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        """The table as the current snapshot has it; empty before its first commit."""
        place = self._places().get(name)
        return self.spark.read.schema(TABLES[name].schema).parquet(f"{self.root}/{place}") if place else self.spark.createDataFrame([], TABLES[name].schema)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names or TABLES}

    def query(self, sql: str, *arguments: object, names: tuple[str, ...] | None = None) -> DataFrame:
        """SQL over the tables by their names, with ``?`` bound in order."""
        for name in names or tuple(n for n in self._places() if n not in DERIVED):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=list(arguments) or None)

    def derived(self, mark: str) -> dict[str, DataFrame]:
        """The tables made of another, or nothing where that has changed since."""
        places, (source, names) = self._places(), DERIVED[mark]
        return self.tables(*names) if mark in places and places[mark] == places.get(source) else {}

    def postings(self) -> dict[str, DataFrame]:
        """The postings of the files and their lengths, if they hold."""
        return self.derived("_postings_of")

    def grams(self) -> dict[str, DataFrame]:
        """The grams of the symbols' names, if they hold."""
        return self.derived("_grams_of")

    def exists(self, name: str) -> bool:
        return name in self._places()

    def commit(self, changed: dict[str, DataFrame], began: int | None = None) -> int:
        """Make all changed tables current at once; the number of the commit.

        ``began`` is the version that the changes were made from, the current one by default. If
        another commit has come after it, this raises Conflict and leaves the store as it is.
        """
        began = self.version() if began is None else began
        places = self._places(began)
        for name, rows in changed.items():
            place = f"{name}/{uuid.uuid4().hex}"
            rows, sort = rows.select(*TABLES[name].columns), TABLES[name].sort
            (rows.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else rows).write.parquet(f"{self.root}/{place}")
            places[name] = place
        for mark, (source, names) in DERIVED.items():
            if names[0] in changed and source in places:
                places[mark] = places[source]
        temporary = self._path(f"{self.root}/{POINTERS}/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(json.dumps(places).encode()))
        stream.close()
        modes = self.spark.sparkContext._gateway.new_array(self._options, 1)
        modes[0] = self._options.NONE
        try:
            self._context.rename(temporary, self._pointer(began + 1), modes)
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            if not self._fs.exists(self._pointer(began + 1)):
                raise
            raise Conflict(f"commit {began + 1} is there already") from error
        return began + 1

    def update(self, make: Callable[[], dict[str, DataFrame]], attempts: int = 5) -> int:
        """Commit what ``make`` reads from the store and changes; once more from the start where another commit came between."""
        for attempt in range(attempts):
            began = self.version()
            try:
                return self.commit(make(), began)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("at least one attempt")

    def vacuum(self) -> int:
        """Remove snapshots and pointers that are not current; how many snapshots there were."""
        version = self.version()
        current, gone = set(self._places(version).values()), 0
        for old in range(version - 1, 0, -1):
            if not self._fs.delete(self._pointer(old), False):
                break
        for name in TABLES:
            folder = self._path(f"{self.root}/{name}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{name}/{status.getPath().getName()}" not in current:
                    gone += self._fs.delete(status.getPath(), True)
        return gone

    def compact(self, files: int = 1) -> None:
        """Write each table again into so many files; then snapshots that are not current can go."""
        began = self.version()
        places = self._places(began)
        stale = {n for mark, (source, names) in DERIVED.items() if places.get(mark) != places.get(source) for n in names}
        self.commit({n: self.table(n).coalesce(files) for n in places if n not in DERIVED and n not in stale}, began)

    def size(self) -> int:
        """Bytes of all snapshots."""
        at = self._path(self.root)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0
