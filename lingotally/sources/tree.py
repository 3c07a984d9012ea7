"""File trees as a data source: hidden names are listed, symbolic links are not followed, heads are partial reads.

Directories are the partitions: the driver walks down only until there are enough of them, the tasks list what
lies below and read the first bytes of each file. Filters on path and length reach the source, so files that a
query rules out are never opened. Local paths go through the operating system, others through the file systems of
pyarrow (hdfs, s3, gs and others).
"""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as D

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, length bigint, modificationTime timestamp, head binary"
BATCH = 1000
COMPARE = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b,
    D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: lambda a, b: b in a,
}


def is_local(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")


def local_path(path: str) -> str:
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")


def remote(path: str):
    """File system and its own form of the path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def head_of(path: str, n: int) -> bytes | None:
    """First ``n`` bytes of a file, no more are read; None if it cannot be opened."""
    try:
        if is_local(path):
            fd = os.open(local_path(path), os.O_RDONLY)
            try:
                return os.read(fd, n)
            finally:
                os.close(fd)
        fs, own = remote(path)
        with fs.open_input_file(own) as f:
            return f.read(n)
    except OSError:
        return None


def entries(folder: str) -> tuple[list[str], list[tuple[str, int, float]]]:
    """Directories and files (path, length, seconds) directly in a folder; unreadable ones are empty."""
    folders, files = [], []
    if is_local(folder):
        try:
            found = sorted(os.scandir(local_path(folder)), key=lambda e: e.name)
        except OSError:
            return [], []
        for e in found:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue  # gone meanwhile
            if stat.S_ISDIR(s.st_mode):
                folders.append(f"file:{e.path}")
            elif stat.S_ISREG(s.st_mode):
                files.append((f"file:{e.path}", s.st_size, s.st_mtime))
        return folders, files
    from pyarrow.fs import FileSelector, FileType

    fs, own = remote(folder)
    for e in sorted(fs.get_file_info(FileSelector(own)), key=lambda e: e.path):
        name = f"{folder.rstrip('/')}/{e.base_name}"
        if e.type == FileType.Directory:
            folders.append(name)
        elif e.type == FileType.File:
            files.append((name, e.size, e.mtime.timestamp() if e.mtime else 0.0))
    return folders, files


class Part(D.InputPartition):
    """A folder; ``deep``: with all below it."""

    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class TreeReader(D.DataSourceReader):
    def __init__(self, root: str, head: int, parts: int):
        self.root, self.head, self.parts = root, head, parts
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Tests of path and length are made before a file is opened; the others are Spark's."""
        for f in filters:
            value = getattr(f, "value", None)
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in ("path", "length") and value is not None:
                self.tests.append((f.attribute[0], type(f), value))
            elif not (isinstance(f, D.IsNotNull) and f.attribute in (("path",), ("length",))):
                yield f

    def partitions(self) -> list[Part]:
        """Folders, from the top down until there are enough; those opened on the way keep their own files."""
        done, todo = [], [self.root if not is_local(self.root) else f"file:{os.path.abspath(local_path(self.root))}"]
        while todo and len(done) + len(todo) < self.parts:
            below = []
            for folder in todo:
                done.append(Part(folder, False))
                below += entries(folder)[0]
            todo = below
        return done + [Part(folder, True) for folder in todo]

    def wanted(self, path: str, length: int) -> bool:
        own = {"path": path, "length": length}
        return all(COMPARE[kind](own[name], value) for name, kind, value in self.tests)

    def files(self, part: Part) -> Iterator[tuple[str, int, float]]:
        todo = [part.folder]
        while todo:
            folders, files = entries(todo.pop())
            if part.deep:
                todo += reversed(folders)
            yield from (f for f in files if self.wanted(f[0], f[1]))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, length, seconds in self.files(part):
            head = head_of(path, self.head) if self.head else None
            rows.append((path, length, datetime.fromtimestamp(seconds, timezone.utc), head))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["path", "length", "modificationTime", "head"])


class TreeSource(D.DataSource):
    """``spark.read.format("file_tree").option("head", 16).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("head", 0)), int(self.options.get("parts", 64)))


def load_tree(spark: SparkSession, root: str, head: int = 0, parts: int = 64) -> DataFrame:
    """path, length, modificationTime and, if ``head`` is not 0, the first ``head`` bytes of every file below ``root``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    tree = spark.read.format("file_tree").option("head", head).option("parts", parts).load(root)
    return tree if head else tree.drop("head")


def with_heads(files: DataFrame, n: int) -> DataFrame:
    """``files`` with ``head``: the first ``n`` bytes at ``path``, null where it cannot be opened."""
    @F.pandas_udf("binary")
    def read(paths):
        return paths.map(lambda p: None if p is None else head_of(p, n))

    return files.withColumn("head", read(F.col("path")))
