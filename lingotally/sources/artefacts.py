"""One named file per artefact, as the manifest names them: a data source writer with commit and abort.

Every task writes into a staging folder of its own attempt, part after part of one file at a time. On commit the
driver moves the files of the attempts that succeeded to their names and then writes the list ``_ARTEFACTS``;
whatever failed or repeated attempts left goes with the staging folder. Readers trust a folder with the list.
"""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import datasource as D

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "name string, part bigint, body string"
LIST = "_ARTEFACTS"
THREADS = 16


def file_system(root: str):
    """File system of a folder and its own form of the path."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if root.startswith("/"):
        return LocalFileSystem(), root
    if root.startswith("file:"):
        return LocalFileSystem(), "/" + root[5:].lstrip("/")
    return FileSystem.from_uri(root)


def checked(name: str | None) -> str:
    """A name below the folder."""
    if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
        raise ValueError(f"not a name of an artefact: {name!r}")
    return name


@dataclass
class Written(D.WriterCommitMessage):
    """Names that one attempt wrote, and where."""

    folder: str
    names: list[str]


class ArtefactWriter(D.DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(f"{self.staging}/{uuid.uuid4().hex}")
        names: list[str] = []
        made: set[str] = set()
        out = None
        try:
            for batch in iterator:
                for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                    if not names or name != names[-1]:
                        if out is not None:
                            out.close()
                        path = f"{folder}/{checked(name)}"
                        above = posixpath.dirname(path)
                        if above not in made:
                            fs.create_dir(above, recursive=True)
                            made.add(above)
                        out = fs.open_output_stream(path)
                        names.append(name)
                    out.write((body or "").encode("utf-8", "replace"))
        finally:
            if out is not None:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.root)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an artefact was written twice")
        before = self._listed(fs, root)
        if before is not None:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError(f"{self.root} holds artefacts already")
            fs.delete_file(f"{root}/{LIST}")
        for above in sorted({posixpath.dirname(f"{root}/{n}") for n in names}):
            fs.create_dir(above, recursive=True)
        moves = [(f"{m.folder}/{n}", f"{root}/{n}") for m in done for n in m.names]
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda x: fs.move(*x), moves))
            new = set(names)
            list(pool.map(lambda n: fs.delete_file(f"{root}/{n}"), [n for n in before or [] if n not in new]))
        with fs.open_output_stream(f"{root}/{LIST}") as f:
            f.write("".join(f"{n}\n" for n in sorted(names)).encode())
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(file_system(self.root)[0])

    @staticmethod
    def _listed(fs, root: str) -> list[str] | None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{LIST}").type != FileType.File:
            return None
        with fs.open_input_stream(f"{root}/{LIST}") as f:
            return f.read().decode().splitlines()

    def _clear(self, fs) -> None:
        """The staging folder of this job alone."""
        from pyarrow.fs import FileType

        folder = file_system(self.staging)[1]
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class ArtefactSource(D.DataSource):
    """``df.write.format("artefact_files").mode("append").save(folder)``, or "overwrite" to replace an earlier set."""

    @classmethod
    def name(cls) -> str:
        return "artefact_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ArtefactWriter:
        return ArtefactWriter(self.options["path"], overwrite)


def write_artefacts(parts: DataFrame, out: str, overwrite: bool = True) -> None:
    """Write ``parts`` (name, part, body) as one file per name below ``out``, its parts in order.

    All parts of a file meet in one task, which streams them; no cell holds more than a part. Without
    ``overwrite`` a folder that holds artefacts already is an error.
    """
    parts.sparkSession.dataSource.register(ArtefactSource)
    dealt = parts.select("name", F.col("part").cast("bigint"), "body").repartition("name").sortWithinPartitions("name", "part")
    dealt.write.format("artefact_files").mode("overwrite" if overwrite else "append").save(out)
