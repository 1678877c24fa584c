"""A data source of named files: rows become files with exactly their names, and a directory's files become rows in order of name.

Spark's own writers name files themselves; a book's Markdown must be ``<book>.md`` for whoever reads it next. Tasks write under a folder
of their attempt, out of readers' sight, and report what they wrote; only when every task has succeeded are the reported files
moved to their names, so a task that failed, ran twice or was given up leaves nothing behind. A reader lists the directory once, gives
files their numbers in order of name, and deals them to tasks by size; contents are read by the tasks.

Paths are those of any store that Arrow opens (local, HDFS, S3, GCS, Azure); executors and driver must see the same one. The driver holds a name and
a size a file, so this is for books, not for rows by the billion.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "named_files"
SCHEMA = "ordinal long, name string, path string, size long, content binary"
#: Bytes of files that one task reads, unless a single file has more.
SPLIT = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        store, inside = fs.FileSystem.from_uri(path)
        return store, inside.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(path)


def listing(path: str, suffix: str) -> list[fs.FileInfo]:
    """Files of a directory with the suffix, in order of name; hidden ones are left out."""
    store, base = opened(path)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((x for x in found if x.is_file and x.base_name.endswith(suffix) and x.base_name[:1] not in "._"), key=lambda x: x.base_name)


@dataclass
class _Files(InputPartition):
    files: list[tuple[int, str, str, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, split: int):
        self.path, self.suffix, self.split = path, suffix, split

    def partitions(self) -> list[_Files]:
        out, size = [], 0
        for i, x in enumerate(listing(self.path, self.suffix)):
            if not out or size + x.size > self.split:
                out.append(_Files([]))
                size = 0
            out[-1].files.append((i, x.base_name, x.path, x.size))
            size += x.size
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for ordinal, name, path, size in partition.files:
            with store.open_input_stream(path) as file:
                yield ordinal, name, path, size, file.read()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        store, base = opened(path)
        store.create_dir(f"{base}/{self.staging}")

    def write(self, iterator: Iterator) -> _Written:
        store, base = opened(self.path)
        own, files = f"{base}/{self.staging}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = row["name"]
            if not name or not name.endswith(self.suffix) or "/" in name or name[:1] in "._":
                raise ValueError(f"not a file name ending in {self.suffix!r}: {name!r}")
            if not files:
                store.create_dir(own, recursive=False)  # fails in a task that outlives an abort
            # numbered: two rows of one name must not hide each other before the names are compared
            at = f"{own}/{len(files)}"
            with store.open_output_stream(at) as file:
                file.write(bytes(row["content"] or b""))
            files.append((name, at))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = opened(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [x for x, _ in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"several rows are named {sorted({x for x in names if names.count(x) > 1})[:5]}")
            earlier = listing(self.path, self.suffix) if self.overwrite else []
            for name, at in files:
                store.move(at, f"{base}/{name}")
            for x in earlier:
                if x.base_name not in set(names):
                    store.delete_file(x.path)
        finally:
            self._clear(store, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


class NamedFiles(DataSource):
    """Options: ``suffix``, which names must end in, and ``split``, bytes a reading task gets."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("named files have the columns name and content")
        return _Writer(self.options["path"], self.options.get("suffix", ""), overwrite)


def read(spark: SparkSession, path: str, suffix: str, split: int = SPLIT) -> DataFrame:
    """``ordinal, name, path, size, content`` of a directory's files; the ordinal counts from 0 in order of name."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(FORMAT).option("suffix", suffix).option("split", str(split)).load(path)


def write(rows: DataFrame, path: str, suffix: str, replace: bool = True) -> None:
    """Rows ``name, content`` as files; with ``replace`` the directory's other files with the suffix go, as soon as all new ones are there."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format(FORMAT).mode("overwrite" if replace else "append").option("suffix", suffix).save(path)
