"""A tree of folders as a source: tasks list and read their own folders, so no listing passes the driver.

Planning looks at folders only, level by level, until there are enough of them for the tasks; a task gets a folder with all that
is below it, or the files that lie in an upper folder itself. Files that start with a dot or underscore are read like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that planning looks for at least, and levels that it looks at; bytes of files in a batch.
FOLDERS, LEVELS, BATCH = 64, 4, 8 << 20
SCHEMA = "path string, content binary"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else str(Path(root).resolve()))


@dataclass
class Folder(InputPartition):
    """A folder (its path below the root) with all below it, or its own files alone."""

    path: str
    whole: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str, enough: int):
        self.root, self.enough = root, enough

    def partitions(self) -> list[Folder]:
        where, base = opened(self.root)
        front, parts = [""], []
        for _ in range(LEVELS):
            if not front or len(front) >= self.enough:
                break
            below = []
            for folder in front:
                below += [x.path[len(base) :].lstrip("/") for x in where.get_file_info(fs.FileSelector(f"{base}/{folder}")) if x.type == fs.FileType.Directory]
            parts += [Folder(folder, False) for folder in front]
            front = below
        return [*parts, *(Folder(folder, True) for folder in front)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        where, base = opened(self.root)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        paths: list[str] = []
        contents: list[bytes] = []
        size = 0
        for entry in where.get_file_info(fs.FileSelector(f"{base}/{partition.path}", recursive=partition.whole)):
            if not entry.is_file:
                continue
            with where.open_input_stream(entry.path) as file:
                contents.append(file.read())
            paths.append(entry.path[len(base) :].lstrip("/"))
            size += len(contents[-1])
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], schema=schema)


class FolderSource(DataSource):
    """Rows (path, content) of all files below ``path``; ``folders`` is how many folders planning looks for."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


def read_folders(spark: SparkSession, root: str, enough: int = FOLDERS) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder_tree").option("path", root).option("folders", str(enough)).load()
