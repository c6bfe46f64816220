"""A table that is replaced as a whole or not at all, with the version it is good for.

Tasks write parts of their own; what they wrote (names, rows, bytes, digests) goes to the commit with their messages, and only the
commit moves a new manifest over the old one. A failed task, or a driver that dies, leaves the old manifest and its parts as they
were. Parts of an aborted write are removed, what killed tasks left goes with the next commit, as do parts that neither it nor the
one before it names. A table has one writer at a time.

A reader takes what the manifest names. A missing, unreadable or foreign manifest, one of another version, and one whose parts
are missing or of another size give an empty table, as a cache should. Moving a file must be atomic in the file system.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .folders import opened

FORMAT, MANIFEST, PARTS = "manifest/1", "manifest.json", "parts"


def load(path: str) -> dict[str, Any] | None:
    """The manifest as it stands, or None if there is none to be trusted."""
    where, base = opened(path)
    try:
        with where.open_input_stream(f"{base}/{MANIFEST}") as file:
            found = json.loads(file.read())
        whole = isinstance(found, dict) and found.get("format") == FORMAT and isinstance(found.get("parts"), list)
        return found if whole and all(where.get_file_info(f"{base}/{PARTS}/{p['name']}").size == p["bytes"] for p in found["parts"]) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    bytes: int
    sha256: str


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str, about: str, schema: StructType):
        self.path, self.version, self.about, self.fields = path, version, about, schema.simpleString()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = opened(self.path)
        where.create_dir(f"{base}/{PARTS}", recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        rows, writer = 0, None
        sink = where.open_output_stream(f"{base}/{PARTS}/{name}")
        try:
            for batch in iterator:
                writer = writer or pq.ParquetWriter(sink, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer:
                writer.close()
            sink.close()
        except BaseException:
            sink.close()
            where.delete_file(f"{base}/{PARTS}/{name}")
            raise
        digest = hashlib.sha256()
        with where.open_input_stream(f"{base}/{PARTS}/{name}") as file:
            while block := file.read(1 << 20):
                digest.update(block)
        return Written(name, rows, where.get_file_info(f"{base}/{PARTS}/{name}").size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        where, base = opened(self.path)
        before = load(self.path)
        parts = sorted((vars(m) for m in messages if m is not None and m.rows), key=lambda p: p["name"])
        now = {"format": FORMAT, "version": self.version, "about": self.about, "schema": self.fields, "parts": parts}
        aside = f"{base}/{MANIFEST}.{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as file:
            file.write(json.dumps(now, indent=1, sort_keys=True).encode())
        where.move(aside, f"{base}/{MANIFEST}")
        kept = {p["name"] for p in [*parts, *(before["parts"] if before else [])]}
        for entry in where.get_file_info(fs.FileSelector(f"{base}/{PARTS}", allow_not_found=True)):
            if entry.base_name not in kept:
                where.delete_file(entry.path)

    def abort(self, messages: list[Written | None]) -> None:
        where, base = opened(self.path)
        for message in messages:
            if message is not None and where.get_file_info(f"{base}/{PARTS}/{message.name}").type == fs.FileType.File:
                where.delete_file(f"{base}/{PARTS}/{message.name}")


@dataclass
class Part(InputPartition):
    name: str
    sha256: str


class ManifestReader(DataSourceReader):
    def __init__(self, path: str, version: str | None, schema: StructType):
        self.path, self.version, self.names = path, version, schema.names

    def partitions(self) -> list[Part]:
        found = load(self.path)
        if found is None or self.version is not None and found["version"] != self.version:
            return [Part("", "")]
        return [Part(p["name"], p["sha256"]) for p in found["parts"]] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name:
            where, base = opened(self.path)
            with where.open_input_file(f"{base}/{PARTS}/{partition.name}") as file:
                yield from pq.ParquetFile(file).iter_batches(columns=self.names)


class ManifestSource(DataSource):
    """Options: path; version (of the writer; a reader's, if given, must be the same); about (a note, such as a commit)."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        found = load(self.options["path"])
        if found is None:
            raise ValueError("there is no manifest to take a schema from; give one")
        return found["schema"]

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        if not overwrite:
            raise ValueError("a manifest is replaced as a whole: write with mode overwrite")
        return ManifestWriter(self.options["path"], self.options.get("version", ""), self.options.get("about", ""), schema)

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(self.options["path"], self.options.get("version"), schema)


def write_manifest(rows: DataFrame, path: str, version: str, about: str = "") -> None:
    """Replaces the table; the rows may come from the table itself."""
    rows.sparkSession.dataSource.register(ManifestSource)
    rows.write.format("manifest").mode("overwrite").option("path", path).option("version", version).option("about", about).save()


def read_manifest(spark: SparkSession, path: str, schema: str, version: str | None = None) -> DataFrame:
    """The table, empty where there is none of this version."""
    spark.dataSource.register(ManifestSource)
    reader = spark.read.format("manifest").schema(schema).option("path", path)
    return (reader.option("version", version) if version is not None else reader).load()
