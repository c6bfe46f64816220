"""What several operators share: sessions' settings, shared storage and packed blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut, shared_path, stored  # noqa: F401 - the operators take them from here

#: Raw bytes of text that one packed block holds, unless a single row is larger.
BLOCK_BYTES = 32 << 20
#: Compression of blocks of texts.
LEVEL = 6
#: Bytes of an Arrow batch at most.
ARROW_BYTES = 8 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tune(spark: SparkSession) -> None:
    """Arrow batches of documents by bytes rather than rows, so that workers hold little at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(spark.conf.get(name)).rstrip("bB")
    if not given.isdigit() or int(given) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def release() -> None:
    """Give a worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over a task's batches, leaving nothing behind in a worker that waits for its next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            release()

    return run


def lean_group(each: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a group or a pair of groups."""

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return each(key, left, right)
        finally:
            release()

    def one(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return each(key, table)
        finally:
            release()

    return pair if len(inspect.signature(each).parameters) == 3 else one


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Gather record batches into tables of about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        rows = max(1, batch.num_rows)
        step = max(1, int(rows * limit / max(batch.nbytes, 1) / 4))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(table: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of less than 2^32, compressed byte plane by byte plane."""
    raw = np.ascontiguousarray(values, "<u4")
    width = max(1, -(-int(raw.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4)[:, :width].T)
    return struct.pack("<BI", width, len(raw)) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueezed(payload) -> np.ndarray:
    width, count = struct.unpack_from("<BI", payload)
    planes = zstandard.ZstdDecompressor().decompress(memoryview(payload)[5:], max_output_size=max(1, width * count))
    out = np.zeros((count, 4), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, count).T
    return out.view("<u4").reshape(count)


def ragged(flat: np.ndarray, sizes: np.ndarray) -> bytes:
    """Lists of bytes or numbers: all their items, and the lists' sizes."""
    lengths = squeezed(sizes)
    items = b"\0" + zstandard.ZstdCompressor(level=3).compress(flat.tobytes()) if flat.dtype == np.uint8 else b"\1" + squeezed(flat)
    return struct.pack("<I", len(lengths)) + lengths + items


def unragged(payload) -> tuple[np.ndarray, np.ndarray]:
    view = memoryview(payload)
    (size,) = struct.unpack_from("<I", view)
    sizes, rest = unsqueezed(view[4 : 4 + size]), view[4 + size :]
    if rest[0]:
        return unsqueezed(rest[1:]), sizes
    total = int(sizes.sum(dtype=np.int64))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(rest[1:], max_output_size=max(1, total)), np.uint8), sizes


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The lists of bytes as an Arrow array."""
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def blocks(df: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, payload): the rows of ``df`` in compressed blocks, dealt out by block once.

    A block is numbered by its task and its place in it, so a task that runs again makes the same
    blocks, as long as the input gives its rows in the same order again (tables and checkpoints do).
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, table in enumerate(pieces(batches, limit)):
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | k], pa.int64()), pa.array([packed(table, LEVEL)], pa.binary())], names=["block", "payload"])

    tune(df.sparkSession)
    return df.mapInArrow(lean(pack), "block long, payload binary").repartition(partitions(df.sparkSession), "block")


#: The column that carries a whole row through an operator, out of the way of its own columns.
ROW = "__row"


def boxed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and ROW with all columns."""
    return df.select(*needed, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(ROW))


def unboxed(df: DataFrame, columns: list[str], **changed: F.Column) -> DataFrame:
    """The columns of ROW again, some of them changed."""
    return df.select(*(changed.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in columns))


def unused(df: DataFrame, name: str) -> str:
    """A name for a column that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> F.Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
