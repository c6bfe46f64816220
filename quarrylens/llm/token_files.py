"""Token files: one independent zstandard frame per document, with a seek table and checksums at the end.

A file is: the documents' frames (ids as little-endian unsigned 32-bit integers, each frame with its content
checksum) in ascending doc_id order; a skippable frame with the doc_ids; a skippable frame with the seek
table of the public seekable format (compressed size, decompressed size, and checksum of each frame, then
the number of frames, a descriptor and the magic number). A reader takes the tail of the file and
decompresses only the frames it wants; other zstandard tools can decompress the whole.

Words are encoded by the tokenizers library once per worker and kept in a bounded cache: the tokenizer
encodes each match of its own pattern by itself, so a text's ids are its words' ids in order. Texts that have an
added token of the tokenizer (such as ``<|endoftext|>``) are encoded whole by the library, which gives it its id.

Rows: null texts are empty and have the end id alone; rows without a doc_id come first; rows that share one
are ordered by their text's hash; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .splitting import Splitter, joined

#: Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE, CHECKSUMMED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Words in a worker's cache at most.
CACHE = 800_000
#: Bytes of texts whose words are looked up together.
GROUP = 4 << 20
#: Bytes of the texts of a file, about.
FILE = 64 << 20
#: How a byte-level vocabulary writes a space.
BLANK = "\u0120"
_workers: dict[str, tuple[object, Splitter, np.ndarray, list[bytes], dict[bytes, bytes]]] = {}


def _worker(path: str, pattern: str):
    """The tokenizer, the splitter, whether each id's piece starts with a space, the added tokens, and the words known so far."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        pieces = tokenizer.get_vocab()
        spaced = np.zeros(max(pieces.values()) + 1, bool)
        spaced[[k for piece, k in pieces.items() if piece.startswith(BLANK)]] = True
        added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
        _workers[path] = tokenizer, Splitter(pattern), spaced, added, {}
    return _workers[path]


def encode_texts(texts: list[bytes], path: str, pattern: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    tokenizer, split, spaced, added, cache = _worker(path, pattern)
    whole: dict[int, bytes] = {}
    marked = [k for k, t in enumerate(texts) if any(a in t for a in added)]
    if marked:
        tokenizer.encode_special_tokens = False
        try:
            for k in marked:
                whole[k] = np.array(tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            tokenizer.encode_special_tokens = True
        texts = [b"" if k in whole else t for k, t in enumerate(texts)]
    if len(cache) > CACHE:
        cache.clear()
    words, numbers, counts = split.words(texts)
    missing = [w for w in words if w not in cache]
    # words of one leading space and letters go as one text, since the tokenizer splits them apart again
    simple = [w for w in missing if split.common and w[0] == 32 and w[1:].decode().isalpha()]
    for k in range(0, len(simple), 5000):
        part = simple[k : k + 5000]
        (found,) = tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.flatnonzero(spaced[ids]).tolist()
        if len(starts) == len(part):  # else they are encoded one by one
            for w, a, b in zip(part, starts, [*starts[1:], len(ids)], strict=True):
                cache[w] = ids[a:b].tobytes()
    rest = [w for w in missing if w not in cache]
    for w, x in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
        cache[w] = struct.pack(f"<{len(x.ids)}I", *x.ids)
    return [whole.get(k, x) for k, x in enumerate(joined([cache[w] for w in words], numbers, counts))]


class Frame(NamedTuple):
    doc_id: int | None
    data: bytes
    size: int
    check: int


def file_bytes(frames: list[Frame]) -> bytes:
    index = common.packed(pa.table({"doc_id": pa.array([f.doc_id for f in frames], pa.int64())}))
    entries = b"".join(struct.pack("<III", len(f.data), f.size, f.check) for f in frames)
    table = entries + struct.pack("<IBI", len(frames), CHECKSUMMED, SEEKABLE)
    return b"".join([*(f.data for f in frames), struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_TABLE, len(table)), table])


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


class TokenFile:
    """Reads a token file by its tail and the frames asked for."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMMED:
            raise ValueError(f"{uri} is no token file")
        raw = self.file.read_at(12 * count, size - 9 - 12 * count)
        entries = np.frombuffer(raw, "<u4").reshape(count, 3).astype(np.int64)
        self.sizes, self.lengths, self.checks = entries.T if count else np.zeros((3, 0), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        end = int(self.sizes.sum())
        (index,) = struct.unpack("<I", self.file.read_at(4, end + 4))
        self.doc_ids = common.unpacked(self.file.read_at(index, end + 8))["doc_id"].to_pylist()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def find(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document of this doc_id; no other frame is read."""
        return [self.ids(k) for k, d in enumerate(self.doc_ids) if d == doc_id]

    def ids(self, k: int) -> bytes:
        """The k-th document's ids; its checksums are verified."""
        data = self.file.read_at(int(self.sizes[k]), int(self.starts[k]))
        found = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.lengths[k]))
        if xxhash.xxh64_intdigest(found) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return found


def write_tokens(docs: DataFrame, path: str, pattern: str, end_id: int, folder: str, text: str = "text", doc_id: str = "doc_id", file_bytes_limit: int = FILE) -> list[tuple[str, int, int]]:
    """Writes the token files, in order of doc_id from one file to the next; (file, documents, ids) of each."""
    spark = docs.sparkSession
    common.tune(spark)
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).head()[0] or 0
    files = max(common.partitions(spark), -(-total // file_bytes_limit))
    levels = [k / files for k in range(1, files)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    bounds = np.array(sorted(rows.where("doc_id is not null").select(F.col("doc_id").cast("double")).approxQuantile("doc_id", levels, 0.2 / files)) if levels else [])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=True).compress
        for batch in batches:
            for part in slices(batch, "text", GROUP):
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                found = [x + struct.pack("<I", end_id) for x in encode_texts(texts, path, pattern)]
                ids = part["doc_id"].to_pylist()
                where = [0 if d is None else int(np.searchsorted(bounds, d, side="left")) for d in ids]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), part["doc_id"], pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array([press(x) for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in found], pa.int64())], names=["file", "doc_id", "tie", "data", "size", "check"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        lost = table.filter(table["doc_id"].is_null())
        table = pa.concat_tables([lost, table.filter(table["doc_id"].is_valid())])
        frames = [Frame(*x) for x in zip(*(table[c].to_pylist() for c in ("doc_id", "data", "size", "check")), strict=True)]
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name, own = f"{base}/part-{key[0].as_py():06d}.zst", f"{base}/.part-{uuid.uuid4().hex}"
        with where.open_output_stream(own) as out:
            out.write(file_bytes(frames))
        where.move(own, name)  # a task that runs again puts the same file there
        return pa.table({"file": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([len(frames)], pa.int64()), "ids": pa.array([sum(f.size for f in frames) // 4], pa.int64())})

    coded = rows.mapInArrow(common.lean(encode), "file int, doc_id long, tie long, data binary, size long, check long")
    made = coded.groupBy("file").applyInArrow(common.lean_group(write), "file int, docs long, ids long").collect()
    return [(f"{folder}/part-{x.file:06d}.zst", x.docs, x.ids) for x in sorted(made, key=lambda x: x.file)]


def fetch(spark, files: list[tuple[str, int, int]], doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents asked for (column doc_id; repeated ones count once), by the tails of the files and their frames only."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["name"].to_pylist():
                own = TokenFile(name).doc_ids
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.int64())], names=["name", "k", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last = None, None
        for batch in batches:
            found = []
            for name, k in zip(batch["name"].to_pylist(), batch["k"].to_pylist(), strict=True):
                if name != last:
                    file, last = TokenFile(name), name
                found.append(file.ids(k))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "ids"])

    table = spark.createDataFrame([(k, name) for k, (name, *_) in enumerate(files)], "k int, name string").repartition(max(1, len(files)), "k")
    frames = table.select("name").mapInArrow(common.lean(index), "name string, k long, doc_id long")
    asked = frames.join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    return asked.select("name", "k", "doc_id").repartition(max(1, len(files)), "name").sortWithinPartitions("name", "k").mapInArrow(common.lean(read), "doc_id long, ids binary")


def read_tokens(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start: the ids of all documents before it."""
    rows, before = [], 0
    for k, (name, _, ids) in enumerate(files):
        rows.append((k, name, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                file = TokenFile(name)
                starts = start + (np.cumsum(file.lengths) - file.lengths) // 4
                for k in range(0, len(file), 1024):
                    part = range(k, min(k + 1024, len(file)))
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[k : part.stop], pa.int64()), pa.array(starts[k : part.stop]), pa.array([file.ids(i) for i in part], pa.binary())], names=["doc_id", "start", "ids"])

    table = spark.createDataFrame(rows, "k int, name string, start long")
    return table.repartition(max(1, len(rows)), "k").select("name", "start").mapInArrow(common.lean(read), "doc_id long, start long, ids binary")
