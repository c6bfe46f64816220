"""Byte-level BPE encoding and decoding.

Distinct words are encoded once each by Spark's higher-order functions, which fold ranked merges over
arrays of bytes; the ranks are the one row of a scalar subquery. Each block of documents is split once, into numbers of
its distinct words; it asks for the words' ids by bucket, gets them back and puts them together per document.
Decoding concatenates the ids' pieces.

Rows: null texts count as empty and have no ids; repeated rows and ties give a row each; an empty table
gives an empty result; any further columns are kept out, only ``keep`` is carried.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import common
from .splitting import Splitter, gathered

#: Bytes of a block's raw texts.
BLOCK = 16 << 20
#: Bits of an id, and of a piece's place in its word; words of more than LONG bytes don't go through the fold.
ID, PLACE, LONG = 18, 20, 1024
#: No rank: larger than any.
NONE = 1 << ID
#: What an empty slot of the rank map holds.
EMPTY = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank that two pieces have together, by their ids: the left one's shifted, plus the right one's."""
    if max(ranks.values(), default=0) >= NONE:
        raise ValueError(f"ids must be less than {NONE}")
    return {a << ID | b: rank for piece, rank in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None}


def perfect_hash(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Shifts and slots: a key's slot is its remainder by the number of slots, plus the shift that its remainder by the number of shifts has."""
    groups, size = len(pairs) // 3 | 1, 5 * len(pairs) // 4 + 3 | 1
    while len({(key % groups, key % size) for key in pairs}) < len(pairs):  # else these keys would share a slot whatever the shift
        size += 2
    by: defaultdict[int, list[int]] = defaultdict(list)
    for key in pairs:
        by[key % groups].append(key)
    shifts, slots = [0] * groups, [EMPTY] * size
    for group in sorted(by, key=lambda g: (-len(by[g]), g)):
        homes = [key % size for key in by[group]]
        shifts[group] = next(d for d in range(size) if all(slots[(h + d) % size] == EMPTY for h in homes))
        for key, home in zip(by[group], homes, strict=True):
            slots[(home + shifts[group]) % size] = key << ID | pairs[key]
    return shifts, slots


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int], dict[str, int]]:
    """A perfect hash of pairs (shifts, slots), and whole words that merges don't reach by their hex digits."""
    return *perfect_hash(pair_ranks(ranks)), {piece.hex().upper(): rank for piece, rank in ranks.items() if merged_ids(piece, ranks) != [rank]}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map, constant in the plan and in all of its descriptions."""
    shifts, slots, whole = rank_map(ranks)

    def constant(value: object, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    return F.struct(constant(shifts, "array<bigint>").alias("shifts"), constant(slots, "array<bigint>").alias("slots"), constant(whole, "map<string,bigint>").alias("whole"))


def rank_row(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as a scalar subquery: the driver describes a plan each time a stage ends, and these descriptions don't spell it out."""
    one = spark.createDataFrame([rank_map(ranks)], "shifts array<bigint>, slots array<bigint>, whole map<string,bigint>", verifySchema=False)
    return one.select(F.struct("shifts", "slots", "whole")).scalar()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded_word(word: Column, ids: Column, ranks: Column) -> Column:
    """The ids of one word (binary; ids: those of its bytes): the pair of least rank is merged, the leftmost of equals first, until none has a rank.

    The fold's state has a long for each piece: the rank of the piece joined with the next one, the byte at
    which the piece starts, and the piece's id.
    """
    return let(ranks, lambda r: _encoded_word(word, ids, r))  # the ranks stand in the plan once


def _encoded_word(word: Column, ids: Column, ranks: Column) -> Column:
    size, groups = F.size(ranks["slots"]), F.size(ranks["shifts"])

    def rank(left: Column, right: Column) -> Column:
        """Of two ids; a slot of another pair differs above the rank's bits. NONE if one is null."""
        key = F.shiftleft(left, ID).bitwiseOR(right)
        slot = (key % size + F.get(ranks["shifts"], (key % groups).cast("int"))) % size
        return F.least(F.get(ranks["slots"], slot.cast("int")).bitwiseXOR(F.shiftleft(key, ID)), F.lit(NONE).cast("long"))

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(NONE - 1))

    def ranked(found: Column, entry: Column) -> Column:
        """The entry (without a rank) of a piece that has this rank with the next one."""
        return F.shiftleft(found, PLACE + ID).bitwiseOR(entry)

    place, own = F.lit((1 << PLACE) - 1 << ID), F.lit((1 << PLACE + ID) - 1)

    def merge(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            new = F.shiftrightunsigned(least, PLACE + ID)  # a piece's id is its rank

            def joined(p: Column) -> Column:  # from 1; this piece and the next one become one
                entry = F.array(ranked(rank(new, id_of(F.get(state, p + 1))), least.bitwiseAND(place).bitwiseOR(new)))
                rest = F.slice(state, p + 2, F.size(state))
                before = let(F.get(state, p - 2), lambda x: F.array(ranked(rank(id_of(x), new), x.bitwiseAND(own))))
                return F.when(p > 1, F.concat(F.slice(state, F.lit(1), p - 2), before, entry, rest)).otherwise(F.concat(entry, rest))

            return F.when(least < NONE << PLACE + ID, let(F.array_position(state, least).cast("int"), joined)).otherwise(state)

        return let(F.array_min(state), at)

    state = F.transform(ids, lambda a, k: ranked(rank(a, F.get(ids, k + 1)), F.shiftleft(k.cast("long"), ID).bitwiseOR(a)))
    steps = F.when(F.size(ids) > 1, F.sequence(F.lit(2), F.size(ids))).otherwise(F.array().cast("array<int>"))
    folded = F.transform(F.aggregate(steps, state, merge), lambda x: id_of(x).cast("int"))
    known = F.when(F.size(ranks["whole"]) > 0, F.element_at(ranks["whole"], F.hex(word)).cast("int"))
    return F.when(known.isNotNull(), F.array(known)).otherwise(folded)


def encoded_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for words too long for the fold, which takes time by the square of the length."""
    return [ranks[word]] if word in ranks else merged_ids(word, ranks)


def byte_ids(words: pa.Array, ranks: dict[bytes, int]) -> pa.ListArray:
    """The ids of each word's bytes."""
    of = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    offsets = np.append(0, np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(of[np.frombuffer(b"".join(words.to_pylist()), np.uint8)]))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of the pieces that merges end with, by a heap of ranked pairs."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(size)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= size or after[j] != end:
            continue
        gone[j] = 1
        after[i] = end
        if end < size:
            before[end] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < size and (r := ranks.get(word[a : after[b]])) is not None:
                heapq.heappush(heap, (r, a, after[b]))
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    then: Callable[[pa.Table], pa.Table] | None = None,
    schema: str | StructType | None = None,
) -> DataFrame:
    """``keep`` and ``ids`` (array of int) for every row: each match of ``pattern`` is encoded by itself.

    ``then``, if given, is applied to each block's table of these columns where it was made; ``schema`` is
    that of its result.
    """
    spark = docs.sparkSession
    common.tune(spark)
    buckets = common.partitions(spark)
    rows = docs.select(*keep, common.text_of(text).cast("binary").alias("__text"))
    known_ranks = spark.sparkContext.broadcast(ranks)

    def numbered(splitter: Splitter, table: pa.Table, block: int) -> pa.RecordBatch:
        """A block of rows as numbers of distinct words, the words in order of their buckets; nothing else of it outlives the call."""
        words, numbers, counts = splitter.words(table["__text"].to_pylist())
        table = table.drop_columns(["__text"]).append_column("__count", pa.array(counts, pa.int64()))
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
        often = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        # numbers go by frequency, for their compression; the words' order by bucket follows from the buckets
        place = np.empty(len(words), np.uint32)
        place[often] = np.arange(len(words))
        order = often[np.argsort(bucket[often], kind="stable")]
        sizes = np.bincount(bucket, minlength=buckets)
        sent = common.ragged(np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8), np.array([len(words[i]) for i in order.tolist()], np.uint32))
        parts = (common.packed(table), common.squeezed(place[numbers]), common.squeezed(bucket[often]), sent, common.squeezed(sizes))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["block", "rows", "numbers", "buckets", "words", "sizes"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, splitter = TaskContext.get().partitionId(), Splitter(pattern)
        for k, table in enumerate(common.pieces(batches, BLOCK)):
            made = numbered(splitter, table, task << 24 | k)
            # a block's texts and words go back to the system before the next block's come
            del table
            common.release()
            yield made

    base = rows.mapInArrow(common.lean(split), "block long, rows binary, numbers binary, buckets binary, words binary, sizes binary").repartition(buckets, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, sizes in zip(batch["block"].to_pylist(), batch["words"], batch["sizes"], strict=True):
                flat, lengths = common.unragged(words.as_buffer())
                last = np.cumsum(common.unsqueezed(sizes.as_buffer()).astype(np.int64))
                ends = np.append(0, np.cumsum(lengths, dtype=np.int64))
                lists = [(k, common.ragged(flat[ends[a] : ends[b]], lengths[a:b])) for k, (a, b) in enumerate(zip([0, *last.tolist()], last.tolist(), strict=False)) if b > a]
                if lists:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in lists], pa.int32()), pa.array([block] * len(lists), pa.int64()), pa.array([x for _, x in lists], pa.binary())], names=["bucket", "block", "words"])

    def words_of(table: pa.Table) -> list[pa.Array]:
        return [common.binaries(*common.unragged(x.as_buffer())) for x in table["words"]]

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        words = pa.chunked_array(words_of(table)).unique()
        words = words.take(pc.sort_indices(words))
        longs = [encoded_long(w.as_py(), known_ranks.value) if n > LONG else None for w, n in zip(words, pc.binary_length(words).to_pylist(), strict=True)]
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(words), pa.int32()), "word": words, "bytes": byte_ids(words, known_ranks.value), "long": pa.array(longs, pa.list_(pa.int32()))})

    # all columns of base, so that both of its readers share one exchange
    asked = base.mapInArrow(common.lean(ask), "bucket int, block long, words binary").repartition(buckets, "bucket")
    distinct = asked.groupBy("bucket").applyInArrow(common.lean_group(unite), "bucket int, word binary, bytes array<bigint>, long array<int>")
    # higher-order functions take no subquery but by a column, which the optimizer puts in its place
    known = distinct.withColumn("ranks", rank_row(spark, ranks)).select("bucket", "word", F.when(F.col("long").isNotNull(), F.col("long")).otherwise(encoded_word(F.col("word"), F.col("bytes"), F.col("ranks"))).alias("ids"))

    def answer(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.combine_chunks()
        ids = right["ids"].combine_chunks()
        parts = words_of(left)
        found = pc.index_in(pa.chunked_array(parts), value_set=right["word"].combine_chunks()).combine_chunks().to_numpy()
        flat, sizes = ids.flatten().to_numpy().astype("<u4"), ids.value_lengths().to_numpy()
        out = [common.ragged(gathered(flat, sizes, which), sizes[which]) for which in np.split(found, np.cumsum([len(x) for x in parts])[:-1])]
        return pa.table({"block": left["block"], "bucket": left["bucket"], "ids": pa.array(out, pa.binary())})

    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(common.lean_group(answer), "block long, bucket int, ids binary")
    kept = rows.drop("__text").schema
    schema = schema or StructType([*kept.fields, StructField("ids", ArrayType(IntegerType()))])

    def finish(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        table = common.unpacked(left["rows"][0].as_buffer())
        # the answers by bucket give the words in the order in which they were sent
        found = [common.unragged(x.as_buffer()) for _, x in sorted(zip(right["bucket"].to_pylist(), right["ids"], strict=True), key=lambda x: x[0])]
        flat, sizes = (np.concatenate([np.zeros(0, "<u4"), *(x[k] for x in found)]) for k in (0, 1))
        bucket = common.unsqueezed(left["buckets"][0].as_buffer())
        place = np.empty(len(bucket), np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        numbers = place[common.unsqueezed(left["numbers"][0].as_buffer())]
        words = np.append(0, np.cumsum(table["__count"].to_numpy()))
        ends = np.append(0, np.cumsum(sizes[numbers], dtype=np.int64))[words]
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gathered(flat, sizes, numbers).astype("<i4", copy=False)))
        out = table.drop_columns(["__count"]).append_column("ids", ids)
        return then(out) if then else out

    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(common.lean_group(finish), schema)


def piece_list(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Each id's piece."""
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode(ids: list[int], pieces: list[bytes | None]) -> bytes:
    """The bytes of the ids; an id without a piece raises an error."""
    return b"".join(map(pieces.__getitem__, ids))


def decoded(coded: DataFrame, ranks: dict[bytes, int], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and data (binary) of rows with ids."""
    pieces = piece_list(ranks)
    schema = StructType([*(coded.schema[x] for x in keep), StructField("data", BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([None if x is None else decode(x, pieces) for x in batch["ids"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], names=schema.names)

    return coded.select(*keep, "ids").mapInArrow(common.lean(each), schema)
