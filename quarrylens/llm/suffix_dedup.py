"""Removal of long strings that earlier documents have too, by bucket-pointer refinement.

Every window of ``length`` bytes is tied to its anchor, the q-gram of least hash in it, so equal windows
have equal anchors. Blocks of documents first tell each anchor bucket which anchors they hold; only
anchors with more than one occurrence go on. For those, a block sends the bytes around the anchor once per
distinct string, with the least doc_id. The bucket refines a suffix array over these strings down to
``length`` bytes, takes the least doc_id of each bucket of equal windows, and answers which windows
start in a document with a smaller doc_id. Anchors of more than ``hot`` occurrences are dealt out window
by window instead, by the window's own bytes, so no bucket has to hold a frequent passage's surroundings.

Rows: null texts are empty; rows with a null doc_id lose nothing and are no one's source; rows that share
a doc_id do not remove each other's bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of the q-gram that anchors a window, and of the first buckets of the suffix array.
ANCHOR, FIRST = 20, 8
#: Bytes hashed at once.
CHUNK = 1 << 20
#: Bytes of a block's raw texts.
BLOCK = 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position."""
    h = (buf.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(31)
    levels, width = {1: h}, 1
    while width * 2 <= ANCHOR:
        h = h[:-width] * (OTHER + np.uint64(2 * width)) + h[width:]
        width *= 2
        levels[width] = h
    done = width
    for bit in (8, 4, 2, 1):
        if ANCHOR - done >= bit:
            rest = levels[bit][done:]
            h = h[: len(rest)] * (MIX + np.uint64(2 * bit)) + rest
            done += bit
    h ^= h >> np.uint64(29)
    h *= OTHER
    h ^= h >> np.uint64(32)
    return h


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    return np.minimum(key[: len(key) - (width - done)], key[width - done :]) if width > done else key


def anchored(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: the text's number, first window, windows, the anchor's hash."""
    out: list[tuple[np.ndarray, ...]] = []
    low = np.uint64(CHUNK - 1)
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        buf = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        hashes = _gram_hashes(buf)
        key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_window_minima(key, length - ANCHOR + 1) & low).astype(np.int64)
        lengths = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        first[begins[begins < len(anchor)]] = True
        owner = np.repeat(np.arange(len(held)), lengths)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= ends[owner]
        starts = np.flatnonzero(first & valid)
        bound = np.append(np.flatnonzero(first), len(anchor))
        stop = bound[np.searchsorted(bound, starts, side="right")]
        count = np.minimum(stop, ends[owner[starts]] - length + 1) - starts
        which = owner[starts]
        rows = np.array([x[0] for x in held])
        offset = np.array([x[1] for x in held])
        out.append((rows[which], starts - begins[which] + offset[which], count, hashes[anchor[starts]]))
        held, size = [], 0

    step = CHUNK // 2
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, step):
            part = text[at : at + step + length - 1]
            if size + len(part) > CHUNK:
                flush()
            held.append((row, at, part))
            size += len(part)
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def refined(buf: np.ndarray, length: int) -> np.ndarray:
    """A bucket pointer for each position: equal ones for equal strings of ``length`` bytes, in their order.

    Buckets of FIRST-grams are refined by sorting on the bucket pointers of later offsets; each round reads
    the pointers that the round before has updated, so the depth doubles.
    """
    size = len(buf)
    padded = np.concatenate([buf, np.zeros(length + FIRST, np.uint8)])
    gram = np.zeros(size + length, np.uint64)
    for k in range(FIRST):
        gram = (gram << np.uint64(8)) | padded[k : k + size + length].astype(np.uint64)
    order = np.argsort(gram)
    ordered = gram[order]
    start = np.ones(len(order), bool)
    start[1:] = ordered[1:] != ordered[:-1]
    place = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    pointer = np.empty(len(order), np.int64)
    pointer[order] = place
    depth = FIRST
    while depth < length:
        offset = min(depth, length - depth)
        filled = np.bincount(pointer, minlength=len(pointer))
        open_ = np.flatnonzero(filled[pointer] > 1)
        if not len(open_):
            break
        later = pointer[np.minimum(open_ + offset, len(pointer) - 1)]
        key = pointer[open_] * np.int64(len(pointer)) + later
        order = np.argsort(key)
        ordered, old = key[order], pointer[open_][order]
        rank = np.arange(len(order))
        new_bucket = np.ones(len(order), bool)
        new_bucket[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(new_bucket, rank, 0))
        split = np.ones(len(order), bool)
        split[1:] = ordered[1:] != ordered[:-1]
        head = np.maximum.accumulate(np.where(split, rank, 0))
        pointer[open_[order]] = old + head - base
        depth += offset
    return pointer[:size]


def least_sources(strings: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each string, the least of the docs of all strings with an equal window."""
    buf = np.frombuffer(b"".join(strings), np.uint8)
    pointer = refined(buf, length)
    sizes = np.array([len(x) for x in strings])
    counts = sizes - length + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) - first[owner] + begins[owner]
    own = pointer[at]
    order = np.argsort(own, kind="stable")
    heads = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
    least = np.minimum.reduceat(docs[owner][order], heads)
    result = np.empty(len(own), np.int64)
    result[order] = np.repeat(least, np.diff(np.append(heads, len(own))))
    return np.split(result, first[1:])


class Block:
    """A block's documents, with what it asks of the buckets and what it makes of the answers."""

    def __init__(self, payload, buckets: int, length: int):
        self.table = common.unpacked(payload.as_buffer())
        self.buckets, self.length = buckets, length
        ids = self.table["__id"].to_pylist()
        self.texts = self.table["__data"].to_pylist()
        self.ids = ids
        self.rows, self.starts, self.counts, self.hashes = anchored([b"" if d is None else x for d, x in zip(ids, self.texts, strict=True)], length)
        bucket = self.hashes % np.uint64(buckets)
        self.keys, self.inverse, self.seen = np.unique((bucket << np.uint64(32)) | (self.hashes >> np.uint64(32)), return_inverse=True, return_counts=True)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        of = (self.keys >> np.uint64(32)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
        yield from zip(of[heads].tolist(), heads.tolist(), np.append(heads[1:], len(of)).tolist(), strict=True)

    def anchors(self) -> list[tuple[int, bytes]]:
        return [(k, common.packed(pa.table({"value": (self.keys[a:b] & np.uint64(2**32 - 1)).astype(np.uint32), "seen": np.minimum(self.seen[a:b], 255).astype(np.uint8)}))) for k, a, b in self.by_bucket()]

    def wanted(self, answers: dict[int, np.ndarray]) -> None:
        """Distinct strings to send (``sent``: bytes to number), and each run's own; answers: 0 nothing, 1 shared, 2 hot, by bucket."""
        state = np.zeros(len(self.keys), np.uint8)
        for k, a, b in self.by_bucket():
            if k in answers:
                state[a:b] = answers[k]
        each = state[self.inverse] if len(self.inverse) else np.zeros(0, np.uint8)
        self.sent: dict[bytes, int] = {}
        self.least: list[int] = []
        self.bucket: list[int] = []
        self.anchor: list[int] = []
        self.local: list[tuple[int, int, int]] = []
        length = self.length
        chosen = np.flatnonzero(each)
        for row, start, count, h, hot in zip(self.rows[chosen].tolist(), self.starts[chosen].tolist(), self.counts[chosen].tolist(), self.hashes[chosen].tolist(), (each[chosen] == 2).tolist(), strict=True):
            doc, text = self.ids[row], self.texts[row]
            for at in range(start, start + count) if hot else (start,):
                string = text[at : at + length] if hot else text[at : at + count + length - 1]
                number = self.sent.setdefault(string, len(self.least))
                if number == len(self.least):
                    self.least.append(doc)
                    self.bucket.append(zlib.crc32(string) % self.buckets if hot else h % self.buckets)
                    self.anchor.append(0 if hot else h)
                elif doc < self.least[number]:
                    self.least[number] = doc
                self.local.append((row, at, number))
        self.order = np.argsort(np.array(self.bucket, np.int64), kind="stable")

    def strings(self) -> Iterator[tuple[int, pa.Table]]:
        if not self.least:
            return
        table = pa.table({"string": pa.array(list(self.sent), pa.binary()), "doc": pa.array(self.least, pa.int64()), "anchor": pa.array(self.anchor, pa.uint64())})
        of = np.array(self.bucket)[self.order]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(of)).tolist(), strict=True):
            yield int(of[a]), table.take(pa.array(self.order[a:b]))

    def removed(self, answers: dict[int, np.ndarray]) -> list[list[tuple[int, int]]]:
        """Maximal runs of bytes to remove, by row."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        if not self.local:
            return out
        counts = np.fromiter(map(len, self.sent), np.int64, len(self.sent)) - self.length + 1
        ordered = counts[self.order]
        offset = np.empty(len(counts), np.int64)
        offset[self.order] = np.cumsum(ordered) - ordered
        flags = np.concatenate([answers[k][:n] for k, n in self.windows_by_bucket(ordered)])
        row, at, number = np.array(self.local, np.int64).T
        size = counts[number]
        own = np.repeat(np.arange(len(row)), size)
        within = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.array([-1 if d is None else d for d in self.ids], np.int64)
        later = ids[row] > np.array(self.least, np.int64)[number]
        hit = flags[offset[number][own] + within] | later[own]
        rows, starts = row[own][hit], (at[own] + within)[hit]
        if not len(rows):
            return out
        fresh = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (np.diff(starts) > self.length)))
        last = np.append(fresh[1:], len(rows)) - 1
        for r, a, b in zip(rows[fresh].tolist(), starts[fresh].tolist(), (starts[last] + self.length).tolist(), strict=True):
            out[r].append((a, b))
        return out

    def windows_by_bucket(self, ordered: np.ndarray) -> Iterator[tuple[int, int]]:
        of = np.array(self.bucket)[self.order]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        yield from zip(of[heads].tolist(), np.add.reduceat(ordered, heads).tolist(), strict=True)


def _reply(_key: tuple, table: pa.Table, hot: int) -> pa.Table:
    """For each block's anchors in a bucket: 0 if nobody else has it, 1 if shared, 2 if hot."""
    parts = [common.unpacked(x.as_buffer()) for x in table["payload"]]
    values = np.concatenate([x["value"].to_numpy() for x in parts])
    _, inverse = np.unique(values, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([x["seen"].to_numpy() for x in parts]))
    state = (1 * (total > 1) + (total > hot)).astype(np.uint8)[inverse]
    answers = np.split(state, np.cumsum([x.num_rows for x in parts])[:-1])
    return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([1] * table.num_rows, pa.int32()), "payload": pa.array([common.packed(pa.table({"x": x})) for x in answers], pa.binary())})


def _judge(_key: tuple, table: pa.Table, length: int, slice_bytes: int = 1 << 21) -> pa.Table:
    """For each block's strings in a bucket: which windows start in a document with a smaller doc_id."""
    parts = [common.unpacked(x.as_buffer()) for x in table["payload"]]
    whole = pa.concat_tables(parts)
    distinct = whole.group_by(["anchor", "string"]).aggregate([("doc", "min")]).sort_by("anchor")
    strings, docs, anchors = distinct["string"].to_pylist(), distinct["doc_min"].to_numpy(), distinct["anchor"].to_numpy()
    counts = np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1
    offset = np.cumsum(counts) - counts
    least = np.repeat(docs, counts)
    heads = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    tails = np.append(heads[1:], len(anchors))
    several = (tails - heads > 1) & (anchors[heads] != 0)
    batch: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            for i, x in zip(batch, least_sources([strings[i] for i in batch], docs[batch], length), strict=True):
                least[offset[i] : offset[i] + counts[i]] = x
        batch, size = [], 0

    for a, b in zip(heads[several].tolist(), tails[several].tolist(), strict=True):
        batch += range(a, b)
        size += int(counts[a:b].sum()) + (b - a) * (length - 1)
        if size > slice_bytes:
            flush()
    flush()
    number = dict(zip(strings, range(len(strings)), strict=True))
    out = []
    for part in parts:
        which = np.fromiter(map(number.__getitem__, part["string"].to_pylist()), np.int64, part.num_rows)
        size = counts[which]
        at = np.repeat(offset[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out.append(common.packed(pa.table({"x": np.packbits(least[at] < np.repeat(part["doc"].to_numpy(), size))})))
    return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([2] * table.num_rows, pa.int32()), "payload": pa.array(out, pa.binary())})


def remove_repeats(docs: DataFrame, length: int = 50, hot: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the byte runs that earlier documents have, and what is left."""
    buckets = common.partitions(docs.sparkSession)
    answer = "block long, bucket int, kind int, payload binary"
    base = common.blocks(docs.select(F.col(doc_id).cast("long").alias("__id"), F.encode(common.text_of(text), "utf-8").alias("__data")), BLOCK)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                if found := Block(payload, buckets, length).anchors():
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "block", "payload"])

    told = base.mapInArrow(common.lean(tell), "bucket int, block long, payload binary").repartition(buckets, "bucket")
    shared = told.groupBy("bucket").applyInArrow(common.lean_group(lambda key, table: _reply(key, table, hot)), answer)

    def answers(right: pa.Table, kind: int) -> dict[int, np.ndarray]:
        rows = zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["payload"], strict=True)
        return {k: common.unpacked(x.as_buffer())["x"].to_numpy() for own, k, x in rows if own == kind}

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left["payload"][0], buckets, length)
        block.wanted(answers(right, 1))
        found = [(k, common.packed(x)) for k, x in block.strings()]
        return pa.table({"bucket": pa.array([k for k, _ in found], pa.int32()), "block": pa.array([key[0].as_py()] * len(found), pa.int64()), "payload": pa.array([x for _, x in found], pa.binary())})

    sent = base.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(common.lean_group(send), "bucket int, block long, payload binary")
    judged = sent.groupBy("bucket").applyInArrow(common.lean_group(lambda key, table: _judge(key, table, length)), answer)

    def finish(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left["payload"][0], buckets, length)
        block.wanted(answers(right, 1))
        spans = block.removed({k: np.unpackbits(x).view(bool) for k, x in answers(right, 2).items()})
        kept = []
        for data, cuts in zip(block.texts, spans, strict=True):
            edges = [0, *(x for pair in cuts for x in pair), len(data)]
            kept.append(data if not cuts else b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": block.table["__id"], "n_bytes": pa.array([len(x) for x in block.texts], pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span), "kept": pa.array(kept, pa.binary())})

    return base.groupBy("block").cogroup(shared.unionByName(judged).groupBy("block")).applyInArrow(common.lean_group(finish), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
