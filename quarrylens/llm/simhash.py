"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional
bytes. A posting of single bytes would hold a 256th of the corpus, so the index posts six positional bytes
at once: every pair that can reach the count meets in such a posting. There each pair's shared positional
bytes are tallied, pairs that reach the guaranteed six are kept, and their bits are verified. A posting
has 2^16 distinct fingerprints at most, whatever the corpus; in a large one, entries look up the partners
that the verification can let through, and those are tallied. Equal fingerprints are one entry, and a
posting gives no more links than a spanning forest of them needs. Classes are found by min-label
propagation with pointer jumping, checkpointed between rounds.

Rows: a null or blank text has fingerprint zero; repeated rows and ties share a class; a null doc_id never
names a class (a class of those only has null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SHINGLE, SEED, BITS = 3, 42, 2
#: Positional bytes of a fingerprint, and those that linked ones share at least.
BYTES, SHARED = 8, 8 - BITS
#: Entries of a posting whose pairs are all tallied.
SMALL = 128
#: Parts that a label's nodes are dealt to.
SALTS = 16
#: Flips of the 16 bits that a posting leaves open, by number of bits.
FLIPS = [1 << a for a in range(16)] + [1 << a | 1 << b for a, b in combinations(range(16), 2)]


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of so many words, in order; of all words if there are fewer."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    return majority(shingle_hashes(data, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed long."""
    common.tune(docs.sparkSession)
    rows = docs.select(*keep, common.text_of(text).alias("__text"))
    schema = StructType([*(x for x in rows.schema.fields if x.name != "__text"), StructField("fp", LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch["__text"].cast(pa.large_binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=schema.names)

    return rows.mapInArrow(common.lean(each), schema)


def _find(parent: list[int], a: int) -> int:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprints of each pair share."""
    return ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def partners(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose two open bytes (distinct numbers of 16 bits) differ in no more bits than are allowed."""
    place = np.full(1 << 16, -1, np.int32)
    place[rest] = np.arange(len(rest))
    found = [(np.flatnonzero(hit), other[hit]) for flip in FLIPS for other in (place[rest ^ flip],) for hit in (other > np.arange(len(rest)),)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def posting_links(entries: np.ndarray, open_: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (higher, lower) that hold the linked entries of one posting together; open_: its two free byte positions."""
    own = entries.view(np.uint64)
    if len(own) <= SMALL:
        a, b = np.triu_indices(len(own), 1)
    else:
        low, high = (((own >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) for k in open_)
        a, b = partners(low | high << 8)
    enough = tally(own[a], own[b]) >= SHARED
    a, b = a[enough], b[enough]
    near = np.bitwise_count(own[a] ^ own[b]) <= BITS
    parent = list(range(len(own)))
    for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
        x, y = _find(parent, i), _find(parent, j)
        parent[max(x, y)] = min(x, y)
    classes_: dict[int, list[int]] = {}
    for i in range(len(entries)):
        classes_.setdefault(_find(parent, i), []).append(int(entries[i]))
    # a binary tree over the sorted members of each class: no entry gets more than three links here
    return [(own[k], own[(k - 1) // 2]) for own in map(sorted, classes_.values()) for k in range(1, len(own))]


OPEN = list(combinations(range(8), 2))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join all that are within two bits."""
    masks = [~sum(255 << 8 * k for k in pair) & (2**64 - 1) for pair in OPEN]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    posts = F.array(*(F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)))
    postings = distinct.select("fp", F.explode(posts).alias("post")).groupBy("post.slot", "post.key").agg(F.collect_list("fp").alias("entries")).where(F.size("entries") > 1)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for slot, entries in zip(batch["slot"].to_pylist(), batch["entries"].to_pylist(), strict=True) for x in posting_links(np.array(sorted(entries), np.int64), OPEN[slot])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return postings.select("slot", "entries").mapInArrow(common.lean(verify), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges: (a, b)."""
    # written tables, whose sizes Spark knows: small ones are joined without an exchange
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", F.least("label", "heard").alias("next"), "label")
        # labels that are no roots yet; a large component's nodes share theirs, so the join is salted
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        jump = told.where(F.col("next") != F.col("node")).select(F.col("node").alias("next"), F.col("next").alias("further"), salts)
        salted = told.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(jump, ["next", "salt"], "left")
        step = common.stored(salted.select("node", F.coalesce("further", "next").alias("label"), (F.coalesce("further", "next") != F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id, first): each fingerprint's class by its least doc_id, and whether it is the class's own fingerprint of that doc_id."""
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # a small table of long rows: dealt out, since each gives a posting for every pair of bytes
    labels = components(links(distinct.select("fp").repartition(common.partitions(prints.sparkSession), "fp")))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    leader = F.min(F.struct(F.col("least").isNull().alias("none"), "least", F.col("fp").alias("own"))).alias("leader")
    return common.stored(named.join(named.groupBy("label").agg(leader), "label").select("fp", F.col("leader.least").alias("component_id"), (F.col("fp") == F.col("leader.own")).alias("first")), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the least doc_id that can be reached over links."""
    prints = common.stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "prints")
    return prints.join(classes(prints).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
