"""Prefix trie of conversations: shared beginnings, what caching them saves, and which conversations end where.

Turns become labels (16 bytes of a SHA-256 of role and text). Equal conversations are united first. The others are
dealt out in order of their label sequences, so each shard holds neighbours, and no prefix is too frequent
for one machine. In a shard numpy builds a succinct level-order trie (LOUDS: a bit for each child, a zero for each node) with its
label array, and rolls counts up by scattered additions, level by level from the deepest.

Only nodes on the way to a shard's first or last sequence can also be in other shards. These heavy upper levels are
kept back, with what the shard knows of them, as two paths; paths are dealt out and merged in the same way, until one shard
holds all that are left.

Rows: a null role or text is the empty text; turns without a number come first, equal numbers are in order of their labels; rows
without a conversation's id belong to none and are left out; a repeated turn is one more turn; very long texts only
count by their hash and words; an empty table has no nodes. Further columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A conversation's first turns, as many as its hash says, less than HEADS, are those of the first one of its family.
FAMILY, HEADS = 20, 4
#: Turns in a shard, about; paths that a shard of upper levels has at least.
SHARD, LEAST_PATHS = 1 << 20, 8
WIDTH = 16
#: No conversation.
NONE = np.iinfo(np.int64).max
FACTS = ("depth", "ends", "members", "first", "children", "leaves", "saved", "end_first")
FACT_TYPE = "array<struct<depth:int,ends:bigint,members:bigint,first:bigint,children:bigint,leaves:bigint,saved:bigint,end_first:bigint>>"
#: What a shard gives: nodes, links from what lower shards called a node to its name, and paths for the next tier.
NODE, LINK, PATH = range(3)
RESULT = f"kind int, conv_id long, depth int, parent long, open boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, end_first long, labels array<binary>, words array<int>, facts {FACT_TYPE}"


def label(role: Column, text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, WIDTH)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's labels and word counts in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), common.text_of()
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", label(role, text).alias("label"), words.alias("words")).alias("at"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, labels, words): the first turns are those of the family's first conversation, the others its own."""
    own = ordered_turns(conversations)
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "shared": shared}).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("shared"))).otherwise(F.slice("turns", 1, 0))
    turns = F.concat(head, F.slice("turns", F.col("shared") + 1, F.size("turns")))
    return rows.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.label").alias("labels"), F.col("turns.words").alias("words"))


def flat_labels(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All labels one after the other (of two numbers each), and each row's count."""
    flat = np.frombuffer(b"".join(column.flatten().to_pylist()), np.uint64).reshape(-1, 2)
    return flat, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


UNITED = "labels array<binary>, words array<int>, n long, first long, ends_sha256 string"


def united(rows: DataFrame) -> DataFrame:
    """Equal conversations as one: how many, the least id, and the digest of all ids; streamed, so that no group is held."""
    schema = pa.schema([("labels", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("first", pa.int64()), ("ends_sha256", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out, size = None, None, [], 0
        for batch in batches:
            flat, counts = flat_labels(batch["labels"])
            data, ends = flat.tobytes(), np.append(0, np.cumsum(counts)) * WIDTH
            for k, conv in enumerate(batch["conv_id"].to_pylist()):
                own = data[ends[k] : ends[k + 1]]
                if own == key:
                    group["n"] += 1
                    group["sha"].update(b",%d" % conv)
                    continue
                if group:
                    out.append(group)
                    size += len(key) + 64
                key = own
                group = {"key": own, "words": batch["words"][k].as_py(), "n": 1, "first": conv, "sha": hashlib.sha256(b"%d" % conv)}
                if size >= common.ARROW_BYTES:
                    yield made(out)
                    out, size = [], 0
        if group:
            yield made([*out, group])

    def made(groups: list[dict]) -> pa.RecordBatch:
        rows = [{"labels": [g["key"][k : k + WIDTH] for k in range(0, len(g["key"]), WIDTH)], "words": g["words"], "n": g["n"], "first": g["first"], "ends_sha256": g["sha"].hexdigest()} for g in groups]
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    common.tune(rows.sparkSession)
    dealt = rows.repartition(common.partitions(rows.sparkSession), "labels").sortWithinPartitions("labels", "conv_id")
    return dealt.mapInArrow(common.lean(each), UNITED)


class Louds:
    """A level-order trie of sorted sequences of labels; nodes are numbered by level, then by order."""

    def __init__(self, labels: np.ndarray, counts: np.ndarray):
        rows = len(counts)
        starts = np.cumsum(counts) - counts
        common_with = self._common(labels, counts, starts)
        made = counts - common_with  # nodes that a sequence adds: those beyond what it has in common with the one before
        row = np.repeat(np.arange(rows), made)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + common_with[row] + 1
        order = np.lexsort((row, depth))
        self.depth, self._rows = depth[order], rows
        self._key = self.depth * rows + row[order]
        #: Where each level starts.
        self.levels = np.searchsorted(self.depth, np.arange(int(self.depth[-1]) + 2))
        #: The place in the input of each node's label; the root has none.
        self.label_at = starts[row[order]] + self.depth - 1
        above = self.at(row[order][1:], self.depth[1:] - 1)
        degrees = np.bincount(above, minlength=len(order))
        self.bits = np.ones(2 * len(order) - 1, bool)
        self.bits[np.cumsum(degrees) + np.arange(len(order))] = False

    @staticmethod
    def _common(labels: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many labels each sequence has in common with the one before; the first one -1, since it adds the root too."""
        shorter = np.minimum(counts[1:], counts[:-1])
        out = np.append(-1, shorter)
        which = np.repeat(np.arange(1, len(counts)), shorter)
        place = np.arange(len(which)) - np.repeat(np.cumsum(shorter) - shorter, shorter)
        differs = (labels[starts[which] + place] != labels[starts[which - 1] + place]).any(axis=1)
        np.minimum.at(out, which[differs], place[differs])
        return out

    def at(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The nodes of sequences at depths."""
        return np.searchsorted(self._key, depth * self._rows + row, side="right") - 1

    def parents(self) -> np.ndarray:
        """Each node's parent, by the bits: the zeros before a node's own one; the root is its own."""
        ones = np.flatnonzero(self.bits)
        return np.append(0, ones - np.arange(len(ones)))

    def degrees(self) -> np.ndarray:
        """How many children each node has, by the bits: the ones between zeros."""
        return np.diff(np.append(-1, np.flatnonzero(~self.bits))) - 1


def shard(table: pa.Table, alone: bool, linked: bool) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's sorted sequences; unless it is alone, those on its first and last way are kept back as paths. ``linked``: what its facts call nodes gets links."""
    labels, counts = flat_labels(table["labels"].combine_chunks())
    trie = Louds(labels, counts)
    parents, degrees = trie.parents(), trie.degrees()
    size = len(parents)
    words = table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    words = np.where(trie.depth > 0, words[trie.label_at] if len(words) else 0, 0)
    given = table["facts"].combine_chunks()
    fact = {name: given.flatten().field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in FACTS}
    node = trie.at(np.repeat(np.arange(len(counts)), given.value_lengths().to_numpy(zero_copy_only=False)), fact["depth"])
    total = {name: np.zeros(size, np.int64) for name in ("ends", "members", "children", "leaves", "saved")}
    for name, values in total.items():
        np.add.at(values, node, fact[name])
    first, end_first = np.full(size, NONE), np.full(size, NONE)
    np.minimum.at(first, node, fact["first"])
    np.minimum.at(end_first, node, fact["end_first"])
    open_ = np.zeros(size, bool)
    ways = {}
    if not alone:
        for row in dict.fromkeys((0, len(counts) - 1)):
            ways[row] = trie.at(np.full(counts[row] + 1, row), np.arange(counts[row] + 1))
            open_[ways[row]] = True
    convs = np.zeros(size, np.int64)
    for level in range(len(trie.levels) - 2, -1, -1):
        own = np.arange(trie.levels[level], trie.levels[level + 1])
        convs[own] = total["ends"][own] + total["members"][own]
        done = own[~open_[own]]
        total["leaves"][done[(degrees[done] == 0) & (total["children"][done] == 0)]] = 1
        total["saved"][done] += (convs[done] - 1) * words[done]
        if level:
            above = parents[done]
            for name, values in (("members", convs), ("leaves", total["leaves"]), ("saved", total["saved"]), ("children", np.ones(size, np.int64))):
                np.add.at(total[name], above, values[done])
            np.minimum.at(first, parents[own], first[own])
    done = np.flatnonzero(~open_)
    above = parents[done]
    root = done == 0
    yield batch(
        len(done),
        kind=pa.array(np.full(len(done), NODE, np.int32)),
        conv_id=pa.array(first[done]),
        depth=pa.array(trie.depth[done].astype(np.int32)),
        parent=pa.array(first[above], mask=root),
        open=pa.array(open_[above]),
        n_convs=pa.array(convs[done]),
        n_children=pa.array(total["children"][done]),
        n_leaves=pa.array(total["leaves"][done]),
        saved_tokens=pa.array(total["saved"][done]),
        end_first=pa.array(end_first[done], mask=end_first[done] == NONE),
    )
    if linked:
        yield batch(len(node), kind=pa.array(np.full(len(node), LINK, np.int32)), conv_id=pa.array(fact["first"]), depth=pa.array(fact["depth"].astype(np.int32)), parent=pa.array(first[node]), open=pa.array(open_[node]))
    told = np.zeros(size, bool)
    for row, way in ways.items():
        new = way[~told[way]]
        told[way] = True
        columns = {"depth": trie.depth, "ends": total["ends"], "members": total["members"], "first": first, "children": total["children"], "leaves": total["leaves"], "saved": total["saved"], "end_first": end_first}
        facts = [dict(zip(FACTS, values, strict=True)) for values in zip(*(columns[name][new].tolist() for name in FACTS), strict=True)]
        yield batch(1, kind=pa.array([PATH], pa.int32()), labels=table["labels"].slice(row, 1).combine_chunks(), words=table["words"].slice(row, 1).combine_chunks(), facts=pa.array([facts], SCHEMA.field("facts").type))


LONG, INT = pa.int64(), pa.int32()
SCHEMA = pa.schema(
    [("kind", INT), ("conv_id", LONG), ("depth", INT), ("parent", LONG), ("open", pa.bool_()), *((c, LONG) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "end_first")), ("labels", pa.list_(pa.binary())), ("words", pa.list_(INT)), ("facts", pa.list_(pa.struct([(n, INT if n == "depth" else LONG) for n in FACTS])))]
)


def batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the result; columns not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in SCHEMA], schema=SCHEMA)


def tier(paths: DataFrame, shards: int, linked: bool) -> DataFrame:
    """The results of all shards of these paths."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard(pa.Table.from_batches(held), shards == 1, linked)

    dealt = paths.coalesce(1) if shards == 1 else paths.repartitionByRange(shards, "labels")
    return common.stored(dealt.sortWithinPartitions("labels").mapInArrow(common.lean(each), RESULT), "tier")


def nodes(conversations: DataFrame, turns: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of rebuilt conversations; ``turns`` go into a shard."""
    spark = conversations.sparkSession
    common.tune(spark)
    whole = common.stored(united(common.stored(rebuilt(conversations), "rebuilt")), "united")
    none = F.lit(0).cast("long")
    fact = F.struct(F.size("labels").alias("depth"), F.col("n").alias("ends"), none.alias("members"), "first", none.alias("children"), none.alias("leaves"), none.alias("saved"), F.col("first").alias("end_first"))
    paths = whole.select("labels", "words", F.array(fact).alias("facts"))
    tiers: list[DataFrame] = []
    while True:
        rows, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("labels")), F.lit(0))).head()
        most = rows if not tiers else rows // LEAST_PATHS  # paths of upper levels must become fewer
        shards = max(1, min(most, max(-(-size // turns), 0 if tiers else common.partitions(spark))))
        tiers.append(tier(paths, shards, bool(tiers)))
        if shards == 1:
            break
        paths = tiers[-1].filter(F.col("kind") == PATH).select("labels", "words", "facts")
    names, found = None, None
    for result in reversed(tiers):
        own = result.filter(F.col("kind") == NODE).drop("kind", "labels", "words", "facts")
        if names is not None:  # the tier above says what kept back parents are called
            own = own.join(names, (F.col("parent") == F.col("called")) & (F.col("depth") == F.col("at") + 1) & F.col("open"), "left").withColumn("parent", F.coalesce("name", "parent")).drop("called", "at", "name")
        found = own if found is None else found.unionByName(own)
        links = result.filter(F.col("kind") == LINK).select(F.col("conv_id").alias("called"), F.col("depth").alias("at"), F.col("parent").alias("name"), "open").distinct()
        if names is not None:
            above = names.select(F.col("called").alias("name"), "at", F.col("name").alias("further"))
            links = links.join(above, ["name", "at"], "left").withColumn("name", F.when(F.col("open"), F.col("further")).otherwise(F.col("name")))
        names = links.select("called", "at", "name")
    ends = whole.select(F.col("first").alias("end_first"), "ends_sha256")
    counted = found.join(ends, "end_first", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return counted.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
