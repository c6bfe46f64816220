"""Near copies: the SimHash index on five-word shingles, and what it cannot reach by the exact Jaccard similarity, 4/5 or more.

Fingerprints of texts at that similarity may differ in twenty bits, which share no positional byte, so the
index of ``simhash`` gives a first part of the candidates only, and prefix filtering completes them. Every
text is the set of its shingles' hashes, the rarest first in one order for all texts. Two sets that
reach the similarity share one of the first n - ceil(4/5 n) + 1 hashes of each, so the postings of those
prefixes lack no pair. The order puts hashes that a sample of the texts has often last; it is a matter of
speed, as any order gives all pairs. Postings of up to ``SMALL`` sets give all their pairs; of larger ones no more
than SMALL + 1 sets are ever brought together, and each set is compared with a few leaders. Sets of a larger posting
that these links leave in different classes are cut into parts by the hashes' values, as many as the most hashes that two near
sets of that size may not share, one more and some to spare. Near sets have the same hashes in all parts but those, so by
the same rule for prefixes they share one of the first parts of each; parts of rare hashes come first. A part
is several hashes at once, so texts that share frequent passages only rarely meet in one. Parts' postings go the same way, and
where a large one still has several classes, its sets are taken as differences from the group's core, the hashes that most of some
members have. Differences are as far apart as the sets are, but short where sets are copies of one text: two that are short enough
are near for certain, so one set links all of these, and of the others a near pair shares so many elements that it shares one of
the rarest few of each. Hashes that one class alone has count as not shared, so copies that are too far from all others meet none.
All candidates, the index's too, are verified on the whole sets, made again from the texts that a bitmap of their keys lets
through. Classes are chains of links, as in ``simhash``.

Rows: a null or blank text has the empty set, and those are one class; texts of fewer words than a shingle are one
shingle; repeated rows and ties share a class; a class gives a row of its least doc_id (null if it has no
other); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from . import common
from .simhash import SALTS, components, links, majority, shingle_hashes

#: Words of a shingle; the similarity that links, as a fraction.
WIDTH, NUM, DEN = 5, 4, 5
#: Share of texts that are sampled for the order, sampled texts that make a hash frequent, frequent hashes at most.
SAMPLE, OFTEN, FREQUENT = 8, 8, 20_000
#: Sets of a posting that gives all pairs at once; leaders of a larger one.
SMALL, LEADERS = 16, 4
#: Members of a group that elect its core.
VOTERS = 15
#: Pairs of a batch; bits of a bitmap of keys, in Spark's buckets of 2^15.
PAIRS, CELLS = 1 << 16, 1 << 26


def _bounds() -> np.ndarray:
    """The least size of each level of sizes: a set and a larger one that is near are of one level or of neighbouring ones."""
    found = [1]
    while found[-1] < 1 << 31:
        found.append(DEN * found[-1] // NUM + 1)
    return np.array(found, np.int64)


BOUNDS = _bounds()


def shingle_set(data: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(data, WIDTH))


def places(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """0 for a set's rare hashes, the rank and one more for frequent ones. frequent: ascending."""
    if not len(frequent) or not len(found):
        return np.zeros(len(found), np.int64)
    place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    return np.where(frequent[place] == found, ranks[place] + 1, 0)


def prefix(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of a set's hashes: rare ones, then frequent ones by rank."""
    size = len(found) - (NUM * len(found) + DEN - 1) // DEN + 1
    return found[np.argsort(places(found, frequent, ranks), kind="stable")][:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The keys of a set's first parts, as the smaller and as the larger one of a near pair."""
    keys, own = [], int(np.searchsorted(BOUNDS, len(found), side="right")) - 1
    place, split = places(found, frequent, ranks), _mixed(found)
    # a rare hash weighs more than any number of frequent ones that a part is likely to have
    weights = np.where(place == 0, 4 * (len(frequent) + 2), len(frequent) + 2 - place).astype(np.float64)
    for level in (own, own - 1):
        most = int(BOUNDS[level + 1]) - 1
        if level < 0 or NUM * len(found) > DEN * most:
            continue
        apart = most * (DEN - NUM) // NUM
        count = apart + 1 + -(-apart // 4)
        part = (split % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, part, _mixed(split + np.uint64(1)))
        key = _mixed(sums + _mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(level << 32)))
        keys.append(key[np.lexsort((key, -np.bincount(part, weights, minlength=count)))[: apart + 1]])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the number of hashes by their low bits, as many as a power of two that is no less than the set's size."""
    size = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    parities = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parities.astype(np.uint8), bitorder="little").tobytes()


def may_reach(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only if two sets of these sizes and sketches cannot reach the similarity."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return NUM * max(n, m) <= DEN * min(n, m) and (DEN + NUM) * int(np.bitwise_count(a ^ b).sum()) <= (DEN - NUM) * (n + m)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(common.text_of()).alias("key"), common.text_of().alias("text"))


def frequent_hashes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many of the sampled texts have, ascending, and their ranks by frequency."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].cast(pa.large_binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text).view(np.int64))], names=["hash"])

    sample = rows.where(F.pmod("key", F.lit(SAMPLE)) == 0).select("key", "text").dropDuplicates(["key"]).select("text")
    counts = sample.mapInArrow(common.lean(each), "hash long").groupBy("hash").count().where(F.col("count") >= OFTEN)
    top = [r["hash"] for r in counts.orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()]
    values = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(top) - order).astype(np.int64)


def text_rows(rows: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(doc_id, key, node, n, prefix, sketch, fp): each row's set by its own hash, its size, prefix and sketch, and the fingerprint."""
    schema = StructType([rows.schema["doc_id"]]).add("key", "long").add("node", "long").add("n", "integer").add("prefix", ArrayType(LongType())).add("sketch", "binary").add("fp", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(x, WIDTH) for x in batch["text"].cast(pa.large_binary()).to_pylist()]
            prints = np.array(list(map(majority, hashes)), np.uint64).view(np.int64)
            sets = list(map(np.unique, hashes))
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            first = pa.array([prefix(s, frequent, ranks).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(nodes), pa.array(list(map(len, sets)), pa.int32()), first, pa.array(map(sketch, sets), pa.binary()), pa.array(prints)], names=schema.names)

    return rows.mapInArrow(common.lean(each), schema)


def posting_pairs(nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a posting's sets of different labels that are near enough in size."""
    order = np.lexsort((nodes, sizes))
    nodes, sizes, labels = nodes[order], sizes[order].astype(np.int64), labels[order]
    stops = np.searchsorted(NUM * sizes, DEN * sizes, side="right")
    for i in range(len(nodes)):
        other = np.flatnonzero(labels[i + 1 : stops[i]] != labels[i]) + i + 1
        yield np.full(len(other), nodes[i]), nodes[other]


def postings(members: DataFrame) -> DataFrame:
    """(key, members): of each key SMALL + 1 sets at most, those of the least nodes, which are hashes; keys of one set only are left out. members: (key, node, n, label)."""
    least = members.withColumn("place", F.dense_rank().over(Window.partitionBy("key").orderBy("node"))).where(F.col("place") <= SMALL + 1)
    return least.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "n", "label"))).alias("members")).where(F.size("members") > 1)


def small_pairs(posted: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of all postings that are whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def batch_of() -> pa.RecordBatch:
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            members = batch["members"]
            ends, flat = members.offsets.to_numpy(), members.values
            nodes, sizes, labels = (flat.field(k).to_numpy() for k in ("node", "n", "label"))
            for start, stop in zip(ends[:-1], ends[1:], strict=True):
                for pair in posting_pairs(nodes[start:stop], sizes[start:stop], labels[start:stop]):
                    held.append(pair)
                    count += len(pair[0])
                if count >= PAIRS:
                    yield batch_of()
                    held, count = [], 0
        if count:
            yield batch_of()

    return posted.where(F.size("members") <= SMALL).select("members").mapInArrow(common.lean(each), "a long, b long").distinct()


def crowded(members: DataFrame, posted: DataFrame) -> DataFrame:
    """(key, node, n, label, leaders): the members of large postings. A frequent key's members are dealt out by salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    large = posted.where(F.size("members") > SMALL).select("key", F.slice("members", 1, LEADERS).alias("leaders"), salts)
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["key", "salt"]).drop("salt")


def _near_in_size(n: str, m: str) -> F.Column:
    return NUM * F.greatest(n, m) <= DEN * F.least(n, m)


def leader_pairs(crowd: DataFrame) -> DataFrame:
    """(a, b), a < b: each set of a large posting with the posting's leaders of other labels."""
    each = crowd.select("node", "n", "label", F.explode("leaders").alias("leader"))
    near = each.where((F.col("label") != F.col("leader.label")) & _near_in_size("n", "leader.n"))
    return near.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def mixed_keys(crowd: DataFrame) -> DataFrame:
    """(key, group): those whose sets have several labels, with the least of their nodes."""
    ends = crowd.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("group"))
    return ends.where("low != high").select("key", "group")


def cores(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, core): the hashes that most of a group's first members have; no row where there is none. Any core gives all pairs. members: (group, node)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, voters, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group)), pa.array(np.full(len(found), voters)), pa.array(found)], names=["group", "voters", "hash"])

    first = members.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("node"))).where(F.col("place") <= VOTERS)
    voters = first.join(first.groupBy("group").agg(F.count("*").cast("long").alias("voters")), "group").join(sets, "node").select("group", "voters", "hashes")
    votes = voters.mapInArrow(common.lean(each), "group long, voters long, hash long").groupBy("group", "voters", "hash").count()
    return votes.where(2 * F.col("count") > F.col("voters")).groupBy("group").agg(F.collect_list("hash").alias("core"))


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, node, label, far, difference): what is in a set or its group's core only; two sets are near for certain if their far sum up to 0 or less. members: (group, node, label)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, found = [], []
            for x, core in zip(batch["hashes"].to_pylist(), batch["core"].to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64)
                found.append(np.setxor1d(x, np.array(core or [], np.int64), assume_unique=True))
                far.append((DEN + NUM) * len(found[-1]) - (DEN - NUM) * len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(far, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["group", "node", "label", "far", "difference"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = members.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    both = dealt.join(cores(members, sets).select("group", "core", salts), ["group", "salt"], "left")
    return both.select("group", "node", "label", "hashes", "core").mapInArrow(common.lean(each), "group long, node long, label long, far long, difference array<long>")


def group_classes(found: DataFrame) -> DataFrame:
    """(group, label, class, other, a, b): labels whose least far set is near the group's least far one for certain are of that one's class, by the link a, b;
    other is the least far of the other classes, null if there is none."""
    lows = found.groupBy("group", "label").agg(F.min(F.struct("far", "node")).alias("low"))
    lows = lows.join(lows.groupBy("group").agg(F.min(F.struct("low", "label")).alias("first")), "group")
    joins = (F.col("label") != F.col("first.label")) & (F.col("low.far") + F.col("first.low.far") <= 0)
    lows = lows.withColumn("joins", joins).withColumn("class", F.when(F.col("joins"), F.col("first.label")).otherwise(F.col("label")))
    second = lows.where(F.col("class") != F.col("first.label")).groupBy("group").agg(F.min("low.far").alias("second"))
    other = F.when(F.col("class") != F.col("first.label"), F.col("first.low.far")).otherwise(F.col("second"))
    ends = [F.when(F.col("joins"), end("low.node", "first.low.node")) for end in (F.least, F.greatest)]
    return lows.join(second, "group", "left").select("group", "label", "class", other.alias("other"), ends[0].alias("a"), ends[1].alias("b"))


def apart_pairs(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: sets of one group and different classes that may be near, by their differences' rarest elements.

    Near sets share at least (far + far) / (2 * (DEN + NUM)) elements of their differences. In one order for a group, no more are left from the first
    one they share on, so what is left there bounds how far the partner can be. Of a pair, the less far set is the near one; its partners are as far at least.
    """
    items = found.join(classes.where("other is not null").select("group", "label", "class", "other"), ["group", "label"]).select("group", "node", "class", "far", "other", F.explode("difference").alias("element"))
    shared = items.groupBy("group", "element").agg(F.count("*").alias("count"), F.min("class").alias("low"), F.max("class").alias("high")).where("low != high")
    left = F.row_number().over(Window.partitionBy("group", "node").orderBy(F.desc("count"), "element"))
    items = items.join(shared.select("group", "element", "count"), ["group", "element"]).withColumn("reach", 2 * (DEN + NUM) * left - F.col("far"))
    items = common.stored(items.where(F.col("reach") >= F.col("other")).select("group", "element", "node", "class", "far", "other", "reach"), "items")
    a, b = (items.select("group", "element", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "class", "far", "other", "reach"))) for x in "ab")
    b = b.where(F.col("reach_b") >= F.col("far_b"))
    order = (F.col("far_a") > F.col("far_b")) | (F.col("far_a") == F.col("far_b")) & (F.col("node_a") > F.col("node_b"))
    near = a.join(b, ["group", "element"]).where(order & (F.col("class_a") != F.col("class_b")) & (F.col("reach_a") >= F.col("far_b")) & (F.col("reach_b") >= F.col("far_a")))
    return near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def group_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates that link all classes of a group which near sets of it link. members: (group, node, label)."""
    found = common.stored(differences(members, sets), "differences")
    classes = common.stored(group_classes(found), "classes")
    return classes.where("a is not null").select("a", "b").union(apart_pairs(found, classes)).distinct()


def _with_both(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of a's and b's node."""
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs.select("a", "b", *(f"{c}_{side}" for c in columns for side in ("a", "b")))


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches are near enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [may_reach(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _with_both(pairs, nodes, "n", "sketch").mapInArrow(common.lean(each), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _with_both(pairs, sets, "hashes").mapInArrow(common.lean(each), "a long, b long")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap, always of CELLS bits, of the column ``key``."""
    cell = F.pmod("key", F.lit(CELLS))
    marks = keys.select(F.shiftright(cell, 15).alias("bucket"), F.pmod(cell, F.lit(1 << 15)).alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    bitmap = np.zeros(CELLS >> 3, np.uint8)
    for r in marks.toLocalIterator():
        bitmap[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cells = keys % CELLS
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def prefix_members(found: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(key, node, n, label): the places of prefixes whose hash the bitmap has; each set has a label of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["prefix"]
            keys = lists.flatten().to_numpy()
            at = in_bitmap(bitmap, keys)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[at]
            nodes, sizes = batch["node"].to_numpy()[row], batch["n"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(nodes), pa.array(sizes), pa.array(nodes)], names=["key", "node", "n", "label"])

    return found.select("node", "n", "prefix").mapInArrow(common.lean(each), "key long, node long, n int, label long")


def part_members(sets: DataFrame, frequent: np.ndarray, ranks: np.ndarray, bitmap: np.ndarray | None = None) -> DataFrame:
    """(key, node, n, label): the first parts of the sets (node, hashes, label), those that the bitmap has if one is given."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, x, label in zip(*(batch[c].to_pylist() for c in ("node", "hashes", "label")), strict=True):
                found = np.frombuffer(x, np.uint64)
                keys = parts_of(found, frequent, ranks).view(np.int64)
                if bitmap is not None:
                    keys = keys[in_bitmap(bitmap, keys)]
                columns = (keys, np.full(len(keys), node), np.full(len(keys), len(found), np.int32), np.full(len(keys), label))
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "node", "n", "label"])

    return sets.mapInArrow(common.lean(each), "key long, node long, n int, label long")


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (doc_id, key, node), once each."""
    bitmap = bitmap_of(wanted)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap, batch["key"].to_numpy())))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x).tobytes() for x in batch["text"].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.binary())], names=["node", "hashes"])

    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "node")
    some = rows.mapInArrow(common.lean(through), rows.schema)
    texts = some.join(wanted, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
    return texts.mapInArrow(common.lean(each), "node long, hashes binary").dropDuplicates(["node"])


def linked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that reach the similarity, by sketches first."""
    near = common.stored(sketched(pairs, nodes), "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
    wanted = common.stored(nodes.select("node", "doc_id", "key").join(wanted, "node"), "wanted")
    return verified(near, common.stored(sets_of(rows, wanted), "sets"))


def index_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: sets whose fingerprints the SimHash index links; of sets with one fingerprint the least stands for all."""
    least = common.stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    found = links(least.select("fp").repartition(common.partitions(nodes.sparkSession), "fp"))
    for side in ("a", "b"):
        found = found.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}")), side)
    equal = nodes.select("fp", "node").join(least, "fp").where(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).union(equal)


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members with these labels, or their own nodes."""
    return members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_labels(rows: DataFrame, found: DataFrame, nodes: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(node, label) of the sets that are linked to another. nodes: (node, n, sketch, fp, doc_id, key), the last two of a row that has the set."""
    posted = common.stored(postings(found.select(F.explode("prefix").alias("key"), "node", "n", F.col("node").alias("label"))), "postings")
    crowd = common.stored(crowded(prefix_members(found, bitmap_of(posted.where(F.size("members") > SMALL))), posted), "crowd")
    edges = common.stored(linked(rows, nodes, small_pairs(posted).union(leader_pairs(crowd)).union(index_pairs(nodes)).distinct()), "links")
    labels = components(edges)
    if crowd.isEmpty():
        return labels
    now = common.stored(relabelled(crowd.select("key", "node").distinct(), labels), "crowd")
    open_ = common.stored(nodes.select("node", "doc_id", "key").join(now.join(mixed_keys(now), "key", "left_semi").select("node").distinct(), "node", "left_semi"), "open")
    sets = common.stored(relabelled(sets_of(rows, open_), labels), "sets")
    # parts are made twice rather than stored, the second time those of large postings only
    posted = common.stored(postings(part_members(sets, frequent, ranks)), "postings")
    crowd = common.stored(crowded(part_members(sets, frequent, ranks, bitmap_of(posted.where(F.size("members") > SMALL))), posted), "crowd")
    near = common.stored(sketched(small_pairs(posted).union(leader_pairs(crowd)).distinct(), nodes), "near")
    edges = common.stored(edges.union(verified(near, sets)), "links")
    labels = components(edges)
    if crowd.isEmpty():
        return labels
    now = common.stored(relabelled(crowd.select("key", "node"), labels), "crowd")
    members = common.stored(now.join(mixed_keys(now), "key").select("group", "node", "label").distinct(), "members")
    near = common.stored(sketched(group_pairs(members, sets.select("node", "hashes")), nodes), "near")
    return components(edges.union(verified(near, sets)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: a row of its least doc_id (null if it has no other)."""
    common.tune(docs.sparkSession)
    rows = _keyed(docs)
    frequent, ranks = frequent_hashes(rows)
    found = common.stored(text_rows(rows, frequent, ranks), "texts")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    own = [F.min(c).alias(c) for c in ("n", "sketch", "fp")]
    nodes = common.stored(found.groupBy("node").agg(least, *own).select("node", "n", "sketch", "fp", "least.doc_id", "least.key"), "nodes")
    labels = near_labels(rows, found, nodes, frequent, ranks)
    first = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(least)
    winners = common.stored(first.select(F.col("least.doc_id").alias("__id"), F.col("least.key").alias("__key")), "winners")
    wide = common.boxed(docs, "doc_id", "text").select(common.ROW, "doc_id", F.xxhash64(common.text_of()).alias("key"))
    kept = wide.join(winners, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    # rows that share doc_id and text are still too many; most tables have none
    if not found.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        kept = kept.groupBy("doc_id", "key").agg(F.min_by(common.ROW, F.xxhash64(f"{common.ROW}.text")).alias(common.ROW))
    return common.unboxed(kept, docs.columns)
