"""Greedy clustering around leaders, an order-dependent choice made in parallel rounds.

In order, each owner joins the first leader whose set it overlaps by more than a share of the smaller set (and with
which it shares a tag, where tags are given), else it leads. Who leads depends on earlier owners only: one is decided as soon
as an earlier neighbour leads, or all earlier neighbours are decided and none does. So each round decides all owners that can
be: the first ones of what is left lead, their neighbours follow. Rounds are few unless neighbours form a long chain in
order; they end in any case, since the least undecided owner is decided in each.

The first owners are decided so, then those left meet the leaders among them only, and what no leader takes is next, in
blocks that grow fourfold. So the owners' pairs are made within blocks; where leaders cover most of what follows, the work grows
as owners times leaders, not as pairs of owners.

Owners of equal sets and tags are decided as one: what takes the first of them takes all. Neighbours are found by an inverted
index of the rarest items that a smaller set must share in part, so no group meets as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Owners of the first block.
BLOCK = 4096


def meeting(left: DataFrame, right: DataFrame, share: float, tagged: bool) -> DataFrame:
    """(a, b): owners of ``left`` and of ``right`` whose sets overlap by more than ``share`` of the smaller, and that share a tag; pairs may come repeatedly.

    Rows: (scope, owner, items, tags), the items from the rarest to the most frequent.
    """
    # of a set that must share k of its n items, any n - k + 1 have one of those
    rare = F.slice("items", F.lit(1), (F.size("items") - F.floor(F.lit(share) * F.size("items"))).cast("int"))

    def by_item(df: DataFrame, name: str, items: str | F.Column) -> DataFrame:
        return df.select("scope", F.explode(items).alias("item"), F.col("owner").alias(name), F.col("items").alias(f"items_{name}"), F.col("tags").alias(f"tags_{name}"))

    smaller = by_item(left, "a", rare).join(by_item(right, "b", "items"), ["scope", "item"]).where(F.size("items_a") <= F.size("items_b"))
    larger = by_item(left, "a", "items").join(by_item(right, "b", rare), ["scope", "item"]).where(F.size("items_a") > F.size("items_b"))
    enough = F.size(F.array_intersect("items_a", "items_b")) > F.lit(share) * F.least(F.size("items_a"), F.size("items_b"))
    meets = enough & F.arrays_overlap("tags_a", "tags_b") if tagged else enough
    return smaller.unionByName(larger).where(meets).select("a", "b")


def chosen(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """(owner): those that lead: in order, all that have no earlier neighbour that leads."""
    left, open_, leading, rounds = owners.select("owner"), edges, None, 0
    while True:
        lead = left.join(open_.select(F.col("late").alias("owner")).distinct(), "owner", "left_anti")
        lead = stored(lead, "lead")
        leading = lead if leading is None else leading.union(lead)
        rounds += 1
        if rounds % 8 == 0:
            leading = stored(leading, "leading")
        follow = stored(open_.join(lead.withColumnRenamed("owner", "early"), "early", "left_semi").select(F.col("late").alias("owner")).distinct(), "follow")
        decided = lead.union(follow)
        left = stored(left.join(decided, "owner", "left_anti"), "left")
        if left.isEmpty():
            return leading
        # owners that follow bind nobody
        open_ = stored(open_.join(decided.withColumnRenamed("owner", "late"), "late", "left_anti").join(follow.withColumnRenamed("owner", "early"), "early", "left_anti"), "open")


def leader_clusters(df: DataFrame, owner: str, items: str, share: float = 0.5, tags: str | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """owner, leader: whom each owner joins, itself if it leads. Owners are distinct and meet only where all of ``scope`` is equal.

    A null or empty set, or with ``tags`` a null or empty array of tags, joins nobody. Repeated items count once; null items are none.
    """

    def as_set(column: str) -> F.Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.col(column))))

    where = F.to_json(F.struct(F.lit(0), *scope), {"ignoreNullFields": "false"}).alias("scope")
    rows = df.select(F.col(owner).alias("owner"), as_set(items).alias("items"), (as_set(tags) if tags else F.array(F.lit(""))).alias("tags"), where)
    rows = stored(rows, "owners")
    able = F.col("owner").isNotNull() & F.coalesce((F.size("items") > 0) & (F.size("tags") > 0), F.lit(False))
    classes = stored(rows.where(able).groupBy("scope", "items", "tags").agg(F.min("owner").alias("first")), "classes")
    of = classes.select("scope", F.col("first").alias("owner"), "tags", F.explode("items").alias("item"))
    often = of.groupBy("scope", "item").agg(F.count("*").alias("often"))
    ranked = of.join(often, ["scope", "item"]).groupBy("scope", "owner").agg(F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("often", "item"))).alias("ranked"))
    left = stored(ranked.select("scope", "owner", F.col("ranked.item").alias("items"), "tags"), "left")
    parts, size = [], BLOCK
    while not left.isEmpty():
        edge = F.broadcast(left.select("owner").orderBy("owner").limit(size).agg(F.max("owner").alias("edge")))
        block = stored(left.crossJoin(edge).where("owner <= edge").drop("edge"), "block")
        edges = stored(meeting(block, block, share, bool(tags)).where("a < b").select(F.col("a").alias("early"), F.col("b").alias("late")).distinct(), "edges")
        lead = stored(chosen(block, edges), "leading")
        others = left.join(lead, "owner", "left_anti")
        follow = meeting(others, block.join(lead, "owner", "left_semi"), share, bool(tags)).groupBy(F.col("a").alias("owner")).agg(F.min("b").alias("leader"))
        parts.append(stored(follow.union(lead.select("owner", F.col("owner").alias("leader"))), "joined"))
        left = stored(left.join(parts[-1], "owner", "left_anti"), "left")
        size *= 4
    member = rows.where(able).join(classes, ["scope", "items", "tags"]).select("owner", "first")
    joined = reduce(DataFrame.union, parts) if parts else classes.select("first", F.col("first").alias("leader"))
    found = member.join(joined.toDF("first", "leader"), "first").select("owner", "leader")
    alone = rows.where(~able).select("owner", F.col("owner").alias("leader"))
    return found.union(alone).withColumnRenamed("owner", owner)
