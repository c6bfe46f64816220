"""Graphs as edge tables. Loops run a few jobs a round, cut lineage each time, and bring only counts to the driver."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut, stored

#: Parts that a label's nodes are dealt to.
SALTS = 16
#: Neighbours from which on a list stays where it is.
LONG = 1024


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth): all nodes that directed edges lead to from seeds that are in the graph, breadth first.

    Edges and fronts are tables whose sizes Spark knows, so edges are shuffled only for a large front.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    asked = stored(seeds.select("node").distinct(), "seeds")
    ends = [edges.select(F.col(end).alias("node")).join(asked, "node").distinct() for end in ("src", "dst")]
    seen = front = stored(ends[0].union(ends[1]).distinct().withColumn("depth", F.lit(0)), "front")
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.union(front)
        if depth % 8 == 0:
            seen = stored(seen, "seen")
    return seen


def unreachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(reachable(edges, seeds), "node", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component; labels spread to neighbours and jump through their own labels."""
    both = cut(both_ways(edges))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node").select("node", F.least("label", "heard").alias("next"), "label")
        # labels that are no roots yet; a large component's nodes share theirs, so the join is salted
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        jump = told.where(F.col("next") != F.col("node")).select(F.col("node").alias("next"), F.col("next").alias("further"), salts)
        salted = told.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(jump, ["next", "salt"], "left")
        step = cut(salted.select("node", F.coalesce("further", "next").alias("label"), (F.coalesce("further", "next") != F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst) linked directly or over one node between."""
    one = edges.select("src", "dst").distinct()
    more = one.select("src", F.col("dst").alias("via")).join(one.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    return one.union(more).distinct()


def within_two(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the pairs (src, dst) that are linked directly or over one node between, without making any other pair."""
    return linked(pairs.select("src", "dst").distinct(), neighbours(edges))


class Neighbours(NamedTuple):
    edges: DataFrame
    #: (node, out, codes): what a node leads to, itself among it, and what leads to it.
    lists: DataFrame
    #: (src): nodes that lead to more than LONG others.
    long: DataFrame
    #: (__code): codes that several nodes have.
    several: DataFrame


def code(node: str) -> Column:
    """32 bits of a node; several nodes may have the same."""
    return F.hash(node)


def neighbours(edges: DataFrame) -> Neighbours:
    """Edges (src, dst) prepared for `linked`, all in stored tables."""
    one = stored(edges.select("src", "dst").distinct(), "links")
    out = one.groupBy(F.col("src").alias("node")).agg(F.collect_list(code("dst")).alias("codes")).select("node", F.lit(True).alias("out"), F.array_append("codes", code("node")).alias("codes"))
    into = one.groupBy(F.col("dst").alias("node")).agg(F.collect_list(code("src")).alias("codes")).select("node", F.lit(False).alias("out"), "codes")
    lists = stored(out.union(into), "neighbours")
    several = lists.select("node", code("node").alias("__code")).groupBy("__code").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    return Neighbours(one, lists, stored(lists.where(F.col("out") & (F.size("codes") > LONG)).select(F.col("node").alias("src")), "long-lists"), stored(several.select("__code"), "codes-of-several"))


def linked(pairs: DataFrame, around: Neighbours) -> DataFrame:
    """Those of the pairs (src, dst, each once, and more columns) that are linked directly or over one node between.

    What src leads to, src among it, and what leads to dst are two lists of codes, which must share one; a pair takes one list to
    the other, that of src unless it is longer than LONG. So a pair is one row however many neighbours it has. A shared code that
    only one node has settles it; pairs with others are looked up in the edges.
    """
    one, lists = around.edges, around.lists
    turned = F.coalesce("__long", F.lit(False))
    asked = pairs.join(around.long.withColumn("__long", F.lit(True)), "src", "left").withColumns({"__near": F.when(turned, F.col("dst")).otherwise(F.col("src")), "__far": F.when(turned, F.col("src")).otherwise(F.col("dst")), "__out": ~turned})
    sent = asked.join(lists.select(F.col("node").alias("__near"), F.col("out").alias("__out"), F.col("codes").alias("__sent")), ["__near", "__out"])
    theirs = lists.select(F.col("node").alias("__far"), (~F.col("out")).alias("__out"), "codes")
    met = sent.join(theirs, ["__far", "__out"]).where(F.arrays_overlap("__sent", "codes")).select(*pairs.columns, F.explode(F.array_intersect("__sent", "codes")).alias("__code"))
    found = stored(met.join(around.several.withColumn("__several", F.lit(True)), "__code", "left"), "met")
    sure = found.where("__several IS NULL").select(*pairs.columns).dropDuplicates(["src", "dst"])
    rest = stored(found.where("__several").select(*pairs.columns).dropDuplicates(["src", "dst"]).join(sure.select("src", "dst"), ["src", "dst"], "left_anti"), "unsettled")
    if rest.isEmpty():
        return sure
    over = stored(one.select("src", F.col("dst").alias("__via")).join(rest.select("src", "dst"), "src"), "over")
    known = one.select(F.col("src").alias("__via"), "dst").join(over, ["__via", "dst"]).select("src", "dst").union(one.join(rest.select("src", "dst"), ["src", "dst"])).distinct()
    return sure.union(rest.join(known, ["src", "dst"], "left_semi").select(*pairs.columns))


def fixpoint(start: DataFrame, step) -> DataFrame:
    """Rows of ``start`` and all that ``step(new rows)`` adds, until nothing is new."""
    seen = cut(start.distinct())
    new = seen
    while not new.isEmpty():
        new = cut(step(new).select(*seen.columns).distinct().join(seen.hint("merge"), seen.columns, "left_anti"))
        seen = cut(seen.union(new))
    return seen
