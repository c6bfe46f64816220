"""Documents as trees: the leaves of JSON of any depth, and nested documents put together from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import kind_of
from ..sources.storage import stored

LEAF = "string,boolean,integer,number,null"


def json_leaves(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, path, kind, value) of every leaf of JSON texts: strings, numbers, booleans and nulls, at any depth.

    Each round opens one level of all documents at once, so there are as many rounds as the deepest document has levels, and
    one document's values are spread like other rows after a round. A path is written ``$.key[0]["other key"]``. Texts that are
    no JSON, null ones, and empty objects and arrays have no leaves.
    """
    spark = df.sparkSession
    inner = stored(df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(document).alias("v")).where("v IS NOT NULL").withColumn("kind", kind_of(F.col("v"))), "level")
    found = None
    while True:
        leaves = inner.where(F.col("kind").isin(LEAF.split(","))).select(*keys, "path", "kind", F.col("v").cast("string").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        open_ = inner.where(F.col("kind").isin("object", "array"))
        if open_.isEmpty():
            return found
        each = open_.drop("kind").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("__pos", "__key", "__value"))
        plain = F.col("__key").rlike(r"^[A-Za-z_]\w*$")
        step = F.when(F.col("__key").isNull(), F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), "__key")).otherwise(F.concat(F.lit('["'), "__key", F.lit('"]')))
        inner = stored(each.select(*keys, F.concat("path", step).alias("path"), F.col("__value").alias("v")).withColumn("kind", kind_of(F.col("v"))), "level")


def named_files(leaves: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """(keys, file): files that string leaves name, by slashes of either kind and from the top."""
    path = F.regexp_replace(F.translate("value", "\\", "/"), r"^(?:\./)+", "")
    return leaves.where("kind = 'string'").select(*keys, path.alias("file")).distinct().join(files.select(F.col("path").alias("file")), "file", "left_semi").select(*keys, "file")


def assembled(nodes: DataFrame, node: str, parent: str, fields: list[str], order: list[str]) -> DataFrame:
    """(node, document): one nested VARIANT document for each root, with a list ``children`` in every node that has some.

    A root has no parent among the nodes. Children are in ``order``. Levels are put together from the deepest; each is a
    stored table, so a plan has one level only, whatever the depth. A node is part of its root's document as a whole, so
    a tree must be one that a reader can hold; nodes on a cycle belong to no root and are left out.
    """
    base = stored(nodes.select(node, parent, *dict.fromkeys([*fields, *order])), "nodes")
    front = base.join(base.select(F.col(node).alias(parent)), parent, "left_anti").select(node)
    levels = []
    while not front.isEmpty():
        levels.append(front)
        front = stored(base.select(node, parent).join(front.withColumnRenamed(node, parent), parent).select(node), "front")

    def before(a: Column, b: Column) -> Column:
        return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)

    below = None
    for level in reversed(levels):
        own = base.join(level, node, "left_semi")
        body = [F.col(f).alias(f) for f in fields]
        told = F.to_variant_object(F.struct(*body))
        if below is not None:
            child = F.struct(F.struct(*order, node).alias("at"), F.col("document").alias("v"))
            lists = below.groupBy(parent).agg(F.array_sort(F.collect_list(child), before).alias("__c")).select(F.col(parent).alias(node), F.transform("__c", lambda c: c["v"]).alias("children"))
            own = own.join(lists, node, "left")
            told = F.when(F.col("children").isNull(), told).otherwise(F.to_variant_object(F.struct(*body, "children")))
        below = stored(own.select(node, parent, *dict.fromkeys(o for o in order if o not in (node, parent)), told.alias("document")), "documents")
    if below is None:
        return base.select(node, F.parse_json(F.lit("{}")).alias("document")).limit(0)
    return below.select(node, "document")
