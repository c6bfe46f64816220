"""Concepts and their documentation: coverage by type, priorities, clusters of gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit


def coverage(concepts: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds covered and missing (sorted arrays of document types) to concepts (concept_id, source_files, appropriate_types, ...).

    ``docs`` has (path, classification, matched); a document covers a concept if it matches one of its files.
    """
    files = concepts.select("concept_id", F.explode("source_files").alias("source")).distinct()
    # a file's types and a concept's come once each, however many documents and files give them
    types = docs.select("classification", F.explode("matched").alias("source")).distinct()
    found = files.join(types, "source").select("concept_id", "classification").distinct()
    hits = found.groupBy("concept_id").agg(F.array_sort(F.collect_set("classification")).alias("covered"))
    joined = concepts.join(hits, "concept_id", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    return joined.withColumn("missing", F.array_sort(F.array_except("appropriate_types", "covered")))


def summary(covered: DataFrame) -> DataFrame:
    """(type, needed, have): how many concepts want a type, and how many have it."""
    return covered.select(F.explode("appropriate_types").alias("type"), "covered").groupBy("type").agg(F.count("*").alias("needed"), F.count_if(F.array_contains("covered", F.col("type"))).alias("have"))


def priorities(covered: DataFrame) -> DataFrame:
    """Adds score, label and signals, the most urgent first."""
    tests = {"undocumented": F.size("covered") == 0, "widely_used": F.col("fan_in") >= 5, "used": F.col("fan_in").between(2, 4), "large_surface": F.col("public_count") >= 10, "several_gaps": F.size("missing") >= 2}
    weights = {"undocumented": 3, "widely_used": 3, "used": 1, "large_surface": 2, "several_gaps": 1}
    score, label = audit.priority([(tests[k], weights[k]) for k in tests], 6, 3)
    signals = F.array_compact(F.array(*(F.when(tests[k], F.lit(k)) for k in tests)))
    rank = F.when(F.col("label") == "high", 0).when(F.col("label") == "medium", 1).otherwise(2)
    return covered.withColumns({"score": score, "label": label, "signals": signals}).orderBy(rank, F.desc("score"), "concept_id")


def shared_gaps(clusters: DataFrame) -> DataFrame:
    """(leader, shared): the types that all concepts of a cluster lack; rows: (leader, missing)."""
    size = clusters.groupBy("leader").agg(F.count("*").alias("n"))
    each = clusters.select("leader", F.explode(F.array_distinct("missing")).alias("type")).groupBy("leader", "type").agg(F.count("*").alias("c"))
    return each.join(size, "leader").where("c = n").groupBy("leader").agg(F.array_sort(F.collect_set("type")).alias("shared"))
