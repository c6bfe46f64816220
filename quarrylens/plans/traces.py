"""What exploration traces tell: events (slug, category, seq, action, target, kind) by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_kind(pattern: Column, needles: Column) -> Column:
    """What a search was for: the finding's own names, a definition, an import, or something else."""
    return (
        F.when(F.exists(needles, lambda n: F.contains(pattern, n)), "needle")
        .when(pattern.rlike(r"\b(?:def|class|function|interface|struct)\b"), "definition")
        .when(pattern.rlike(r"\b(?:import|require|from)\b"), "import")
        .otherwise("other")
    )


def read_kind(target: Column, path: Column, start: Column, end: Column, line: Column, hits: Column) -> Column:
    """What a read was for: around the finding, elsewhere in its file, a file found by an earlier search, or something else."""
    return F.when((target == path) & (start <= line) & (line <= end), "finding").when(target == path, "same_file").when(F.array_contains(hits, target), "search_hit").otherwise("other")


def with_earlier_hits(events: DataFrame) -> DataFrame:
    """Adds hits: the files that searches before an event found (column found: array of paths)."""
    before = Window.partitionBy("slug").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("hits", F.array_distinct(F.flatten(F.collect_list(F.coalesce("found", F.array().cast("array<string>"))).over(before))))


def distributions(events: DataFrame) -> DataFrame:
    """category, traces, calls_mean, calls_max, first actions as a map."""
    per_trace = events.groupBy("category", "slug").agg(F.count("*").alias("calls"), F.min_by("action", "seq").alias("first"))
    firsts = per_trace.groupBy("category", "first").agg(F.count("*").alias("n")).groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("first", "n")))).alias("first_actions"))
    sizes = per_trace.groupBy("category").agg(F.count("*").alias("traces"), F.avg("calls").alias("calls_mean"), F.median("calls").alias("calls_median"), F.max("calls").alias("calls_max"))
    return sizes.join(firsts, "category")


def presence(events: DataFrame) -> DataFrame:
    """category, kind, rate: the share of a category's traces in which a kind of event occurs."""
    traces = events.groupBy("category").agg(F.countDistinct("slug").alias("n"))
    return events.groupBy("category", "kind").agg(F.countDistinct("slug").alias("c")).join(traces, "category").select("category", "kind", (F.col("c") / F.col("n")).alias("rate"))


def proposal(rates: DataFrame, required: float = 0.7, optional: float = 0.3) -> DataFrame:
    """category, kind, tier of the kinds of evidence that come up often enough."""
    tier = F.when(F.col("rate") >= required, "required").when(F.col("rate") >= optional, "optional")
    return rates.select("category", "kind", tier.alias("tier")).where("tier IS NOT NULL")
