"""Intervals with inclusive integer ends. Every join carries an equality key, so only the rest is a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end of the islands; overlapping and adjacent intervals are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.select(*keys, start, end, F.when(F.col(start) <= reach + 1, 0).otherwise(1).alias("__new"))
    numbered = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def covered(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, covered: how many points the intervals cover together."""
    return merge_intervals(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).cast("long").alias("covered"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """False where any end is null."""
    return F.coalesce((a0 <= b1) & (b0 <= a1) & (F.greatest(a0, b0) <= F.least(a1, b1)), F.lit(False))


def overlap_pairs(df: DataFrame, key: str, row: str, start: str, end: str, width: int, different: str | None = None) -> DataFrame:
    """key, a, b (a < b by row): pairs of a key's overlapping intervals.

    Intervals are spread over buckets of ``width`` points and meet there; a pair counts in the bucket in
    which the later one starts, so a long interval costs its buckets, not a pass over its key.
    """
    spread = df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    cols = [key, row, start, end, "__bucket", *([different] if different else [])]
    a = spread.select(*(F.col(c).alias(f"a_{c}") for c in cols))
    b = spread.select(*(F.col(c).alias(f"b_{c}") for c in cols))
    meets = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("a___bucket") == F.col("b___bucket")) & (F.col(f"a_{row}") < F.col(f"b_{row}"))
    meets &= (F.col(f"a_{start}") <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(f"a_{end}"))
    meets &= F.floor(F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}")) / width) == F.col("a___bucket")
    if different:
        meets &= F.col(f"a_{different}") != F.col(f"b_{different}")
    return a.join(b, meets).select(F.col(f"a_{key}").alias(key), F.col(f"a_{row}").alias("a"), F.col(f"b_{row}").alias("b"))


def smallest_enclosing(points: DataFrame, intervals: DataFrame, key: str, point: str, row: str, interval: str, start: str, end: str, width: int) -> DataFrame:
    """row, interval: for each point the shortest interval of its key around it, the least interval id of equals; points without one are left out."""
    spread = intervals.select(F.col(key), F.col(interval), F.col(start), F.col(end), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("__bucket"))
    placed = points.select(F.col(key), F.col(row), F.col(point), F.floor(F.col(point) / width).alias("__bucket"))
    inside = placed.join(spread.hint("merge"), [key, "__bucket"]).where(F.col(point).between(F.col(start), F.col(end)))
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("size"), F.col(interval).alias("id")))
    return inside.groupBy(row).agg(best.alias("m")).select(row, F.col("m.id").alias(interval))


def first_containing(points: DataFrame, intervals: DataFrame, key: str, condition: Column, row: list[str], order: list[str]) -> DataFrame:
    """For each point (``row``) the first interval of its key, by ``order``, that meets the condition."""
    found = points.join(intervals, key).where(condition)
    return found.groupBy(*row).agg(F.min(F.struct(*order)).alias("m")).select(*row, *(F.col(f"m.{c}").alias(c) for c in order))
