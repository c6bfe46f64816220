"""Joins to the nearest match: the last one before a point, the deepest folder above a path, the longest alias before a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: int, values: list[str]) -> DataFrame:
    """All rows of ``left`` with the ``values`` of the last row of ``right`` at or before ``at``, not more than ``tolerance`` earlier; nulls if there is none.

    Both sides are dealt out by key and stretch of ``tolerance`` points, a right row to its stretch and the next one, and
    one pass over each stretch in order finds the matches, so a key of very many rows is split and no pairs are made.
    Of right rows at one point the one with the greatest values counts. A null key or point matches nothing.
    """
    stretch = max(tolerance, 1)
    number = F.floor(F.col(at) / stretch)
    given = F.struct(F.col(at).alias("at"), F.struct(*values).alias("v"))
    rows = left.select(F.struct(*left.columns).alias("__row"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(at).alias("__at"), number.alias("__b"))
    able = F.col("__at").isNotNull()
    for i in range(len(keys)):
        able &= F.col(f"__k{i}").isNotNull()
    facts = right.select(given.alias("__found"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(at).alias("__at"), F.explode(F.array(number, number + 1)).alias("__b"))
    both = facts.where(able).unionByName(rows.where(able), allowMissingColumns=True)
    order = Window.partitionBy("__b", *(f"__k{i}" for i in range(len(keys)))).orderBy("__at", F.col("__row").isNotNull(), "__found")
    last = F.last("__found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("__last", last).where(F.col("__row").isNotNull())
    out = met.unionByName(rows.where(~F.coalesce(able, F.lit(False))), allowMissingColumns=True)
    near = F.col("__at") - F.col("__last.at") <= tolerance
    return out.select("__row.*", *(F.when(near, F.col(f"__last.v.{v}")).alias(v) for v in values))


def folders_above(path: Column) -> Column:
    """The folders above a path, the nearest first, down to the top, which is the empty text."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def nearest_ancestor(paths: DataFrame, path: str, homes: DataFrame, home: str) -> DataFrame:
    """(path, home): the deepest of the homes (folders) above each path; paths that have none are left out."""
    above = paths.select(path).distinct().select(path, F.posexplode(folders_above(F.col(path))).alias("__up", home))
    return above.join(homes.select(home).distinct(), home).groupBy(path).agg(F.min_by(home, "__up").alias(home))


def expanded(names: DataFrame, aliases: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name, target): what names mean by the aliases of their scope; names that no alias fits are left out.

    Aliases have (scope, pattern, target); a pattern without a star is a whole name, one with a star stands for what starts
    and ends as it does, and the target's star takes what is between. A whole name goes first, then the longest
    start, then the least pattern. Names meet aliases by their starts, so the join is by equal keys.
    """
    star = F.instr("pattern", "*")
    starred = aliases.where(star > 0).select(scope, "pattern", "target", F.substring("pattern", F.lit(1), star - 1).alias("__start"), F.expr("substring(pattern, instr(pattern, '*') + 1)").alias("__rest"))
    asked = names.select(scope, name).distinct()
    starts = asked.select(scope, name, F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda k: F.substring(F.col(name), F.lit(1), k))).alias("__start"))
    fits = starts.join(starred, [scope, "__start"]).where(F.endswith(name, F.col("__rest")) & (F.length(name) >= F.length("__start") + F.length("__rest")))
    between = F.substring(F.col(name), F.length("__start") + 1, F.length(name) - F.length("__start") - F.length("__rest"))
    at = F.instr("target", "*")
    filled = F.when(at > 0, F.concat(F.substring("target", F.lit(1), at - 1), between, F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.col("target"))
    wild = fits.select(scope, name, filled.alias("target"), (-F.length("__start")).alias("__rank"), "pattern")
    whole = asked.join(aliases.where(star == 0).withColumnRenamed("pattern", name), [scope, name]).select(scope, name, "target", F.lit(None).cast("int").alias("__rank"), F.col(name).alias("pattern"))
    return wild.unionByName(whole).groupBy(scope, name).agg(F.min_by("target", F.struct("__rank", "pattern", "target")).alias("target"))
