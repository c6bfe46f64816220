"""Operators on findings, verdicts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Producers of a value that one row holds, about.
GATHERED = 256


def closure(baseline: DataFrame, current: DataFrame, id_: str, composite: str, order: str, dismissed: str) -> DataFrame:
    """bucket, b, c: rows of two audits paired one to one, first by id, then by the composite of what is left.

    Unpaired baseline rows are closed, unpaired current ones new; a pair is still open, or closed by
    dismissal where the current row is dismissed. b and c are the rows' order columns.
    """

    def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        numbered = [
            df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(order).alias(name), *extra, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("__rn"))
            for df, name, extra in ((left, "b", []), (right, "c", [F.col(dismissed).alias("__dismissed")]))
        ]
        return numbered[0].join(numbered[1], ["__key", "__rn"]).select("b", "c", "__dismissed")

    first = pair(baseline, current, id_)
    left = baseline.join(first.select(F.col("b").alias(order)), order, "left_anti")
    right = current.join(first.select(F.col("c").alias(order)), order, "left_anti")
    second = pair(left, right, composite)
    pairs = first.union(second).select(F.when(F.col("__dismissed"), "closed_by_dismissal").otherwise("still_open").alias("bucket"), "b", "c")
    none = F.lit(None).cast(baseline.schema[order].dataType)
    gone = left.join(second.select(F.col("b").alias(order)), order, "left_anti").select(F.lit("closed").alias("bucket"), F.col(order).alias("b"), none.alias("c"))
    new = right.join(second.select(F.col("c").alias(order)), order, "left_anti").select(F.lit("new").alias("bucket"), none.alias("b"), F.col(order).alias("c"))
    return pairs.union(gone).union(new)


def rate(part: Column, whole: Column) -> Column:
    """A conditional rate; 0.0, not null, of nothing."""
    n = F.count_if(whole)
    return F.when(n == 0, 0.0).otherwise(F.count_if(whole & part) / n)


def eval_metrics(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, tp_rate, fp_rate, accuracy, uncertain_rate, undecided_rate; columns expected, verdict (null: undecided), gray.

    Gray cases count in the last two only.
    """
    clear = ~F.coalesce("gray", F.lit(False))
    decided = clear & F.col("verdict").isNotNull()
    confirmed = F.coalesce(F.col("verdict") == "confirmed", F.lit(False))
    right = F.coalesce(F.col("verdict") == F.col("expected"), F.lit(False))
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("n"),
        rate(confirmed, decided & (F.col("expected") == "confirmed")).alias("tp_rate"),
        rate(confirmed, decided & (F.col("expected") == "dismissed")).alias("fp_rate"),
        rate(right, decided).alias("accuracy"),
        rate(F.coalesce(F.col("verdict") == "uncertain", F.lit(False)), F.lit(True)).alias("uncertain_rate"),
        rate(F.col("verdict").isNull(), F.lit(True)).alias("undecided_rate"),
    )


def resample(rows: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """keys, n, distinct, modal_share, flipped of keys with two rows or more; null is a verdict of its own."""
    counts = rows.groupBy(*keys, verdict).agg(F.count("*").alias("__c"))
    return (
        counts.groupBy(*keys)
        .agg(F.sum("__c").alias("n"), F.count("*").alias("distinct"), (F.max("__c") / F.sum("__c")).alias("modal_share"))
        .where("n >= 2")
        .withColumn("flipped", F.col("distinct") > 1)
    )


def threshold_gate(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """metric, value, problem: metrics (metric, value) outside bounds (metric, low, high), and bounds that make no sense."""
    joined = metrics.join(bounds, "metric")
    problem = F.when(F.col("low") > F.col("high"), "malformed").when(F.col("value") < F.col("low"), "below").when(F.col("value") > F.col("high"), "above")
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("metric", "value", "problem")


def file_health(errors: Column, others: Column, junk: Column) -> Column:
    """0.8 to the power of weighted findings; any junk costs a fifth more than its share."""
    base = F.pow(F.lit(0.8), errors) * F.pow(F.lit(0.95), others)
    return F.when(junk > 0, base * F.greatest(F.lit(0.0), F.lit(0.8) - F.least(junk, F.lit(1.0)))).otherwise(base)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null values and their weights don't count; null of nothing."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(w * value) / F.nullif(F.sum(w), F.lit(0))


def nearest_rank(n: str, share: float, cap: int) -> Column:
    """The nearest-rank percentile of positive counts, capped; 0 of nothing."""
    return F.coalesce(F.least(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {n}) FILTER (WHERE {n} > 0)"), F.lit(cap)), F.lit(0)).cast("long")


def ratio_violations(rows: DataFrame, consumer: str, value: str, produced: DataFrame) -> DataFrame:
    """consumer, checked, matched, unmatched, confidence: consumers whose checked values are partly known.

    ``produced`` has (value, producer); a value counts as known if someone else produces it.
    """
    checked = rows.select(consumer, value).distinct()
    makers = produced.groupBy(value).agg(F.countDistinct("producer").alias("__makers"), F.min("producer").alias("__one"))
    known = checked.join(makers, value, "left").withColumn("__known", F.coalesce((F.col("__makers") > 1) | (F.col("__one") != F.col(consumer)), F.lit(False)))
    counted = known.groupBy(consumer).agg(F.count("*").alias("checked"), F.count_if("__known").alias("matched"))
    return counted.withColumn("unmatched", F.col("checked") - F.col("matched")).where("matched > 0 AND unmatched > 0").withColumn("confidence", F.round(F.col("matched") / F.col("checked"), 2))


def fragile_pairs(produced: DataFrame, checked: DataFrame, robust: DataFrame) -> DataFrame:
    """value, producer, consumer, n: values produced and checked in different places that no common definer links; the producer with the most occurrences stands for all.

    ``robust`` has the linked (producer, consumer) pairs, or those of each value.
    """
    makers = produced.groupBy("value", "producer").agg(F.count("*").alias("n"))
    # each consumer looks through its value's ranked producers, some at a time, so that pairs are not made only to be sorted
    part = F.floor(F.pmod(F.hash("producer"), F.ceil(F.count("*").over(Window.partitionBy("value")) / GATHERED)))
    ranked = makers.withColumn("part", part).groupBy("value", "part").agg(F.sort_array(F.collect_list(F.struct("n", "producer")), asc=False).alias("ranked")).drop("part")
    by = [c for c in ("value", "consumer") if c in robust.columns]
    linked = robust.groupBy(*by).agg(F.collect_set("producer").alias("linked"))
    pairs = checked.select("value", "consumer").distinct().join(linked, by, "left").join(ranked, "value")
    loose = F.filter("ranked", lambda x: (x["producer"] != F.col("consumer")) & F.coalesce(~F.array_contains("linked", x["producer"]), F.lit(True)))
    first = pairs.select("value", "consumer", F.get(loose, 0).alias("m")).where(F.col("m").isNotNull())
    return first.groupBy("value", "consumer").agg(F.max("m").alias("m")).select("value", "consumer", F.col("m.producer").alias("producer"), F.col("m.n").alias("n"))


def clusters_by_set(rows: DataFrame, owner: str, value: str) -> DataFrame:
    """values, anchor, n: owners with the same set of values; values are sorted and joined by commas."""
    sets = rows.groupBy(owner).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("values"))
    return sets.groupBy("values").agg(F.min(owner).alias("anchor"), F.count("*").alias("n"))


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule: every rule that a row breaks (a rule that is null is not broken)."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(*keys, F.explode(broken).alias("rule"))


def rollup_hash(children: DataFrame, parent: str, name: str, digest: str) -> DataFrame:
    """parent, digest: a hash of the sorted ``name:digest`` of a parent's children."""
    own = F.array_sort(F.collect_list(F.concat_ws(":", F.col(name).cast("string"), digest)))
    return children.groupBy(parent).agg(F.substring(F.sha2(F.array_join(own, "\n"), 256), 1, 16).alias(digest))


def priority(terms: list[tuple[Column, int]], high: int, medium: int) -> tuple[Column, Column]:
    """The summed score of the terms that hold, and its label."""
    score = sum((F.when(test, weight).otherwise(0) for test, weight in terms), F.lit(0))
    return score.cast("long"), F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
