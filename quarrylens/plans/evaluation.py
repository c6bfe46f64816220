"""Evaluation of verdicts: cases, splits, runs over variants and repeats, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import sidecars

CASE = "schema string, slug string, category string, detector string, gap_type string, language string, evidence_policy string"
EXPECTED = "schema string, slug string, verdict string, gray boolean, accepted boolean"


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Accepted cases with what is expected of them; folders named _holding are passed over, another schema tag raises ValueError."""
    cases = sidecars(spark, f"{root}/*/case_*/case.json", CASE, "slug")
    expected = sidecars(spark, f"{root}/*/case_*/expected.json", EXPECTED, "slug")
    strange = cases.where(~F.coalesce(F.startswith("schema", F.lit("corpus-case/1")), F.lit(False))).head()
    if strange:
        raise ValueError(f"case {strange.slug} has the schema {strange.schema}")
    return cases.join(expected.where("accepted").select("slug", F.col("verdict").alias("expected"), F.coalesce("gray", F.lit(False)).alias("gray")), "slug")


def select_cases(sources: list[DataFrame], only: list[str] | None = None, with_gray: bool = True) -> DataFrame:
    """Cases of several sources as one table, by name and without gray ones if asked for."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if only:
        out = out.where(F.col("slug").isin(only))
    return out if with_gray else out.where(~F.col("gray"))


def runs(cases: DataFrame, variants: list[str], repeats: int, verdicts: DataFrame) -> DataFrame:
    """A record for each case, variant and repeat; verdicts (slug, variant, repeat, verdict, confidence); correct is null where undecided."""
    plan = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(k).alias("repeat")) for v in variants for k in range(repeats))))
    planned = cases.select("*", plan.alias("p")).select("*", "p.variant", "p.repeat").drop("p")
    joined = planned.join(verdicts, ["slug", "variant", "repeat"], "left")
    return joined.withColumn("correct", F.when(F.col("verdict").isNotNull(), F.col("verdict") == F.col("expected")))


def split_coverage(cases: DataFrame, splits: DataFrame) -> DataFrame:
    """(slug, problem): cases without a split, and splits (slug, split) of cases that are gone."""
    missing = cases.join(splits, "slug", "left_anti").select("slug", F.lit("no split").alias("problem"))
    return missing.union(splits.join(cases, "slug", "left_anti").select("slug", F.lit("no case").alias("problem")))


def gate(cases: DataFrame, splits: DataFrame, required: int) -> DataFrame:
    """One row: cases, problems of their splits, passed."""
    counted = cases.agg(F.count("*").alias("cases"))
    return counted.join(F.broadcast(split_coverage(cases, splits).agg(F.count("*").alias("problems")))).withColumn("passed", (F.col("cases") >= required) & (F.col("problems") == 0))  # one row each


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old, new, kind): verdicts of two runs (id, verdict, severity); newly informational ones are told apart."""
    a = old.select("id", F.col("verdict").alias("old"))
    b = new.select("id", F.col("verdict").alias("new"), F.col("severity").alias("now"))
    kind = F.when(F.col("old").eqNullSafe(F.col("new")), "same").when((F.col("old") == "dismissed") & (F.col("new") == "confirmed") & (F.col("now") == "info"), "confirmed_as_info").otherwise("changed")
    return a.join(b, "id", "full").select("id", "old", "new", kind.alias("kind"))


def fill_matrix(claims: DataFrame) -> DataFrame:
    """category, claims, insufficient rate, and for each kind of evidence how many claims have it."""
    sizes = claims.groupBy("category").agg(F.count("*").alias("claims"), F.avg(F.col("insufficient").cast("double")).alias("insufficient_rate"))
    kinds = claims.select("category", F.explode("evidence_kinds").alias("kind")).groupBy("category", "kind").agg(F.count("*").alias("filled"))
    return sizes.join(kinds, "category", "left")


def agreement(entries: DataFrame) -> DataFrame:
    """category, n, rate: how often two columns of verdicts (expected, verdict) agree."""
    return entries.groupBy("category").agg(F.count("*").alias("n"), F.avg(F.col("expected").eqNullSafe(F.col("verdict")).cast("double")).alias("rate"))
