"""From candidates to decided findings: identities, evidence, claims, verdicts.

Verdicts come from outside as a table (finding_id, fingerprint, verdict, confidence, severity, ...); a
finding without a row stays undecided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.relations import cache_probe

#: What kind of gap a category is.
GAPS = {"dead_symbol": "dead_code", "dead_parameter": "dead_code", "orphan_file": "dead_code", "dead_dependency": "dead_config", "dead_ci_element": "dead_config", "contract_violation": "broken_contract", "implicit_contract": "implicit_contract", "stale_doc": "stale_doc", "personal_path": "leak"}
COLUMNS = "detector string, category string, path string, line_start int, line_end int, symbol string, message string, severity string"


def quoted(text: Column) -> Column:
    """A JSON string as the usual encoder writes it, non-ASCII kept."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.when(text.isNull(), "null").otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(escaped, "\t", r"\\t"), "\r", r"\\r"), F.lit('"')))


def finding_id(*parts: Column) -> Column:
    """16 hex digits of a canonical JSON array of strings and nulls."""
    return T.hash16(F.concat(F.lit("["), F.array_join(F.array(*map(quoted, parts)), ", "), F.lit("]")))


def findings(candidates: dict[str, DataFrame]) -> DataFrame:
    """One table of findings from each detector's candidates: COLUMNS, gap_type and id."""

    def adapted(category: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        pick = lambda *names, default=None: next((F.col(n).cast("string") for n in names if n in have), F.lit(default).cast("string"))
        line = lambda *names: next((F.col(n).cast("int") for n in names if n in have), F.lit(None).cast("int"))
        symbol = pick("parameter", "name", "package", "value", "hit", "missing")
        return df.select(
            F.lit(f"detector:{category}").alias("detector"),
            F.lit(category).alias("category"),
            T.normal_path(pick("path", "consumer", "manifest")).alias("path"),
            line("line_start", "line_no").alias("line_start"),
            line("line_end", "line_no").alias("line_end"),
            symbol.alias("symbol"),
            F.concat_ws(" ", F.lit(category.replace("_", " ")), symbol).alias("message"),
            pick("severity", default="warning").alias("severity"),
        )

    rows = reduce(DataFrame.unionByName, (adapted(k, df) for k, df in candidates.items()))
    gaps = F.create_map(*(F.lit(x) for pair in GAPS.items() for x in pair))
    return rows.withColumns({"gap_type": F.coalesce(F.element_at(gaps, F.col("category")), F.lit("uncategorized")), "id": finding_id(F.col("detector"), F.col("path"), F.col("symbol"), F.col("category"))})


def fingerprint(evidence: Column) -> Column:
    """A hash of evidence (array of JSON strings) that doesn't depend on its order; null for none."""
    return F.when(F.size(evidence) > 0, T.hash16(F.array_join(F.array_sort(evidence), "\n")))


def claims(found: DataFrame, evidence: dict[str, DataFrame], wanted: dict[str, list[str]], required: dict[str, list[str]]) -> DataFrame:
    """The findings with evidence (array of JSON strings), evidence_kinds, fingerprint and insufficient.

    ``evidence`` has for each kind a table (id, payload); ``wanted`` says which kinds a category gets,
    ``required`` of which kinds it needs at least one.
    """
    parts = [df.select("id", F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("payload"))).alias("doc")) for kind, df in evidence.items()]
    given = reduce(DataFrame.unionByName, parts)
    pairs = [(c, k) for c, kinds in wanted.items() for k in kinds]
    plan = found.sparkSession.createDataFrame(pairs, "category string, kind string")
    kept = given.join(found.select("id", "category").distinct(), "id").join(F.broadcast(plan), ["category", "kind"])  # a few constant pairs
    gathered = kept.groupBy("id").agg(F.array_sort(F.collect_set("doc")).alias("evidence"), F.array_sort(F.collect_set("kind")).alias("evidence_kinds"))
    need = F.create_map(*(x for c, kinds in required.items() for x in (F.lit(c), F.array(*map(F.lit, kinds)))))
    none = F.array().cast("array<string>")
    joined = found.join(gathered, "id", "left").withColumns({"evidence": F.coalesce("evidence", none), "evidence_kinds": F.coalesce("evidence_kinds", none)})
    needed = F.element_at(need, F.col("category"))
    return joined.withColumns({"fingerprint": fingerprint(F.col("evidence")), "insufficient": needed.isNotNull() & (F.size(needed) > 0) & ~F.arrays_overlap(needed, F.col("evidence_kinds"))})


def decided(claimed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The claims with verdict, confidence and a new severity; a verdict counts for the same evidence only, and one that its own reasoning contradicts becomes uncertain."""
    known = verdicts.select(F.col("finding_id").alias("id"), "fingerprint", "verdict", "confidence", F.col("severity").alias("__severity"), "reasoning")
    joined = claimed.join(known, ["id", "fingerprint"], "left")
    checked = F.when(T.last_sentence_contradicts(F.col("verdict"), F.col("reasoning")), "uncertain").otherwise(F.col("verdict"))
    return joined.withColumns({"verdict": checked, "severity": F.coalesce("__severity", "severity")}).drop("__severity")


def overlay(decided_: DataFrame) -> DataFrame:
    """What is reported: dismissed findings go, uncertain ones are warnings."""
    return decided_.where(~F.coalesce(F.col("verdict") == "dismissed", F.lit(False))).withColumn("severity", F.when(F.col("verdict") == "uncertain", "warning").otherwise(F.col("severity")))


def harvest(decided_: DataFrame) -> DataFrame:
    """Verdicts to keep for the next run."""
    return decided_.where(F.col("verdict").isNotNull() & F.col("fingerprint").isNotNull()).select(F.col("id").alias("finding_id"), "detector", "fingerprint", "verdict", "confidence", "severity", "reasoning")


def cached(claimed: DataFrame, state: DataFrame) -> DataFrame:
    """The claims with hit: whether the state has a verdict for the same evidence."""
    return cache_probe(claimed, state.select(F.col("finding_id").alias("id"), "fingerprint"), "id", "fingerprint")


def unified_order(df: DataFrame) -> DataFrame:
    """Errors first, then by place; rows without a place last."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return df.orderBy("path", rank, F.coalesce("line_start", F.lit(10**9)), F.coalesce("line_end", "line_start"), "category", "message")
