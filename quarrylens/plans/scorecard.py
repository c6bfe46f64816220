"""Scorecards: coverage, junk, health, and the tree of a repository's bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, intervals


def coverage(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: sources, covered, pct (0.0 without sources); docs has (path, classification, matched: array of paths)."""
    matched = docs.select(F.explode("matched").alias("path")).distinct().withColumn("__hit", F.lit(1))
    counted = sources.select("path").join(matched, "path", "left").agg(F.count("*").alias("sources"), F.count("__hit").alias("covered"))
    return counted.withColumn("pct", F.when(F.col("sources") == 0, 0.0).otherwise(F.col("covered") * 100.0 / F.col("sources")))


def coverage_by_type(docs: DataFrame) -> DataFrame:
    """(classification, docs, pct): the share of documents that match any source."""
    return docs.groupBy("classification").agg(F.count("*").alias("docs"), (F.count_if(F.size("matched") > 0) * 100.0 / F.count("*")).alias("pct"))


def accuracy(docs: DataFrame) -> DataFrame:
    """One row: errors in live documents, and errors for each live document; process artifacts are dead documents."""
    live = F.col("classification") != "process_artifact"
    errors = F.size(F.filter("findings", lambda f: f["severity"] == "error"))
    return docs.where(live).agg(F.sum(errors).alias("errors"), F.count("*").alias("docs")).withColumn("per_doc", F.col("errors") / F.nullif("docs", F.lit(0)))


def junk(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(category, junk_lines, total_lines, fraction): lines under findings, merged per file, for all (category null) and per category; categories may share lines."""
    spans = findings.where("line_start IS NOT NULL").select("path", "category", F.col("line_start").cast("long").alias("s"), F.coalesce("line_end", "line_start").cast("long").alias("e")).where("e >= s")
    total = files.agg(F.sum(T.universal_line_count(F.col("text"))).alias("total_lines"))
    whole = intervals.covered(spans, ["path"], "s", "e").agg(F.sum("covered").alias("junk_lines")).withColumn("category", F.lit(None).cast("string"))
    parts = intervals.covered(spans, ["path", "category"], "s", "e").groupBy("category").agg(F.sum("covered").alias("junk_lines"))
    rows = whole.unionByName(parts).join(F.broadcast(total))  # one row
    return rows.select("category", F.coalesce("junk_lines", F.lit(0)).alias("junk_lines"), "total_lines", (F.coalesce("junk_lines", F.lit(0)) / F.nullif("total_lines", F.lit(0))).alias("fraction"))


def file_nodes(files: DataFrame, shadows: DataFrame, findings: DataFrame, symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """A row for each file: lines, errors, warnings, junk fraction, public symbols, tokens, health (null without shadow and findings)."""
    n_lines = T.universal_line_count(F.col("text"))
    base = files.where(~F.col("is_binary")).select("path", "parent", "depth", "source_hash", n_lines.alias("lines"))
    counted = findings.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    spans = findings.where("line_start IS NOT NULL AND coalesce(line_end, line_start) >= line_start").select("path", F.col("line_start").cast("long").alias("s"), F.coalesce("line_end", "line_start").cast("long").alias("e"))
    rows = base.join(shadows.select("path", F.lit(True).alias("shadow")), "path", "left").join(counted, "path", "left").join(intervals.covered(spans, ["path"], "s", "e"), "path", "left")
    rows = rows.join(symbols.groupBy("path").agg(F.count_if(~F.startswith("name", F.lit("_"))).alias("public")), "path", "left").join(tokens.select("path", "source_tokens", "shadow_tokens"), "path", "left")
    rows = rows.fillna(0, ["errors", "warnings", "covered", "public"]).withColumn("junk", F.least(F.col("covered") / F.nullif("lines", F.lit(0)), F.lit(1.0)))
    known = F.coalesce("shadow", F.lit(False)) | (F.col("errors") + F.col("warnings") > 0)
    return rows.withColumn("health", F.when(known, audit.file_health(F.col("errors"), F.col("warnings"), F.coalesce("junk", F.lit(0.0))))).drop("covered")


def folder_nodes(nodes: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, files, lines, health): totals of all files below each folder; health weighted by lines."""
    parts = F.split("parent", "/")
    above = F.when(F.col("parent") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    summed = nodes.select(F.explode(above).alias("folder"), "lines", "health").groupBy("folder").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), audit.weighted_mean(F.col("health"), F.col("lines")).alias("health"))
    return folders.select(F.col("path").alias("folder")).join(summed, "folder", "left").withColumnRenamed("folder", "path")


def folder_hashes(files: DataFrame) -> DataFrame:
    """(path, digest) of every folder: a hash of its children's names and hashes, one job for each depth, the deepest first."""
    deepest = files.agg(F.max("depth")).head()[0] or 0
    nodes = files.select("path", "parent", F.col("depth"), F.col("source_hash").alias("digest"))
    out = None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth).select("parent", F.element_at(F.split("path", "/"), -1).alias("name"), "digest")
        folders = audit.rollup_hash(level, "parent", "name", "digest").withColumnRenamed("parent", "path")
        own = F.split("path", "/")
        placed = folders.withColumns({"parent": F.array_join(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), "/"), "depth": F.when(F.col("path") == "", 0).otherwise(F.size(own))})
        nodes = nodes.unionByName(placed.select("path", "parent", "depth", "digest"))
        out = folders if out is None else out.unionByName(folders)
    return out


def token_totals(tokens: DataFrame) -> DataFrame:
    """One row: totals, compression (null of nothing) and savings in percent; tokens has (path, source_tokens, shadow_tokens)."""
    summed = tokens.agg(F.sum("source_tokens").alias("source_tokens"), F.sum("shadow_tokens").alias("shadow_tokens"))
    ratio = F.col("shadow_tokens") / F.nullif("source_tokens", F.lit(0))
    return summed.withColumns({"compression": F.round(1 - ratio, 4), "savings": (1 - ratio) * 100})
