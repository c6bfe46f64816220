"""Merging of facts and findings from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_literals(parsed: DataFrame, judged: DataFrame) -> DataFrame:
    """Parsed string literals (path, value, line, ord, ...) with usage and kind from judged ones: the last of the same value and line, else the first of the value; judged values that were not parsed follow."""
    exact = judged.groupBy("path", "value", "line").agg(F.max_by(F.struct("usage", "kind"), "ord").alias("__e"))
    loose = judged.groupBy("path", "value").agg(F.min_by(F.struct("usage", "kind"), "ord").alias("__l"))
    rows = parsed.join(exact, ["path", "value", "line"], "left").join(loose, ["path", "value"], "left")
    pick = lambda f: F.coalesce(F.col(f"__e.{f}"), F.col(f"__l.{f}"), F.col(f) if f in parsed.columns else F.lit(None)).alias(f)
    known = rows.select("path", "value", "line", "ord", pick("usage"), pick("kind"))
    return known.unionByName(judged.join(parsed, ["path", "value"], "left_anti").select("path", "value", "line", "ord", "usage", "kind"))


def cooccurrence_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst), both ways: files that mention another file's symbol as a word."""
    words = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("name"))
    hits = words.join(symbols.select(F.col("path").alias("dst"), "name").distinct(), "name").where(F.col("src") != F.col("dst")).select("src", "dst")
    return hits.union(hits.select("dst", "src")).distinct()


def with_bare_names(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, file, line): references (name, file, line) of symbols by their qualified or bare name, once a line."""
    bare = symbols.select("name", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("used"))
    return bare.join(references.withColumnRenamed("name", "used"), "used").select("name", "file", "line").distinct()


def grouped_contracts(findings: DataFrame) -> DataFrame:
    """(producer, consumer, values, n, confidence): findings of a pair as one; confidence grows with their number, and that of a single one stays."""
    n = F.count("*")
    return findings.groupBy("producer", "consumer").agg(F.array_sort(F.collect_set("value")).alias("values"), n.alias("n"), F.when(n == 1, F.max("confidence")).otherwise(F.least(F.lit(0.9), 0.5 + 0.1 * n)).alias("confidence"))


def common_folder(a: Column, b: Column) -> Column:
    """The folders that two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), F.array().cast("array<string>"), lambda acc, k: F.when(F.slice(x, F.lit(1), k) == F.slice(y, F.lit(1), k), F.slice(x, F.lit(1), k)).otherwise(acc)), "/")


def clean_zero(references: Column, scanned: Column, truncated: Column) -> Column:
    """Absence of references is evidence only where something was looked through, and all of it."""
    return (references == 0) & (scanned > 0) & ~truncated


def inside_quotes(line: Column, position: Column) -> Column:
    """Whether a place (from 0) of a line is inside a string, by the quotes before it; escaped ones don't count."""
    start = F.struct(F.lit("").alias("quote"), F.lit(False).alias("escaped"))

    def step(state: Column, c: Column) -> Column:
        opening = (state["quote"] == "") & c.isin("'", '"')
        closing = (state["quote"] != "") & (c == state["quote"])
        after = F.when(opening, c).when(closing, F.lit("")).otherwise(state["quote"])
        return F.struct(F.when(state["escaped"], state["quote"]).otherwise(after).alias("quote"), (~state["escaped"] & (c == "\\")).alias("escaped"))

    signs = F.filter(F.split(F.substring(line, F.lit(1), position), ""), lambda c: c != "")
    return F.aggregate(signs, start, step, lambda s: s["quote"] != "")


def types_of(names: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """(name, path, snippet): the first definition of each type name, cut to ``most`` lines."""
    types = symbols.where(F.col("kind").isin("class", "type", "interface", "enum"))
    first = names.select("name").distinct().join(types, "name").groupBy("name").agg(F.min(F.struct("path", "line_start", "line_end")).alias("m")).select("name", "m.*")
    size = F.least(F.coalesce("line_end", "line_start") - F.col("line_start") + 1, F.lit(most))
    return first.join(files.select("path", "text"), "path").select("name", "path", F.array_join(F.slice(F.split("text", "\n", -1), F.col("line_start"), size), "\n").alias("snippet"))


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], running: str, limit: int) -> DataFrame:
    """Rows in order until the running sum of a column passes a limit; all after the first that passes it are left out."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__sum", F.sum(running).over(window)).where(F.col("__sum") <= limit).drop("__sum")


def checkable(path: Column) -> Column:
    """Files worth checking for leaks: environment files wherever they are, no vendored folders, no media or archives."""
    name = F.element_at(F.split(path, "/"), -1)
    vendored = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv"))))
    media = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".woff", ".woff2", ".ttf", ".mp4", ".so", ".dll", ".pyc")
    return F.when(F.startswith(name, F.lit(".env")), True).when(vendored | media, False).otherwise(True)
