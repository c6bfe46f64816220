"""Counters and small reports over findings, verdicts, facts and phases; each is one aggregate or projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_array
from ..operators import documents
from ..operators.relations import containing

#: Lines that mark a stale document, by reason; extensions with a language of another name; gap types that a verdict may assign.
WARNINGS = {"stale": "> **Stale**: the source has changed since this was written.", "stale-impl": "> **Stale**: this was written by another version of the engine."}
LANGUAGES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".md": "markdown"}
SPLITS = ("description", "contract", "uncategorized")


def comparison_root(expression: Column) -> Column:
    """The first identifier of an expression; empty for none."""
    return F.coalesce(F.trim(F.regexp_extract(expression, r"^[^.\[(]*", 0)), F.lit(""))


def external_origin(checked: DataFrame, resolved: DataFrame, runtime: list[str]) -> DataFrame:
    """Adds external to rows (path, root): the root is a global of the runtime, or a name, the last part or all of an import that no file of the repository answers to."""
    outside = resolved.where(F.col("target").isNull() & ~F.startswith("source", F.lit(".")))
    names = outside.select("path", F.explode(F.array_union("names", F.array(F.element_at(F.split("source", r"\."), -1)))).alias("root")).distinct()
    whole = names.where("root = '*'").select("path").withColumn("__all", F.lit(True))
    rows = checked.join(names.withColumn("__one", F.lit(True)), ["path", "root"], "left").join(whole, "path", "left")
    known = F.col("root").isin(runtime) | F.coalesce("__one", F.lit(False)) | F.coalesce("__all", F.lit(False))
    return rows.withColumn("external", (F.col("root") != "") & known).drop("__one", "__all")


def noise(text: Column, root: Column, source: Column, paths: tuple[list[str], list[str]], keys: tuple[list[str], list[str]], protocol: list[str]) -> Column:
    """Whether a checked string is a path, a key of serialized data, a word of a protocol, or a look-up, by hints in its lower-cased context and the roots that go with them."""

    def hinted(hints: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(text), h)) if hints else F.lit(False)

    looked_up = F.coalesce(F.contains(source, F.lit("getattr(")) | F.contains(source, F.lit(".get(")), F.lit(False))
    return root.isin(paths[0]) | hinted(paths[1]) | (root.isin(keys[0]) & hinted(keys[1])) | hinted(protocol) | looked_up


def split_gap(gap: Column, assigned: Column) -> Column:
    """A verdict may only split what has no gap type yet."""
    return F.when((gap == "uncategorized") & assigned.isin(*SPLITS), assigned).otherwise(gap)


def category_of(detector: Column) -> Column:
    """What stands after the colon, documents' kinds with their prefix; without one the producer."""
    producer, suffix = F.substring_index(detector, ":", 1), F.regexp_extract(detector, r"^[^:]*:(.*)$", 1)
    return F.when(F.coalesce(producer, F.lit("")) == "", "uncategorized").when((producer == "doc") & (suffix != ""), F.concat(F.lit("doc_"), suffix)).when(suffix != "", suffix).otherwise(producer)


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)(\.[^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(known, ext), F.when(ext == "", "unknown").otherwise(F.substring(ext, 2, 100)))


def search_hits(outputs: DataFrame) -> DataFrame:
    """(slug, path, lines: sorted) of search outputs (slug, output) with rows ``path:line: text``."""
    kept = outputs.where(~F.col("output").rlike(r"^(?:Error:|No matches)"))
    rows = kept.select("slug", F.explode(line_array(F.col("output"))).alias("row")).where(F.col("row").rlike(r"^[^:]+:\d+:"))
    return rows.select("slug", F.regexp_extract("row", r"^([^:]+):(\d+):", 1).alias("path"), F.regexp_extract("row", r"^([^:]+):(\d+):", 2).cast("int").alias("line")).groupBy("slug", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"))


# ---- snapshots and documents


def outside_snapshots(files: DataFrame, cases: DataFrame) -> DataFrame:
    """The files that are in no folder with a case of the corpus; cases: (folder, schema)."""
    roots = cases.where(F.startswith("schema", F.lit("corpus-case/"))).select(F.col("folder").alias("__above")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inside = files.where(F.size(parts) > 1).select("path", F.explode(above).alias("__above")).join(roots, "__above", "left_semi")
    return files.join(inside.select("path"), "path", "left_anti")


def source_names(sources: DataFrame) -> DataFrame:
    """(path, k, name): the path, the file name and the dotted module by which text may name a source, in this order, of four signs or more."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^src/", ""), r"\.py$", ""), "/__init__$", "")
    forms = F.array("path", F.element_at(F.split("path", "/"), -1), F.when(F.endswith("path", F.lit(".py")) & F.contains(module, F.lit("/")), F.translate(module, "/", ".")))
    return sources.select("path", F.posexplode(F.array_distinct(F.array_compact(forms))).alias("k", "name")).where(F.length("name") >= 4)


def document_names(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc, path, k, name): the names by which documents (doc, text) name sources."""
    keys = source_names(sources)
    distinct = keys.select("name").distinct()
    return containing(docs, "doc", distinct.select("name", F.col("name").alias("text")), "name").join(keys, "name").select("doc", "path", "k", "name")


def document_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc, path): documents (doc, text) that name a source by path, file name or dotted module, of four signs or more."""
    return document_names(docs, sources).select("doc", "path").distinct()


def without_warnings(text: Column) -> Column:
    return F.array_join(F.filter(line_array(text), lambda x: ~x.isin(*WARNINGS.values())), "\n")


def _header(lines: Column) -> Column:
    """How many lines stand before the body: those to the first empty one after the first."""
    blank = F.array_position(F.slice(lines, F.lit(2), F.size(lines)), "")
    return F.when(blank > 0, blank.cast("int") + 1).otherwise(0)


def body(text: Column) -> Column:
    """A document without its header and warnings."""
    lines = line_array(text)
    return without_warnings(F.array_join(F.slice(lines, _header(lines) + 1, F.size(lines)), "\n"))


def with_warning(text: Column, reason: Column) -> Column:
    """The document with the reason's warning before its body, after warnings that are there; unchanged if it has it, or for another reason."""
    lines = line_array(text)
    line = F.when(reason == "stale", WARNINGS["stale"]).when(reason == "stale-impl", WARNINGS["stale-impl"])
    at = _header(lines)
    other = F.coalesce(F.get(lines, at).isin(*WARNINGS.values()), F.lit(False)).cast("int")  # there are two kinds, and this one lacks
    put = F.concat(F.slice(lines, F.lit(1), at + other), F.array(line), F.slice(lines, at + other + 1, F.size(lines)))
    return F.when(line.isNull() | F.array_contains(lines, line), text).otherwise(F.array_join(put, "\n"))


# ---- counters


def enforcement(findings: DataFrame) -> DataFrame:
    """(key, unactuated, fields: sorted) by path and schema; findings: (path, schema_name, name)."""
    key = F.when(F.coalesce("schema_name", F.lit("")) != "", F.concat_ws(":", "path", "schema_name")).otherwise(F.col("path"))
    return findings.groupBy(key.alias("key")).agg(F.count("*").alias("unactuated"), F.array_sort(F.collect_list("name")).alias("fields"))


def enforcement_share(findings: DataFrame, candidates: int | None) -> DataFrame:
    """One row: total, unactuated, pct; all null if the phase did not run, 0.0 of nothing."""
    if candidates is None:
        return findings.sparkSession.createDataFrame([(None, None, None)], "total long, unactuated long, pct double")
    share = F.col("unactuated") * 100.0 / F.lit(candidates) if candidates else F.lit(0.0)
    return findings.agg(F.lit(candidates).cast("long").alias("total"), F.count("*").alias("unactuated")).withColumn("pct", share)


def undecided(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, claims, undecided."""
    return claims.groupBy(*by).agg(F.count("*").alias("claims"), F.count_if(F.col("verdict").isNull()).alias("undecided"))


def degraded(phases: DataFrame) -> DataFrame:
    """One row: the phases that failed, sorted; null for none. phases: (phase, failed)."""
    names = F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("phase"))))
    return phases.agg(F.nullif(F.array_join(names, ","), F.lit("")).alias("phases"))


def merged_checks(parts: DataFrame) -> DataFrame:
    """(path, checked, findings): results of several checks added up; parts: (path, checked, findings: array)."""
    return parts.groupBy("path").agg(F.sum("checked").alias("checked"), F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))


def vocabulary(symbols: DataFrame) -> DataFrame:
    """(name): distinct names, and the bare names of dotted ones."""
    return symbols.select(F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("name")).distinct()


def file_summary(table_of: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """A row for each file with the number of rows that each relation (path, ...) has of it, zeros included."""
    out = files.select("path")
    for name, df in table_of.items():
        out = out.join(df.groupBy("path").agg(F.count("*").alias(name)), "path", "left")
    return out.fillna(0, list(table_of))


def cached_tokens(files: DataFrame, cache: DataFrame, counter: str) -> DataFrame:
    """Files (path, source_hash, estimate) with tokens: the cache's (path, counter, source_hash, tokens) of this counter for unchanged files, else the estimate, and hit."""
    known = cache.where(F.col("counter") == counter).select("path", "source_hash", F.col("tokens").alias("__t"))
    rows = files.join(known, ["path", "source_hash"], "left")
    return rows.select(*files.columns, F.coalesce("__t", "estimate").alias("tokens"), F.col("__t").isNotNull().alias("hit"))


def triage_delta(claims: DataFrame) -> DataFrame:
    """One row: claims, and of them those eligible and escalated under the old and the new rule; claims: (old, new, escalated)."""
    return claims.agg(F.count("*").alias("claims"), *(F.count_if(c).alias(f"{c}_eligible") for c in ("old", "new")), *(F.count_if(F.col(c) & F.col("escalated")).alias(f"{c}_escalated") for c in ("old", "new")))


def capped(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, bool]:
    """A report's first rows, and whether there are more."""
    rows = df.orderBy(*order).limit(most + 1)
    return rows.limit(most), rows.count() > most


def estimate(files: DataFrame, per_token: float = 3.3, shadow: float = 0.2, output: float = 0.3, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """One row: what a run over files (bytes) would take, in tokens and dollars by million tokens."""
    summed = files.agg(F.count("*").alias("files"), F.floor(F.sum("bytes") / per_token).alias("source_tokens"))
    tokens = F.col("source_tokens")
    rows = summed.withColumns({"input_tokens": F.floor(tokens * (1 + shadow)), "output_tokens": F.floor(tokens * output)})
    return rows.withColumn("dollars", F.round((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 6))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """(parent, children): the names below each folder, folders first, then by name; nodes: (path, parent, is_dir)."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = F.array_sort(F.collect_list(F.struct((~F.col("is_dir")).alias("file"), name.alias("name"))))
    return nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.transform(listed, lambda x: x["name"]).alias("children"))


def positional(decided: DataFrame, originals: DataFrame, order: str = "ord") -> DataFrame:
    """Verdicts beside the rows they were asked for, by an explicit order column; rows without one stay."""
    return originals.join(decided, order, "left")


def cross_check(mined: DataFrame, entries: DataFrame) -> DataFrame:
    """(slug, phrase): phrases that a case was said to need (slug, phrases, kinds) and that none of its mined kinds (slug, kind) answers to."""
    own = mined.groupBy("slug").agg(F.collect_set("kind").alias("__mined"))
    rows = entries.join(own, "slug", "left").withColumn("__mined", F.coalesce("__mined", F.array().cast("array<string>")))
    return rows.where(~F.arrays_overlap("kinds", "__mined")).select("slug", F.explode("phrases").alias("phrase"))


def ledger_entry(ledger: DataFrame, finding_id: str, near: int = 20) -> DataFrame:
    """The entry of an id; ValueError names some ids that there are, if it isn't one."""
    found = ledger.where(F.col("id") == finding_id)
    if found.isEmpty():
        names = [r.id for r in ledger.select("id").orderBy(F.levenshtein("id", F.lit(finding_id)), "id").limit(near).collect()]
        raise ValueError(f"no finding {finding_id}; near it: {', '.join(names)}")
    return found


def string_leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, leaf): every string in JSON documents, however deep: the strings that are no object's keys."""
    return documents.json_leaves(df, [key], document).where("kind = 'string'").select(key, F.col("value").alias("leaf"))


def issues(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of ``issues`` of a JSON document."""
    rows = spark.read.schema(f"issues array<struct<{schema}>>").option("multiLine", "true").json(path)
    return rows.select(F.explode("issues").alias("i")).select("i.*")


def write_by_analyzer(findings: DataFrame, path: str) -> None:
    """Findings in a folder for each analyzer."""
    findings.write.mode("overwrite").partitionBy("analyzer").parquet(path)
