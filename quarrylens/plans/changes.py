"""What a change of the repository touches: documentation gone stale, marks of it, documents that name changed sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines
from ..sources.storage import stored
from . import detectors, reports
from . import facts as fx

#: Kinds of changes by the first letter of their status; another letter is a modification.
STATUS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}


def classified(changes: DataFrame, is_source: Column, is_doc: Column) -> DataFrame:
    """(path, ord, change_type, is_source, is_doc) of changes (path, status, ord); conditions are on path."""
    kinds = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    kind = F.coalesce(F.element_at(kinds, F.substring("status", 1, 1)), F.lit("modified"))
    return changes.select("path", "ord", kind.alias("change_type"), is_source.alias("is_source"), is_doc.alias("is_doc"))


def stale_shadows(changed: DataFrame, files: DataFrame, shadows: DataFrame, impl_hash: str) -> DataFrame:
    """(path, shadow_exists, status) of changed sources whose shadow is stale or missing, and of deleted ones; what is neither deleted nor there has none."""
    there = shadows.select("path", F.lit(True).alias("__shadow")).distinct()
    states = detectors.stale(files.join(changed.select("path").distinct(), "path", "left_semi"), shadows, impl_hash)
    rows = changed.select("path", "change_type").join(there, "path", "left").join(states, "path", "left")
    status = F.when(F.col("change_type") == "deleted", "deleted_source").when(F.col("reason") == "missing", "missing").when(F.col("reason").isNotNull(), "stale")
    return rows.select("path", F.coalesce("__shadow", F.lit(False)).alias("shadow_exists"), status.alias("status")).where("status IS NOT NULL")


REFERENCE = ["doc", "path", "line_no", "line", "source_deleted"]


def references_by_facts(changed: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(REFERENCE): documents whose facts name a changed source, with the first line that has its file name; line 0 where none has. Documents that are gone have none."""
    name = F.element_at(F.split("path", "/"), -1)
    pairs = changed.select("path", "change_type").join(fx.docs_referencing(facts), "path").select("path", "change_type", "doc", name.alias("name"))
    # a document's text meets its sources in one row each; only the first line that fits is kept of it
    rows = pairs.join(docs.select(F.col("path").alias("doc"), T.universal_lines(F.col("text")).alias("ls")), "doc")
    at = F.coalesce(F.array_position(F.transform("ls", lambda x: F.contains(x, F.col("name"))), True), F.lit(0)).cast("long")
    line = F.when(at > 0, F.trim(F.get("ls", (at - 1).cast("int")))).otherwise("(reference found in facts)")
    return rows.select("doc", "path", at.alias("line_no"), line.alias("line"), (F.col("change_type") == "deleted").alias("source_deleted"))


def references_by_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """(REFERENCE): lines of documents that name a changed source by path or file name, each line for the first one in order."""
    found = detectors.docs_for_changes(docs, changed).join(changed.select("path", (F.col("change_type") == "deleted").alias("source_deleted")), "path")
    text = lines.explode_lines(docs.join(found.select(F.col("doc").alias("path")).distinct(), "path", "left_semi"), ["path"]).withColumnRenamed("path", "doc")
    return found.join(text, ["doc", "line_no"]).select("doc", "path", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line"), "source_deleted")


@dataclass
class Impact:
    """A change and what it leaves behind."""

    sources: DataFrame
    docs: DataFrame
    stale: DataFrame
    references: DataFrame

    def issues(self) -> DataFrame:
        """One row: stale shadows, references, those to deleted sources, and whether there is any of them."""
        stale = self.stale.agg(F.count("*").alias("stale"))
        named = self.references.agg(F.count("*").alias("n_references"), F.count_if("source_deleted").alias("deleted"))
        return stale.join(F.broadcast(named)).withColumn("has_issues", F.col("stale") + F.col("n_references") > 0)  # one row each


def impact(changed: DataFrame, files: DataFrame, shadows: DataFrame, docs: DataFrame, facts: DataFrame, impl_hash: str) -> Impact:
    """The impact of classified changes; documents are looked up in the facts if those have any, else in their texts."""
    sources = changed.where("is_source")
    by_facts = "classification" in facts.columns and not facts.where("classification IS NOT NULL").isEmpty()
    named = references_by_facts(sources, facts, docs) if by_facts else references_by_text(sources, docs)
    return Impact(sources, changed.where("is_doc"), stale_shadows(sources, files, shadows, impl_hash), named)


def marked(shadows: DataFrame, stale: DataFrame) -> DataFrame:
    """(path, text, reason, added) of shadows (path, text) that ``stale`` (path, reason) names, with their warnings; missing ones have no text to mark."""
    rows = shadows.select("path", F.coalesce("text", F.lit("")).alias("old")).join(stale.where("reason <> 'missing'"), "path")
    return rows.select("path", reports.with_warning(F.col("old"), F.col("reason")).alias("text"), "reason", "old").withColumn("added", (F.col("text") != F.col("old")).cast("int")).drop("old")


def reference_facts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, path, text): sidecars of documents (path, text), which import the sources that they name and say by which name; one of a document without any is empty."""
    # a document's names meet once, and become sentences only where they are gathered
    named = stored(reports.document_names(docs.select(F.col("path").alias("doc"), "text"), sources), "document-names")
    best = named.repartition("doc").groupBy("doc", F.col("path").alias("source")).agg(F.min_by("name", "k").alias("name"))
    none = F.array().cast("array<string>")
    said = lambda x: F.concat(F.lit("doc references "), x["source"], F.lit(" via '"), x["name"], F.lit("'"))
    listed = best.groupBy(F.col("doc").alias("path")).agg(F.array_sort(F.collect_list(F.struct("source", "name"))).alias("named"))
    listed = listed.select("path", F.transform("named", lambda x: F.struct(x["source"].alias("source"), none.alias("names"), said(x).alias("context"))).alias("imports"))
    hashed = docs.select("path", T.hash16(F.coalesce("text", F.lit(""))).alias("source_hash")).join(listed, "path", "left")
    imports = F.coalesce("imports", F.array().cast("array<struct<source:string,names:array<string>,context:string>>"))
    fields = [F.col("path").alias("source"), "source_hash", imports.alias("imports"), *(none.alias(x) for x in ("exports", "calls", "string_literals", "topics")), F.lit("doc").alias("classification")]
    return hashed.select(F.lit("facts").alias("kind"), F.concat("path", F.lit(".facts.json")).alias("path"), F.to_json(F.struct(*fields)).alias("text"))
