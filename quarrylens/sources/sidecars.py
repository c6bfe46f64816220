"""What earlier steps wrote down about files: facts, symbols, roles, signatures, findings, analyses, summaries of folders.

Loaders take sidecars (path, text), paths being below the folder of their kind: `tree` reads a folder with one document in a
file, `packed` what `write` made, many documents in a file. Documents are VARIANT values, so one bad entry costs that entry
alone: entries that are no objects are dropped, a field of another type is null. Texts that are no JSON object and documents
without their key are skipped; of a key's several documents the last by path counts, the greatest text of equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.schema import is_object
from . import folders, python_facts, repository
from .storage import cleaned

SYMBOL = "name string, kind string, line_start int, line_end int"
FINDING = "category string, line_start int, line_end int, severity string, description string, suggestion string"
ERROR = "description string, severity string, evidence string, shadow_ref string, remediation string"
#: Code points of a folder's summary that are shown.
PREVIEW = 500
#: The ends of sidecars' names, by kind.
ENDS = {"facts": ".facts.json", "symbols": ".symbols.json", "signatures": ".signature.json", "findings": ".findings.json", "shadow": ".shadow.md"}


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files below a folder, binary ones left out."""
    return repository.with_text(folders.read_folders(spark, root)).where(~F.col("is_binary")).select("path", "text")


def packed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(path, text) of one kind of what `write` made; other kinds aren't read."""
    return spark.read.schema("path string, text string").json(f"{root.rstrip('/')}/kind={kind}")


# ---- loaders


def loaded(sidecars: DataFrame, key: str) -> DataFrame:
    """(path, doc: VARIANT): one document for each key, with slashes only."""
    doc = F.try_parse_json("text")
    named = sidecars.select(F.col("path").alias("__at"), "text", doc.alias("doc")).where(is_object(F.col("doc")))
    keyed = named.select("__at", "text", "doc", F.translate(F.try_variant_get("doc", f"$.{key}", "string"), "\\", "/").alias("path")).where("path <> ''")
    return keyed.groupBy("path").agg(F.max(F.struct("__at", "text")).alias("m")).select("path", F.col("m.text").alias("text")).select("path", doc.alias("doc"))


def value(field: str, kind: str = "string") -> Column:
    return F.try_variant_get("doc", f"$.{field}", kind)


def entries(field: str, fields: str) -> Column:
    """The objects of an array, as structs with those fields; none of what is no array."""
    wanted = StructType.fromDDL(fields)
    one = lambda x: F.struct(*(F.try_variant_get(x, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in wanted))
    found = F.transform(F.filter(value(field, "array<variant>"), is_object), one)
    return F.coalesce(found, F.array().cast(f"array<{wanted.simpleString()}>"))


def facts(sidecars: DataFrame) -> DataFrame:
    """A row for each source, with the arrays that the plans read, how they were found, and a document's classification and topics."""
    arrays = {f.name: f.dataType.elementType for f in StructType.fromDDL(python_facts.SCHEMA) if f.dataType.typeName() == "array"}
    fields = lambda t: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t)
    return loaded(sidecars, "source").select(
        "path",
        F.coalesce(value("source_hash"), F.lit("")).alias("source_hash"),
        *(entries(name, fields(of)).alias(name) for name, of in arrays.items()),
        value("extraction_method").alias("extraction_method"),
        value("classification").alias("classification"),
        value("topics", "array<string>").alias("topics"),
    )


def symbols(sidecars: DataFrame, is_doc: Column) -> DataFrame:
    """(path, symbols) of code that has some; ``is_doc`` says of a path whether it is documentation."""
    return loaded(sidecars, "source").select("path", entries("symbols", SYMBOL).alias("symbols")).where(~is_doc & (F.size("symbols") > 0))


def roles(sidecars: DataFrame, is_doc: Column) -> DataFrame:
    """(path, role) of code that has one."""
    return loaded(sidecars, "source").select("path", value("file_role").alias("role")).where(~is_doc & (F.col("role") != ""))


def with_role(sidecars: DataFrame, role: str, is_doc: Column) -> DataFrame:
    return roles(sidecars, is_doc).where(F.col("role") == role).select("path")


def signatures(sidecars: DataFrame) -> DataFrame:
    """(path, kind, purpose, topics, public_surface) of files; those of folders are another thing."""
    own = sidecars.where(F.element_at(F.split("path", "/"), -1) != "_directory.signature.json")
    return loaded(own, "path").select("path", value("kind").alias("kind"), value("purpose").alias("purpose"), value("topics", "array<string>").alias("topics"), value("public_surface", "array<string>").alias("public_surface"))


def findings(sidecars: DataFrame) -> DataFrame:
    """(path, source_hash, impl_hash, at, findings): ``at`` is the sidecar's place in order, by which findings are known later."""
    first = sidecars.where(F.endswith("path", F.lit(ENDS["findings"])))
    own = loaded(first, "source").select("path", value("source_hash").alias("source_hash"), value("impl_hash").alias("impl_hash"), entries("findings", FINDING).alias("findings"))
    return own.withColumn("at", F.concat("path", F.lit(ENDS["findings"])))


def analyses(sidecars: DataFrame) -> DataFrame:
    """A row for each analysed document, which the sidecar's own path names; all findings count as errors of accuracy, whatever their severity, even those that are no objects."""
    end = ".analysis.json"
    docs = sidecars.where(F.endswith("path", F.lit(end))).select(F.expr(f"left(path, length(path) - {len(end)})").alias("path"), F.try_parse_json("text").alias("doc")).where(is_object(F.col("doc")))
    errors = F.transform(entries("findings", ERROR), lambda e: F.struct(F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["severity"], F.lit("warning")).alias("severity"), e["evidence"].alias("evidence"), e["shadow_ref"].alias("shadow_ref"), e["remediation"].alias("remediation")))
    none = F.array().cast("array<string>")
    return docs.select(
        "path",
        value("classification").alias("classification"),
        value("confidence", "double").alias("confidence"),
        value("topic_signature.purpose").alias("purpose"),
        F.coalesce(value("topic_signature.topics", "array<string>"), none).alias("topics"),
        F.coalesce(value("matched_shadows", "array<string>"), none).alias("matched_sources"),
        F.coalesce(F.size(value("findings", "array<variant>")), F.lit(0)).alias("accuracy_error_count"),
        errors.alias("findings"),
    )


def folder_summaries(shadows: DataFrame) -> DataFrame:
    """(folder, summary, children) of folders that have a summary: its beginning, and the sources in the folder itself that have a shadow, in order."""
    parts = F.split("path", "/")
    placed = shadows.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), "path", "text")
    whole, end = F.col("name") == "_directory.shadow.md", ENDS["shadow"]
    child = F.when(~whole & F.endswith("name", F.lit(end)), F.expr(f"left(path, length(path) - {len(end)})"))
    grouped = placed.groupBy("folder").agg(F.max(F.when(whole, F.substring("text", 1, PREVIEW))).alias("summary"), F.array_sort(F.collect_set(child)).alias("children"))
    return grouped.where("summary IS NOT NULL")


def topic_matches(matches: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc, path): sources in the folders that documents were matched with; matches: (doc, folder), the root written as nothing or ``(root)``, slashes at the ends don't count."""
    folder = F.regexp_replace("folder", "^/+|/+$", "")
    wanted = matches.select("doc", F.when(folder == "(root)", "").otherwise(folder).alias("folder")).distinct()
    return wanted.join(summaries.select("folder", F.explode("children").alias("path")), "folder").select("doc", "path").distinct()


# ---- writers


def documents(rows: DataFrame, impl_hash: str) -> DataFrame:
    """(kind, path, text): the sidecars of files (path, source_hash, body, findings, symbols, file_role, purpose, topics, facts...), all from one pass over the rows.

    ``facts`` is a struct of arrays; files without facts or symbols have no such sidecar, all have findings and a shadow.
    """
    head = [F.col("path").alias("source"), "source_hash"]
    shadow = F.concat(F.lit("@source: "), "path", F.lit("\n@source-hash: "), "source_hash", F.lit(f"\n@impl-hash: {impl_hash}\n\n"), F.coalesce("body", F.lit("")))
    kinds = {
        "shadow": shadow,
        "findings": F.to_json(F.struct(*head, F.lit(impl_hash).alias("impl_hash"), "findings")),
        "symbols": F.when((F.size("symbols") > 0) | F.col("file_role").isNotNull(), F.to_json(F.struct(*head, "file_role", "symbols"))),
        "signatures": F.when(F.col("purpose").isNotNull(), F.to_json(F.struct("path", F.lit("file").alias("kind"), "purpose", "topics"))),
        "facts": F.when(F.col("facts").isNotNull(), F.to_json(F.struct(*head, "facts.*"))),
    }
    all_ = F.array(*(F.struct(F.lit(kind).alias("kind"), F.concat("path", F.lit(ENDS[kind])).alias("path"), text.alias("text")) for kind, text in kinds.items()))
    return rows.select(F.explode(F.filter(all_, lambda x: x["text"].isNotNull())).alias("s")).select("s.*")


def write(sidecars: DataFrame, root: str) -> None:
    """Sidecars (kind, path, text) as a folder of zipped JSON lines for each kind, in one job that reads its rows once; kinds that come again are replaced, others stay."""
    with cleaned(sidecars.sparkSession):
        sidecars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").json(root, compression="gzip")
