"""Questions over facts: import resolution, edges, unused exports, references, definers.

Facts are a table with a row for each file (``path`` and arrays, as sources.python_facts gives them);
``classification`` is set for documents, where that column exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relations import suffixes

#: What a bare import of a file can mean, in order.
EXTENSIONS = ("", ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs")
INDEXES = ("/__init__.py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def table(facts: DataFrame, field: str) -> DataFrame:
    """(path, entry's fields): one of the arrays as a relation."""
    return facts.select("path", F.explode(field).alias("e")).select("path", "e.*")


def code_only(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("classification").isNull()) if "classification" in facts.columns else facts


def _join_path(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat_ws("/", folder, rest))


def _up(folder: Column, levels: Column) -> Column:
    """The folder so many levels up; null above the root."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.when(levels <= F.size(parts), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - levels), "/"))


def bases(folder: Column, source: Column) -> Column:
    """What an import may mean, but for the end of a file's name, first come first: relative ones from the file's folder, dotted and plain ones from the root or src."""
    dots = F.length(F.regexp_extract(source, r"^(\.+)(?!/|\.*/)", 1))
    steps = F.length(F.regexp_replace(F.regexp_extract(source, r"^((?:\.\.?/)+)", 1), r"[^.]", ""))
    ups = F.size(F.regexp_extract_all(source, F.lit(r"\.\./"), F.lit(0)))
    dotted = F.translate(F.regexp_replace(source, r"^\.+", ""), ".", "/")
    relative = F.when(steps > 0, _join_path(_up(folder, ups), F.regexp_replace(source, r"^(?:\.\.?/)+", ""))).when(dots > 0, _join_path(_up(folder, dots - 1), dotted))
    absolute = F.when((steps == 0) & (dots == 0), F.array(dotted, F.concat(F.lit("src/"), dotted), source))
    return F.coalesce(absolute, F.array(relative))


def resolved_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The imports with ``target``: the file of the first candidate there is, then of the least path that ends in the dotted name; null for outside ones.

    A candidate is a base with one of the known ends. Files are cut at their ends, so that bases meet instead of all candidates, once for
    each source (of relative ones for each folder and source), however many files import it.
    """
    imports = table(facts, "imports")
    known = files.select(F.col("path").alias("target"))
    parts = F.split("path", "/")
    folder = F.when(F.startswith("source", F.lit(".")), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise("")
    rows = imports.withColumn("__from", folder)
    own = rows.select("__from", "source").distinct()
    ends = (*EXTENSIONS, *INDEXES)
    asked = own.select("__from", "source", F.posexplode(bases(F.col("__from"), F.col("source"))).alias("__k", "__base"))
    cuts = F.array(*(F.when(F.endswith("target", F.lit(end)), F.struct(F.expr(f"left(target, length(target) - {len(end)})").alias("base"), F.lit(k).alias("end"))) for k, end in enumerate(ends)))
    there = known.select("target", F.inline(F.array_compact(cuts))).select("target", F.col("base").alias("__base"), "end")
    direct = asked.join(there.hint("merge"), "__base").select("__from", "source", (F.col("__k") * len(ends) + F.col("end")).alias("rank"), "target")
    # every tail of a file's dotted name; the least path of equals, where the order of a listing would be arbitrary
    bare = F.regexp_replace(F.regexp_replace("target", r"\.[^./]*$", ""), "/(?:__init__|index)$", "")
    tails = known.select("target", F.explode(suffixes(F.translate(bare, "/", "."))).alias("source")).groupBy("source").agg(F.min("target").alias("target"))
    rest = own.where(~F.startswith("source", F.lit("."))).join(tails.hint("merge"), "source").select("__from", "source", F.lit(2**31 - 1).alias("rank"), "target")
    found = direct.union(rest).groupBy("__from", "source").agg(F.min(F.struct("rank", "target")).alias("m")).select("__from", "source", F.col("m.target").alias("target"))
    return rows.join(found.hint("merge"), ["__from", "source"], "left").select(*imports.columns, "target")


def import_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, names, is_reexport): names in order, joined by commas."""
    known = resolved.where(F.col("target").isNotNull())
    named = known.select("path", "target", "is_reexport", F.explode_outer("names").alias("name"))
    return named.groupBy(F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"), F.bool_or("is_reexport").alias("is_reexport"))


def importers(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """(path, importer): who imports a file, but for itself and documents."""
    edges = resolved.where(F.col("target").isNotNull() & (F.col("target") != F.col("path"))).select(F.col("target").alias("path"), F.col("path").alias("importer")).distinct()
    return edges.join(code_only(facts).select(F.col("path").alias("importer")).hint("merge"), "importer", "left_semi").select("path", "importer")


def docs_referencing(facts: DataFrame) -> DataFrame:
    """(path, doc): sources that documents name exactly."""
    docs = facts.where(F.col("classification").isNotNull())
    return table(docs, "imports").select(F.col("source").alias("path"), F.col("path").alias("doc")).distinct()


def imported_names(resolved: DataFrame) -> DataFrame:
    """(path, name): names that somebody imports of a file, by their original name; "*" for all."""
    original = F.transform("names", lambda n: F.coalesce(F.element_at("name_map", n), n))
    return resolved.where(F.col("target").isNotNull()).select(F.col("target").alias("path"), F.explode(original).alias("name")).distinct()


def unused_exports(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, name): exports that nobody imports, of files that nobody imports whole."""
    exports = table(facts, "exports").select("path", "name").distinct()
    names = imported_names(resolved)
    return exports.join(names.hint("merge"), ["path", "name"], "left_anti").join(names.where("name = '*'").select("path").hint("merge"), "path", "left_anti")


def definers(facts: DataFrame) -> DataFrame:
    """(name, path): which files export a name."""
    return table(facts, "exports").select("name", "path").distinct()


def cross_references(facts: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, ref_path, kind, line) for symbols (path, name) used in other files.

    Kinds: import (by original name), call (the callee is or ends in the name), dispatch (a method of the
    name's last part is called in a file that imports the definer and has no direct call), member_write
    and export of the same name.
    """
    wanted = symbols.select("path", "name").distinct()
    imports = resolved.where(F.col("target").isNotNull()).select(F.col("path").alias("ref_path"), F.explode(F.transform("names", lambda n: F.coalesce(F.element_at("name_map", n), n))).alias("name"), "line")
    calls = table(facts, "calls").select(F.col("path").alias("ref_path"), F.explode(suffixes(F.col("to"))).alias("name"), "line", F.col("to"))
    writes = table(facts, "member_writes").select(F.col("path").alias("ref_path"), F.col("member").alias("name"), "line")
    exports = table(facts, "exports").select(F.col("path").alias("ref_path"), "name", "line")

    def hits(rows: DataFrame, kind: str) -> DataFrame:
        # names of many files come from small tables: none is sent to all machines
        return wanted.join(rows.hint("merge"), "name").where(F.col("ref_path") != F.col("path")).select("path", "name", "ref_path", F.lit(kind).alias("kind"), "line")

    direct = hits(calls, "call")
    methods = wanted.where(F.contains("name", F.lit("."))).withColumn("method", F.element_at(F.split("name", r"\."), -1))
    last = table(facts, "calls").where(F.contains("to", F.lit("."))).select(F.col("path").alias("ref_path"), F.element_at(F.split("to", r"\."), -1).alias("method"), "line")
    uses = importers(resolved, facts).withColumnRenamed("importer", "ref_path")
    # by importer first: calls of a common method name never meet all classes that have one
    dispatch = methods.join(uses.hint("merge"), "path").join(last.hint("merge"), ["ref_path", "method"]).join(direct.hint("merge"), ["path", "name", "ref_path"], "left_anti")
    return hits(imports, "import").union(direct).union(dispatch.select("path", "name", "ref_path", F.lit("dispatch").alias("kind"), "line")).union(hits(writes, "member_write")).union(hits(exports, "export")).distinct()


def call_sites(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, to, definer, name, call_sites): calls of imported names, resolved over aliases, with how often each definition is called."""
    alias = resolved.where(F.col("target").isNotNull()).select("path", F.explode("names").alias("local"), "name_map", F.col("target").alias("definer"))
    alias = alias.select("path", "local", F.coalesce(F.element_at("name_map", F.col("local")), F.col("local")).alias("original"), "definer")
    calls = table(facts, "calls").select("path", "to", F.get(F.split("to", r"\."), F.lit(0)).alias("local"))
    named = calls.join(alias, ["path", "local"]).withColumn("name", F.concat("original", F.expr("substring(to, length(local) + 1)")))
    counts = named.groupBy("definer", "name").agg(F.count("*").alias("call_sites"))
    return named.join(counts, ["definer", "name"]).select("path", "to", "definer", "name", "call_sites").distinct()


def fan_in(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, fan_in, exports) of every file, zeros included."""
    counts = importers(resolved, facts).groupBy("path").agg(F.countDistinct("importer").alias("fan_in"))
    return facts.select("path", F.size("exports").alias("exports")).join(counts, "path", "left").fillna(0, ["fan_in"])


def only_parsed_importers(facts: DataFrame, resolved: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path): files all of whose importers are in ``parsed``; those without importers too."""
    other = importers(resolved, facts).join(parsed.select(F.col("path").alias("importer")), "importer", "left_anti")
    return facts.select("path").join(other.select("path"), "path", "left_anti")


def strings_by_usage(facts: DataFrame, usage: str) -> DataFrame:
    """(path, value): distinct strings used that way."""
    return table(facts, "string_literals").where(F.col("usage") == usage).select("path", "value").distinct()


def callees(facts: DataFrame, path: str, symbol: str | None = None, lines: tuple[int, int] | None = None) -> DataFrame:
    """The calls made in a file, in a symbol or a dotted name that ends in it, in a range of lines."""
    rows = table(facts.where(F.col("path") == path), "calls")
    if symbol:
        rows = rows.where((F.col("from_symbol") == symbol) | F.endswith("from_symbol", F.lit(f".{symbol}")))
    return rows.where(F.col("line").between(*lines)) if lines else rows
