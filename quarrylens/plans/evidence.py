"""Evidence for findings: references elsewhere, surrounding code, callees, cited names.

Every builder takes findings (id, path, symbol, line_start, message) and what it reads, and gives
(id, payload), payload being a JSON string; EvidenceKinds that find nothing give no row. Caps are part of
the evidence's definition (a reader's budget), and true totals stand beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import line_array
from ..operators import graph, intervals, lines, nearest
from . import facts as fx
from . import frames
from .merging import types_of

#: Rows shown: for a finding, for one file of it, around a line, and code points of a line.
PER_FINDING, PER_FILE, AROUND, WIDTH = 20, 3, 2, 200
NEEDLES = 5
#: Code points of documentation shown; lines by which a file's symbols are spread.
EXCERPT, BUCKET = 2000, 256
#: Lines above a finding's own in which an annotation counts.
TYPED = 39


def backticked(text: Column) -> Column:
    """Names in backticks, and the last part of dotted ones."""
    names = F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))
    tails = F.filter(F.transform(names, lambda n: F.element_at(F.split(n, r"\."), -1)), lambda t: F.length(t) > 2)
    return F.array_distinct(F.concat(names, tails))


def quoted_literals(text: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\"']([^\"'\n]{2,60})[\"']"), F.lit(1))), 1, NEEDLES)


def needles(findings: DataFrame) -> DataFrame:
    """(id, path, needle, ord): what to look for: the symbol, else names in backticks, else quoted strings; five at most."""
    named = F.when(F.col("symbol").isNotNull(), F.array("symbol")).when(F.size(backticked(F.col("message"))) > 0, backticked(F.col("message"))).otherwise(quoted_literals(F.col("message")))
    return findings.select("id", "path", F.posexplode(F.slice(named, 1, NEEDLES)).alias("ord", "needle"))


def scope(folders: Column) -> Column:
    """How far apart things are: one file, one folder, or the project."""
    parents = F.array_distinct(F.transform(folders, lambda p: F.regexp_replace(p, r"/?[^/]*$", "")))
    return F.when(F.size(F.array_distinct(folders)) <= 1, "file").when(F.size(parents) <= 1, "folder").otherwise("project")


def shared_prefix(a: Column, b: Column) -> Column:
    """Leading folders that two paths have in common."""
    x, y = F.split(a, "/"), F.split(b, "/")
    return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda k: F.slice(x, F.lit(1), k) == F.slice(y, F.lit(1), k)))


def references(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Other files' lines with a finding's needles, near files first: some for each needle and file, and how many there are."""
    text = lines.explode_lines(files, ["path"]).withColumnRenamed("path", "file")
    words = text.select("file", "line_no", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)), F.regexp_extract_all("line", F.lit(r"\w+(?:\.\w+)+"), F.lit(0))))).alias("needle"))
    hits = words.join(needles(findings), "needle").where(F.col("file") != F.col("path"))
    totals = hits.groupBy("id").agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"))
    near = hits.withColumn("near", shared_prefix(F.col("file"), F.col("path")))
    in_file = F.row_number().over(Window.partitionBy("id", "needle", "file").orderBy("line_no"))
    shown = near.withColumn("k", in_file).where(F.col("k") <= PER_FILE)
    order = Window.partitionBy("id").orderBy("ord", F.desc("near"), "file", "line_no")
    shown = shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_FINDING)
    around = line_array(F.col("text"))
    context = F.transform(F.slice(around, F.greatest(F.col("line_no") - AROUND, F.lit(1)).cast("int"), F.lit(2 * AROUND + 1)), lambda x: F.substring(x, 1, WIDTH))
    rows = shown.join(files.select(F.col("path").alias("file"), "text"), "file").select("id", "place", F.struct("needle", "file", "line_no", F.array_join(context, "\n").alias("context")).alias("hit"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "hit"))).alias("hits"))
    return listed.join(totals, "id").select("id", F.to_json(F.struct(F.transform("hits", lambda h: h["hit"]).alias("hits"), "total", "files")).alias("payload"))


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a table need not have; null without it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def enclosing(placed: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, s, e, name): the smallest symbol around the line ``at`` of (id, path, at); of equals the one that starts first, then the least name. Symbols without an end have no inside."""
    spans = symbols.where("line_start > 0 AND line_end >= line_start").select("path", F.struct(F.col("line_start").cast("long").alias("s"), F.col("line_end").cast("long").alias("e"), "name").alias("symbol"), F.col("line_start").cast("long").alias("s"), F.col("line_end").cast("long").alias("e"))
    found = intervals.smallest_enclosing(placed, spans, "path", "at", "id", "symbol", "s", "e", BUCKET)
    return found.select("id", "symbol.*")


def _cut(ls: Column, first: Column, last: Column) -> Column:
    """Lines by their numbers, both ends included, each to its width."""
    return F.transform(F.slice(ls, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), lambda x: F.substring(x, 1, 2 * WIDTH))


def numbered(files: DataFrame) -> DataFrame:
    """(path, ls) of files, their lines; no machine takes them all, however small the files that they come from."""
    return files.select("path", T.universal_lines(F.col("text")).alias("ls")).hint("merge")


def surrounding(findings: DataFrame, files: DataFrame, symbols: DataFrame, radius: int = 10) -> DataFrame:
    """The lines around a finding: around its symbol where that is defined in the file, else around the line with the symbol's name that is nearest to the finding, else around its own lines.

    Beside them the smallest symbol that encloses the place, unless it is the place. A finding without a line is about the first one.
    """
    placed = findings.select("id", "path", optional(findings, "symbol", "string").alias("symbol"), F.coalesce(F.col("line_start"), F.lit(1)).cast("long").alias("s0"), optional(findings, "line_end", "long").alias("e0"))
    defined = symbols.where("line_start > 0").groupBy("path", F.col("name").alias("symbol")).agg(F.min(F.struct(F.col("line_start").cast("long").alias("s"), F.coalesce("line_end", "line_start").cast("long").alias("e"))).alias("own"))
    rows = placed.join(defined.hint("merge"), ["path", "symbol"], "left").join(numbered(files), "path").where(F.size("ls") > 0)
    word = F.concat(F.lit(r"\b\Q"), "symbol", F.lit(r"\E\b"))
    near = F.array_min(F.transform("ls", lambda x, i: F.when(F.rlike(x, word), F.struct(F.abs(i + 1 - F.col("s0")).alias("d"), (i + 1).cast("long").alias("at")))))
    near = F.when(F.col("own").isNull() & (F.col("symbol") != ""), near)["at"]
    rows = rows.withColumn("__near", near).select(
        "id", "path", "ls", F.coalesce("own.s", "__near", "s0").alias("at"), F.coalesce("own.e", "__near", F.greatest("e0", "s0"), "s0").alias("to"),
        F.when(F.coalesce("own.s", "__near").isNotNull(), "symbol").otherwise("lines").alias("anchor"),
    )
    around = rows.join(enclosing(rows.select("id", "path", "at"), symbols).hint("merge"), "id", "left")
    first, last = F.greatest(F.col("at") - radius, F.lit(1)), F.least(F.col("to") + radius, F.size("ls").cast("long"))
    code = F.transform(_cut(F.col("ls"), first, last), lambda x, i: F.concat_ws("\t", (i + first).cast("string"), x))
    named = F.when((F.col("s") != F.col("at")) | (F.col("e") != F.col("to")), F.col("name"))
    return around.select("id", F.to_json(F.struct(first.alias("line_start"), last.alias("line_end"), "anchor", named.alias("enclosing"), F.array_join(code, "\n").alias("code"))).alias("payload"))


def declared_intent(findings: DataFrame, files: DataFrame, symbols: DataFrame, before: int = 10, head: int = 15) -> DataFrame:
    """What the code says it is for: the lines before a finding, and the first lines of the smallest symbol that encloses it, none beyond its end."""
    placed = findings.select("id", "path", F.coalesce(F.col("line_start"), F.lit(1)).cast("long").alias("at"))
    rows = placed.join(numbered(files), "path").join(enclosing(placed, symbols).hint("merge"), "id", "left")
    first = F.greatest(F.col("at") - before, F.lit(1))
    above = F.when(F.col("at") > 1, F.array_join(_cut(F.col("ls"), first, F.col("at") - 1), "\n"))
    begin = F.when(F.col("s").isNotNull(), F.array_join(_cut(F.col("ls"), F.col("s"), F.least("e", F.col("s") + (head - 1))), "\n"))
    return rows.where((F.size("ls") > 0) & ((F.col("at") > 1) | F.col("s").isNotNull())).select("id", F.to_json(F.struct(above.alias("before"), begin.alias("enclosing"))).alias("payload"))


def inferred_types(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(id, variable, type): types of the variables whose members a message names, as last annotated at most TYPED lines above."""
    variables = findings.where("line_start > 0").select("id", "path", F.col("line_start").cast("long").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"`(\w+)\.\w+`"), F.lit(1)))).alias("variable"))
    text = lines.explode_lines(files, ["path"])
    found = r"\b(\w+)(?=\s*:\s*[\"']?([A-Z]\w+))"
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(found), F.lit(1)).alias("variable"), F.regexp_extract_all("line", F.lit(found), F.lit(2)).alias("type"))
    bound = text.where(F.contains("line", F.lit(":"))).select("path", F.col("line_no").cast("long").alias("at"), F.posexplode(both).alias("k", "b")).groupBy("path", "at", "b.variable").agg(F.min_by("b.type", "k").alias("type"))
    return nearest.as_of(variables, bound, ["path", "variable"], "at", TYPED, ["type"]).where("type IS NOT NULL").select("id", "variable", "type")


def type_signatures(findings: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Definitions of the types that a finding's message names, and of those that variables in it have."""
    named = findings.select("id", F.explode(backticked(F.col("message"))).alias("name"))
    names = named.union(inferred_types(findings, files).select("id", F.col("type").alias("name"))).distinct()
    found = names.join(types_of(names, symbols, files), "name")
    listed = F.array_sort(F.collect_set(F.struct("name", "path", "snippet"))).alias("types")
    return found.groupBy("id").agg(listed).select("id", F.to_json(F.struct("types")).alias("payload"))


def callees(findings: DataFrame, facts: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """What the functions tied to a finding call, and those they call; only for findings that tell of an order of calls."""
    return frames.callee_frames(findings, facts, resolved, symbols).select("id", F.to_json(F.struct("seeds", "edges", "edges_total", "unresolved")).alias("payload"))


def cited(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Files that define the names a finding's message cites."""
    names = findings.select("id", F.explode(backticked(F.col("message"))).alias("name"))
    hits = names.join(fx.definers(facts), "name")
    return hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("name", "path"))).alias("cited")).select("id", F.to_json(F.struct("cited")).alias("payload"))


def shadow_claims(findings: DataFrame, shadows: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """What documentation says about a finding's place: (file, scope, excerpt).

    That of the finding's file; of its folder too where the finding is about a description. A finding about a description whose own path
    has none gets that of the least scope around the sources it names (``shadow_ref``, and those ``search_terms`` with a slash that have some): a
    file, the folder that all lie in, or else the root. ``folders`` has (folder, text), the root being the empty path.
    """
    text = F.coalesce("text", F.lit(""))
    own = shadows.select("path", F.substring(text, 1, EXCERPT).alias("excerpt")).where("excerpt <> ''")
    above = (folders if folders is not None else shadows.select(F.col("path").alias("folder"), "text").limit(0)).select("folder", F.substring(text, 1, EXCERPT).alias("excerpt")).where("excerpt <> ''")
    rows = findings.select("id", T.normal_path(F.col("path")).alias("path"), (F.coalesce(optional(findings, "gap_type", "string"), F.lit("")) == "description").alias("described"), optional(findings, "shadow_ref", "string").alias("ref"), optional(findings, "search_terms", "array<string>").alias("terms"))
    rows = rows.join(own.select("path", F.lit(True).alias("has")), "path", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    ref = F.translate("ref", "\\", "/")
    terms = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda x: F.translate(x, "\\", "/")), lambda x: F.contains(x, F.lit("/")))
    loose = rows.where("described AND NOT has")
    known = loose.select("id", F.explode(F.array_distinct(terms)).alias("path")).join(own.select("path"), "path", "left_semi").select("id", "path")
    named = known.union(loose.where(ref != "").select("id", ref.alias("path"))).distinct()
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    counted = named.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("one"), F.countDistinct(folder).alias("n_folders"), F.min(folder).alias("folder"))
    placed = loose.select("id").join(counted, "id", "left")
    scope = F.when(F.col("n") == 1, "file").when(F.col("n_folders") == 1, "directory").otherwise("root")
    placed = placed.select("id", scope.alias("scope"), F.when(scope == "file", F.col("one")).when(scope == "directory", F.col("folder")).otherwise("").alias("file"))
    wanted = rows.where("has").select("id", F.lit("file").alias("scope"), F.col("path").alias("file")).union(placed)
    # a description's folder counts beside its file; without any documentation of named sources it stands alone
    files_ = wanted.where("scope = 'file'").join(own.withColumnRenamed("path", "file"), "file")
    trees = wanted.where("scope <> 'file'").join(above.withColumnRenamed("folder", "file"), "file")
    found = files_.select("id", "file", "scope", "excerpt").union(trees.select("id", "file", "scope", "excerpt"))
    beside = rows.where("described").join(found.join(rows.where("NOT has").select("id"), "id", "left_semi").select("id").distinct(), "id", "left_anti").select("id", "path", folder.alias("folder")).join(above, "folder")
    return found.union(beside.select("id", F.col("path").alias("file"), F.lit("directory").alias("scope"), "excerpt")).select("id", F.to_json(F.struct("file", "scope", "excerpt")).alias("payload"))


def overlapping_claims(findings: DataFrame) -> DataFrame:
    """(id, component): findings of different detectors whose lines overlap, over any number of steps."""
    spans = findings.where("line_start IS NOT NULL").select("id", "path", "detector", F.col("line_start").alias("s"), F.coalesce("line_end", "line_start").alias("e"))
    other = spans.select(F.col("id").alias("id2"), "path", F.col("detector").alias("detector2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = spans.join(other, "path").where((F.col("id") < F.col("id2")) & (F.col("detector") != F.col("detector2")) & (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")))
    return graph.components(pairs.select(F.col("id").alias("src"), F.col("id2").alias("dst"))).withColumnRenamed("node", "id")


BUILDERS = {"cross_file_reference": references, "surrounding_code": surrounding, "callee_edges": callees, "cited_artifact": cited, "shadow_doc_claim": shadow_claims, "declared_intent": declared_intent, "type_signature": type_signatures}
