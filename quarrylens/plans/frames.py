"""Callee frames of findings that tell of an order of calls: what the functions tied to a finding call, and those they call.

A finding's seeds are, in this order: resolved targets of calls in its lines (and three around), functions its message
names that are in its file's reach, and the smallest symbol around it. Seeds are taken first in, first out;
what a seed calls in a known file becomes a seed too, as long as there are less than SEEDS. All findings take their
next seed together, so the rounds are SEEDS joins with the frames, each of bounded size. Caps are part of the evidence's
definition (a reader's budget); true totals stand beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_array
from ..operators.relations import suffixes
from ..sources.storage import stored
from . import facts as fx

#: Seeds of a finding, callees of a frame, edges of a finding, lines of an edge; code points of a callee, and of a line's text.
SEEDS, TARGETS, EDGES, LINES, NAME, WIDTH = 5, 15, 40, 5, 80, 200
#: Lines around a finding whose calls count as its own; lines that meet spans in one bucket.
AROUND, BUCKET = 3, 64
#: Words of claims about order or control flow.
ORDER_WORDS = (
    r"(?i)\b(before|after|then|first|prior|preced\w*|follow\w*|order(?:ing)?|sequence\w*|throws?|thrown|throwing|raise[sd]?|raising|rethrow\w*|"
    r"catch(?:es|ing)?|call(?:s|ed|ing)?|invoke\w*|invocation|propagat\w*|early|short-circuit\w*|bails?|returns? before|exits? before)\b"
)
SEED = "struct<name:string,file:string,origin:string>"


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def shown_name(name: Column) -> Column:
    """A callee's text on one line, cut to NAME code points."""
    return F.substring(F.trim(F.regexp_replace(name, r"\s+", " ")), 1, NAME)


def ordered_calls(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, from_symbol, to, line, at, definer) of all calls; ``at`` orders a file's calls; definer is the known file that has the callee, its own first, else the first import's."""
    calls = facts.select("path", F.posexplode("calls").alias("pos", "c")).select("path", "c.from_symbol", "c.to", "c.line", F.struct(F.coalesce(F.col("c.line").cast("long"), F.lit(0)).alias("line"), "pos").alias("at"))
    asked = calls.where(F.col("to").isNotNull()).select("path", "to").distinct()
    exports = fx.table(facts, "exports").select("path", F.col("name").alias("bare"), F.col("path").alias("own")).distinct()
    named = resolved.where(F.col("target").isNotNull()).join(facts.select(F.col("path").alias("target")), "target", "left_semi").select("path", F.explode("names").alias("name"), F.struct("line", "target").alias("from"))
    imported = asked.select("path", "to", F.explode(F.array_distinct(F.array(last_part(F.col("to")), "to"))).alias("name")).join(named, ["path", "name"]).groupBy("path", "to").agg(F.min("from").alias("from"))
    known = asked.withColumn("bare", last_part(F.col("to"))).join(exports, ["path", "bare"], "left").join(imported, ["path", "to"], "left")
    return calls.join(known.select("path", "to", F.coalesce("own", "from.target").alias("definer")), ["path", "to"], "left")


def frames(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, total, edges, next): what each symbol calls. A symbol without calls of its own has those in its lines."""
    own = calls.where(F.col("from_symbol").isNotNull()).select("path", F.explode(suffixes(F.col("from_symbol"))).alias("name"), "to", "line", "at", "definer")
    spans = symbols.where(F.col("line_start") > 0).groupBy("path", "name").agg(F.min(F.struct("line_start", F.coalesce("line_end", "line_start").alias("end"))).alias("s")).select("path", "name", "s.*")
    bare = spans.join(own.select("path", "name").distinct(), ["path", "name"], "left_anti").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    placed = calls.where(F.col("line").isNotNull()).withColumn("bucket", F.floor(F.col("line") / BUCKET))
    inside = placed.join(bare, ["path", "bucket"]).where(F.col("line").between(F.col("line_start"), F.col("end"))).select("path", "name", "to", "line", "at", "definer")
    # three groupings read these rows: they are joined and named once
    rows = stored(own.unionByName(inside).withColumn("shown", shown_name(F.coalesce("to", F.lit("")))).select("path", "name", "shown", last_part(F.col("to")).alias("to"), "line", "at", "definer"), "frame-calls")
    key = ["path", "name"]
    lines = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))), lambda x: x["line"]), 1, LINES)
    edges = rows.where("shown <> ''").groupBy(*key, "shown").agg(F.min("at").alias("at"), lines.alias("lines"))
    edges = edges.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "shown", "lines"))), 1, TARGETS).alias("edges"))
    # the first 2 * SEEDS are enough: at most SEEDS of them can be seeds already
    further = rows.where("shown <> '' AND definer IS NOT NULL").groupBy(*key, "to", "definer").agg(F.min("at").alias("at"))
    further = further.groupBy(*key).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", F.col("to").alias("name"), F.col("definer").alias("file")))), 1, 2 * SEEDS).alias("next"))
    return rows.groupBy(*key).agg(F.count("*").alias("total")).join(edges, key, "left").join(further, key, "left").withColumnRenamed("path", "file")


def first_seeds(findings: DataFrame, facts: DataFrame, resolved: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, seeds, unresolved): what findings start from."""
    low = F.coalesce("line_start", F.lit(1))
    span = findings.select("id", "path", "message", low.alias("start"), (low - AROUND).alias("low"), (F.coalesce("line_end", low) + AROUND).alias("high"))
    wide = span.select("id", "path", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))).alias("bucket"))
    near = wide.join(calls.where(F.col("line").isNotNull() & (F.col("to") != "")).withColumn("bucket", F.floor(F.col("line") / BUCKET)), ["path", "bucket"]).where(F.col("line").between(F.col("low"), F.col("high")))
    region = near.where("definer IS NOT NULL").select("id", F.lit(0).alias("rank"), F.struct("at", F.lit("").alias("word")).alias("place"), last_part(F.col("to")).alias("name"), F.col("definer").alias("file"))
    unresolved = near.where("definer IS NULL").groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "to"))), lambda x: x["to"]), 1, SEEDS).alias("unresolved"))
    quoted = F.regexp_extract_all("message", F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))
    words = span.select("id", "path", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("message", F.lit(r"\b[A-Za-z_]\w{2,}\b"), F.lit(0)), quoted, F.transform(quoted, last_part)))).alias("name"))
    imported = resolved.where(F.col("target").isNotNull()).select("path", F.explode("names").alias("name"), F.struct("line", "target").alias("from")).groupBy("path", "name").agg(F.max("from").alias("from"))
    reach = fx.table(facts, "exports").select("path", "name").union(symbols.select("path", "name")).distinct().withColumn("own", F.col("path"))
    named = words.join(imported, ["path", "name"], "left").join(reach, ["path", "name"], "left").withColumn("file", F.coalesce("from.target", "own")).where("file IS NOT NULL")
    no_place = F.struct(F.lit(0).cast("long").alias("line"), F.lit(0).alias("pos"))
    claimed = named.select("id", F.lit(1).alias("rank"), F.struct(no_place.alias("at"), F.col("name").alias("word")).alias("place"), "name", "file")
    around = symbols.where("line_start > 0 AND line_end > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))
    inside = span.withColumn("bucket", F.floor(F.col("start") / BUCKET)).join(around, ["path", "bucket"]).where(F.col("start").between(F.col("line_start"), F.col("line_end")))
    smallest = inside.groupBy("id", "path").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("n"), "line_start", "name")).alias("m"))
    enclosing = smallest.select("id", F.lit(2).alias("rank"), F.struct(no_place.alias("at"), F.lit("").alias("word")).alias("place"), F.col("m.name").alias("name"), F.col("path").alias("file"))
    each = region.union(claimed).union(enclosing).groupBy("id", "name", "file").agg(F.min(F.struct("rank", "place")).alias("first"))
    listed = each.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "name", "file"))), 1, SEEDS).alias("found"))
    origins = F.array(F.lit("region"), F.lit("claim_text"), F.lit("enclosing"))
    seeds = F.transform("found", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), F.get(origins, x["first"]["rank"]).alias("origin")))
    return listed.select("id", seeds.alias("seeds")).join(unresolved, "id", "left").withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))


def callee_frames(findings: DataFrame, facts: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, seeds, edges, edges_total, unresolved) of findings (id, path, line_start, line_end, message) that tell of order and have edges.

    Null messages tell of nothing; files without facts give no frames; calls without a line are shown without one.
    """
    telling = findings.where(F.coalesce(F.col("message").rlike(ORDER_WORDS), F.lit(False))).join(facts.select("path"), "path", "left_semi")
    calls = stored(ordered_calls(facts, resolved), "ordered-calls")
    of = stored(frames(calls, symbols), "frames")
    rows = first_seeds(telling, facts, resolved, symbols, calls)
    rows = rows.withColumns({"edges": F.array().cast("array<struct<caller:string,caller_file:string,to:string,lines:array<bigint>>>"), "edges_total": F.lit(0).cast("long"), "done": F.lit(False)})
    for k in range(SEEDS):
        seed = F.get("seeds", F.lit(k))
        met = rows.withColumns({"__file": F.when(~F.col("done"), seed["file"]), "__name": seed["name"]}).join(of.select(F.col("file").alias("__file"), F.col("name").alias("__name"), "total", F.col("edges").alias("__edges"), "next"), ["__file", "__name"], "left")
        new = F.filter(F.coalesce("next", F.array().cast("array<struct<at:struct<line:bigint,pos:int>,name:string,file:string>>")), lambda n: ~F.exists("seeds", lambda s: (s["name"] == n["name"]) & (s["file"] == n["file"])))
        promoted = F.transform(F.slice(new, F.lit(1), F.lit(SEEDS) - F.size("seeds")), lambda n: F.struct(n["name"].alias("name"), n["file"].alias("file"), F.lit("callee").alias("origin")))
        shown = F.transform(F.coalesce("__edges", F.array().cast("array<struct<at:struct<line:bigint,pos:int>,shown:string,lines:array<bigint>>>")), lambda e: F.struct(F.col("__name").alias("caller"), F.col("__file").alias("caller_file"), e["shown"].alias("to"), F.transform(e["lines"], lambda x: x.cast("long")).alias("lines")))
        edges = F.concat("edges", shown)
        rows = met.select("id", F.concat("seeds", promoted.cast(f"array<{SEED}>")).alias("seeds"), F.slice(edges, 1, EDGES).alias("edges"), (F.col("edges_total") + F.coalesce("total", F.lit(0))).alias("edges_total"), (F.col("done") | (F.size(edges) >= EDGES)).alias("done"), "unresolved")
    return rows.where(F.size("edges") > 0).drop("done")


def with_line_texts(framed: DataFrame, files: DataFrame) -> DataFrame:
    """The edges with the text of their first line, cut to WIDTH code points: calls that share a line may be nested."""
    each = framed.select("id", F.posexplode("edges").alias("k", "e")).withColumn("path", F.col("e.caller_file"))
    text = F.substring(F.trim(F.get(line_array(F.col("text")), (F.get("e.lines", F.lit(0)) - 1).cast("int"))), 1, WIDTH)
    told = each.join(files.select("path", "text"), "path", "left").select("id", F.struct("k", "e.caller", "e.caller_file", "e.to", "e.lines", text.alias("line_text")).alias("e"))
    return framed.drop("edges").join(told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: x.dropFields("k")).alias("edges")), "id")
