"""Detectors: each proposes candidate findings from files and facts by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, graph, lines
from ..sources import repository
from ..sources.storage import stored
from . import facts as fx

#: Packages that build or test and are never imported.
TOOLS = {"setuptools", "wheel", "hatchling", "poetry-core", "pytest", "ruff", "mypy", "black", "pip", "tox", "typescript", "eslint", "prettier", "webpack", "vite"}
#: Strings of fewer code points, or as common as these, are no contract.
SHORT, COMMON = 3, {"name", "type", "value", "key", "id", "data", "path", "utf-8", "true", "false", "none", "null", "get", "set"}


def symbols(facts: DataFrame) -> DataFrame:
    """(path, name, kind, line_start, line_end, flagged)."""
    return fx.table(facts, "exports").select("path", "name", "kind", F.col("line").alias("line_start"), F.col("line_end"), F.col("exclude_from_dead_analysis").alias("flagged"))


def implemented_methods(facts: DataFrame) -> DataFrame:
    """(path, name): methods of classes that have, directly or further up, a base with a method of that name, or one from outside."""
    classes = fx.table(facts, "exports").where("kind = 'class'").select(F.col("name").alias("cls"), "path", "bases")
    # of classes of one name the least path counts
    one = classes.groupBy("cls").agg(F.min_by("bases", "path").alias("bases"))
    up = one.select("cls", F.explode("bases").alias("base")).select("cls", F.element_at(F.split("base", r"\."), -1).alias("base"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(up.select(F.col("cls").alias("base"), F.col("base").alias("further")).hint("merge"), "base").select("cls", F.col("further").alias("base"))

    above = graph.fixpoint(up, step)
    methods = fx.table(facts, "exports").where("kind = 'method'").select("path", "name", F.get(F.split("name", r"\."), F.lit(0)).alias("cls"), F.element_at(F.split("name", r"\."), -1).alias("method"))
    theirs = methods.select(F.col("cls").alias("base"), "method")
    # names of classes are as many as files: none of these tables is sent to all machines
    inherited = methods.join(above.hint("merge"), "cls").join(theirs.hint("merge"), ["base", "method"], "left_semi").select("path", "name")
    outside = above.join(one.select(F.col("cls").alias("base")).hint("merge"), "base", "left_anti").where("base <> 'object'").select("cls").distinct()
    return inherited.union(methods.join(outside.hint("merge"), "cls", "left_semi").select("path", "name")).distinct()


def alive_inside(files: DataFrame, found: DataFrame, referenced: DataFrame) -> DataFrame:
    """(path, name): symbols that a referenced symbol of their file uses, over any number of steps."""
    text = lines.explode_lines(files, ["path"])
    used = text.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    bare = found.withColumn("word", F.element_at(F.split("name", r"\."), -1))
    mentions = used.join(bare.select("path", "word", F.col("name").alias("to"), F.col("line_start").alias("own")), ["path", "word"]).where(F.col("line_no") != F.col("own"))
    bodies = found.select("path", "name", "line_start", "line_end")
    # a body goes up to one line past its end
    edges = mentions.join(bodies, "path").where((F.col("line_no") > F.col("line_start")) & (F.col("line_no") <= F.col("line_end") + 1) & (F.col("name") != F.col("to")))
    node = lambda c: F.concat_ws("\0", "path", c)
    links = edges.select(node("name").alias("src"), node("to").alias("dst"))
    seeds = referenced.select(node("name").alias("node"))
    reached = graph.reachable(links, seeds).where("depth > 0").select(F.split("node", "\0").alias("n"))
    return reached.select(F.get("n", F.lit(0)).alias("path"), F.get("n", F.lit(1)).alias("name")).join(referenced, ["path", "name"], "left_anti")


def dead_symbols(files: DataFrame, facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, name, kind, line_start, line_end): public symbols no other file refers to and no live one of their own file uses."""
    found = symbols(facts).where(~F.col("flagged") & ~repository.is_test(F.col("path")))
    refs = fx.cross_references(facts, resolved, found).select("path", "name").distinct()
    whole = fx.imported_names(resolved).where("name = '*'").select("path")
    dead = found.join(refs, ["path", "name"], "left_anti").join(whole, "path", "left_anti").join(implemented_methods(facts), ["path", "name"], "left_anti")
    return dead.join(alive_inside(files, symbols(facts), refs), ["path", "name"], "left_anti").drop("flagged")


def dead_parameters(files: DataFrame, facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, name, parameter, calls): optional parameters of imported, called functions that no call passes by name or reaches by position."""
    functions = fx.table(facts, "exports").where("kind IN ('function', 'method')").select("path", "name", F.col("line").alias("start"), F.col("line_end").alias("end"), F.posexplode("parameters").alias("place", "p"))
    optional = functions.where("p.optional").select("path", "name", "start", "end", "place", F.col("p.name").alias("parameter")).withColumn("bare", F.element_at(F.split("name", r"\."), -1))
    users = fx.importers(resolved, facts)
    spots = users.union(users.select("path", F.col("path").alias("importer")).distinct())
    text = lines.explode_lines(files, ["path"]).withColumnRenamed("path", "importer")
    calls = text.select("importer", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("bare"))
    hits = optional.join(spots, "path").join(calls, ["importer", "bare"]).where((F.col("importer") != F.col("path")) | ~F.col("line_no").between(F.col("start"), F.col("end")))
    arguments = F.regexp_extract("line", r"\b\w+\s*\((.*)$", 1)
    named = F.contains("line", F.concat("parameter", F.lit("="))) | F.contains("line", F.lit("**"))
    reached = F.size(F.split(arguments, ",")) > F.col("place")
    counted = hits.groupBy("path", "name", "parameter").agg(F.count("*").alias("calls"), F.bool_or(named | (reached & (arguments != ""))).alias("passed"))
    return counted.where(~F.col("passed")).drop("passed")


def orphans(facts: DataFrame, resolved: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(path): files that import edges, in either direction, don't connect with an entry point."""
    edges = graph.both_ways(fx.import_edges(resolved).select("src", "dst"))
    reached = graph.reachable(edges, entry_points.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
    return facts.select("path").join(reached, "path", "left_anti").join(entry_points.select("path"), "path", "left_anti")


def entry_points(files: DataFrame) -> DataFrame:
    """(path): tests and files that are started by their name."""
    return files.where(repository.is_test(F.col("path")) | F.col("name").isin("__main__.py", "main.py", "cli.py", "setup.py", "conftest.py", "manage.py", "index.js", "index.ts", "main.ts")).select("path")


def dead_dependencies(files: DataFrame, dependencies: DataFrame, known: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """(manifest, ecosystem, package, hits): declared packages that no source file names."""
    wanted = dependencies.withColumn("import", repository.import_name(F.col("package"), F.col("ecosystem"), known))
    sources = files.where(F.col("ext").isin(".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".rs", ".go"))
    words = sources.select("path", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)), F.regexp_extract_all("text", F.lit(r"[\"']([@\w./-]+)[\"']"), F.lit(1))))).alias("import"))
    hits = words.join(wanted.select("import").distinct(), "import", "left_semi").groupBy("import").agg(F.countDistinct("path").alias("hits"))
    counted = wanted.join(hits, "import", "left").fillna(0, ["hits"]).where("hits = 0").drop("import")
    return counted.where(~F.lower("package").isin(list(TOOLS)) & ~F.startswith("package", F.lit("@types/")))


def dead_ci_elements(files: DataFrame, elements: DataFrame) -> DataFrame:
    """(path, kind, name, missing): elements that name paths which are neither file nor folder, also when cut at a star."""
    there = files.select(F.col("path").alias("ref")).union(repository.directories(files).select("path")).distinct()
    refs = elements.select("path", "kind", "name", F.explode(F.array_distinct("paths")).alias("word")).withColumn("ref", F.translate(F.regexp_replace("word", r"^\./", ""), "\\", "/"))
    missing = refs.where("ref <> ''").join(there, "ref", "left_anti")
    cut = missing.withColumn("ref", F.regexp_replace(F.split("ref", r"\*")[0], "/+$", "")).where("ref <> ''").join(there, "ref", "left_anti")
    return cut.groupBy("path", "kind", "name").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("missing"))


def contract_violations(facts: DataFrame) -> DataFrame:
    """(consumer, checked, matched, unmatched, confidence): files whose checked strings are partly produced or defined by others."""
    plausible = (F.length("value") >= SHORT) & ~F.lower("value").isin(list(COMMON)) & F.col("value").rlike(r"^[A-Za-z_][\w-]*$")
    literals = fx.table(facts, "string_literals").where(plausible)
    checked = literals.where((F.col("usage") == "checked") & ~repository.is_test(F.col("path"))).select(F.col("path").alias("consumer"), "value")
    made = literals.where(F.col("usage").isin("produced", "defined")).select("value", F.col("path").alias("producer"))
    return audit.ratio_violations(checked, "consumer", "value", made)


def implicit_contracts(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(value, producer, consumer, n): strings made in one file and checked in another, without a linked definer of both."""
    plausible = (F.length("value") >= SHORT) & ~F.lower("value").isin(list(COMMON)) & F.col("value").rlike(r"^[A-Za-z_][\w-]*$")
    literals = fx.table(facts, "string_literals").where(plausible).where(~repository.is_test(F.col("path")))
    # a row for each value made and checked, with its producers, most occurrences first
    counts = literals.repartition("value").groupBy("value", "usage", "path").agg(F.count("*").alias("n"))
    of = lambda usage, x: F.collect_list(F.when(F.col("usage") == usage, x))
    lists = [F.sort_array(of("produced", F.struct("n", F.col("path").alias("producer"))), asc=False).alias("makers"), of("checked", F.col("path")).alias("consumers"), of("defined", F.col("path")).alias("definers")]
    values = stored(counts.groupBy("value").agg(*lists).where("size(makers) > 0 AND size(consumers) > 0"), "values")
    around = graph.neighbours(graph.both_ways(resolved.where(F.col("target").isNotNull()).select(F.col("path").alias("src"), F.col("target").alias("dst"))))
    shared = values.where(F.size("definers") > 0)

    def near(rows: DataFrame, file: str) -> DataFrame:
        """Rows whose definer is the file, or linked with it within two steps; each pair of files is looked up once."""
        pairs = rows.groupBy(F.col("definer").alias("src"), F.col(file).alias("dst")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        apart = stored(pairs, "asked-pairs")
        return apart.where("src = dst").union(graph.linked(apart.where("src <> dst"), around)).select(F.inline("rows"))

    def robust(made: DataFrame, checked: DataFrame) -> DataFrame:
        """(value, producer, consumer) that a linked definer of both has, of (value, producer) and (value, consumer)."""
        makers = stored(near(made.join(shared.select("value", "definers"), "value").select("value", "producer", F.explode("definers").alias("definer")), "producer"), "linked-producers")
        asked = makers.join(checked, "value").where("producer <> consumer")
        return stored(near(asked.select("value", "producer", "consumer", "definer"), "consumer").select("value", "producer", "consumer").distinct(), "robust")

    # only consumers that are linked with the first producer ask for the others
    first = shared.select("value", F.get("makers", F.lit(0))["producer"].alias("producer"))
    each = values.select("value", "makers", F.explode("consumers").alias("consumer"))
    linked = robust(first, each.select("value", "consumer"))
    own = shared.select("value", F.get("makers", F.lit(0))["producer"].alias("consumer"), "makers", "consumers").where(F.array_contains("consumers", F.col("consumer")) & (F.size("makers") > 1)).select("value", "consumer")
    left = stored(linked.select("value", "consumer").union(own).distinct(), "open-consumers")
    others = shared.join(left.select("value").distinct(), "value", "left_semi").select("value", F.explode(F.slice("makers", F.lit(2), F.size("makers"))).alias("m")).select("value", "m.producer")
    all_linked = linked.union(robust(others, left)).groupBy("value", "consumer").agg(F.collect_set("producer").alias("linked"))
    free = each.select("value", "consumer", F.get(F.filter("makers", lambda x: x["producer"] != F.col("consumer")), F.lit(0)).alias("m")).join(all_linked, ["value", "consumer"], "left_anti")
    bound = all_linked.join(values.select("value", "makers"), "value").select("value", "consumer", F.get(F.filter("makers", lambda x: (x["producer"] != F.col("consumer")) & ~F.array_contains("linked", x["producer"])), F.lit(0)).alias("m"))
    return free.union(bound).where("m IS NOT NULL").select("value", "consumer", "m.producer", "m.n")


def personal_paths(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, hit): every match of every shape on every line."""
    found = [
        lines.explode_lines(files, ["path"]).select("path", "line_no", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("line", F.lit(shape), F.lit(0))).alias("hit"))
        for kind, shape in T.PERSONAL_PATHS.items()
    ]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def stale(files: DataFrame, shadows: DataFrame, impl_hash: str, force: bool = False) -> DataFrame:
    """(path, reason): files whose shadow is missing, of another source (stale) or another engine (stale-impl)."""
    state = shadows.select("path", F.col("source_hash").alias("__s"), F.col("impl_hash").alias("__i"), F.lit(True).alias("__there"))
    reason = F.when(F.col("__there").isNull(), "missing").when(F.lit(force) | ~F.col("source_hash").eqNullSafe(F.col("__s")), "stale").when(~F.col("__i").eqNullSafe(F.lit(impl_hash)), "stale-impl")
    return files.join(state, "path", "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def orphaned_shadows(shadows: DataFrame, files: DataFrame) -> DataFrame:
    """Shadows of files that are gone."""
    return shadows.join(files.select("path"), "path", "left_anti")


def docs_for_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """(doc, line_no, path): the first changed source, in order, that a line of a document names, one for each line."""
    names = changes.select("path", F.explode(F.array_distinct(F.array("path", F.element_at(F.split("path", "/"), -1)))).alias("key"), "ord")
    text = lines.explode_lines(docs, ["path"]).withColumnRenamed("path", "doc")
    words = text.select("doc", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[\w./-]*\w"), F.lit(0)))).alias("key"))
    hits = words.join(names, "key")
    return hits.groupBy("doc", "line_no").agg(F.min_by("path", "ord").alias("path"))
