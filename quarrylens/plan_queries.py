"""The plans' operators bound to a code base that is made from the test tables, each with SQL for another engine.

Every part is a module, every two neighbouring lines of an order an import; names, calls and string literals
follow from the keys. The relations are gathered into facts, so the plans read what they read of a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph
from .plans import claims, concepts, detectors, evaluation, evidence, merging, reports, scorecard, traces
from .plans import facts as fx
from .queries import query, table
from .sources import repository
from .sources.storage import stored

# ---- the code base


def modules(spark, sf_dir) -> DataFrame:
    """(k, g, path) of every part."""
    folder = (F.col("p_size") % 8).cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), folder.alias("g"), F.concat(F.lit("src/pkg"), folder, F.lit("/mod"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))


def import_rows(spark, sf_dir) -> DataFrame:
    """(path, line, source, local, name, s, is_reexport) of every import."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    own, other = modules(spark, sf_dir), modules(spark, sf_dir)
    pairs = rows.join(after, ["l_orderkey", "l_linenumber"]).join(own.select(F.col("k").alias("l_partkey"), "path"), "l_partkey").join(other.select(F.col("k").alias("to"), "g"), "to")
    line, k, s = F.col("l_linenumber"), F.col("to").cast("string"), F.col("l_suppkey")
    inside = lambda a, b: F.concat(F.lit(a), F.col("g"), F.lit(b), k)
    source = F.when(line % 5 == 0, inside("src.pkg", ".mod")).when(line % 5 == 1, inside("pkg", ".mod")).when(line % 5 == 2, inside("../pkg", "/mod")).when(line % 5 == 3, F.concat(F.lit("mod"), k)).otherwise(F.concat(F.lit("ext"), k))
    name = F.concat(F.lit("fn"), F.floor(F.col("to") / 2).cast("string"))
    local = F.when(s % 50 == 1, "*").when(s % 3 == 0, F.concat(F.lit("al"), k)).otherwise(name)
    return pairs.select("path", line.cast("long").alias("line"), source.alias("source"), local.alias("local"), F.when(s % 50 == 1, "*").otherwise(name).alias("name"), s.alias("s"), (s % 7 == 0).alias("is_reexport"))


def literals(spark, sf_dir) -> DataFrame:
    """(path, value, usage) of every line of an order."""
    value = F.concat(F.lit("st"), F.col("l_suppkey").cast("string"), F.lit("_"), (F.col("l_orderkey") % 50).cast("string"))
    usage = F.when(F.col("l_returnflag") == "R", "checked").when(F.col("l_returnflag") == "A", "produced").otherwise("defined")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), value.alias("value"), usage.alias("usage"))
    return rows.join(modules(spark, sf_dir).select("k", "path"), "k").select("path", "value", "usage")


def gathered(rows: DataFrame, name: str, **fields: Column) -> DataFrame:
    return rows.groupBy("path").agg(F.collect_list(F.struct(*(c.alias(n) for n, c in fields.items()))).alias(name))


def facts(spark, sf_dir, *wanted: str) -> DataFrame:
    """The facts with the arrays asked for."""
    out = modules(spark, sf_dir)
    k, text = F.col("k"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    if "exports" in wanted:
        bases = F.when(k % 10 == 5, F.array(F.lit("ext.Base"))).when((k % 5 != 0) & (k > 1), F.array(text("Cls", F.floor(k / 2)))).otherwise(F.array().cast("array<string>"))
        none = F.array().cast("array<string>")

        def export(name: Column, kind: str, line: int, end: int, above: Column = none) -> Column:
            return F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), F.lit(end).alias("line_end"), above.alias("bases"), F.lit(False).alias("exclude_from_dead_analysis"))

        some = F.array(export(text("fn", F.floor(k / 2)), "function", 1, 10), export(text("Cls", k), "class", 20, 40, bases), F.when(k % 3 == 0, export(text("Cls", k, ".run"), "method", 22, 25)), F.when(k % 4 == 0, export(text("Cls", k, ".go"), "method", 26, 30)))
        out = out.withColumn("exports", F.array_compact(some))
    rows = import_rows(spark, sf_dir)
    if "imports" in wanted:
        alias = F.when(F.col("local") != F.col("name"), F.create_map("local", "name"))
        out = out.join(gathered(rows, "imports", source=F.col("source"), names=F.array("local"), name_map=alias, is_reexport=F.col("is_reexport"), line=F.col("line")), "path", "left")
    if "calls" in wanted:
        to = F.when(F.col("s") % 4 == 0, F.concat("local", F.lit(".run"))).otherwise(F.col("local"))
        out = out.join(gathered(rows.where("local <> '*'"), "calls", from_symbol=F.lit("main"), to=to, line=F.col("line")), "path", "left")
    if "member_writes" in wanted:
        out = out.withColumn("member_writes", F.array().cast("array<struct<container:string,member:string,line:bigint>>"))
    if "string_literals" in wanted:
        out = out.join(gathered(literals(spark, sf_dir), "string_literals", value=F.col("value"), usage=F.col("usage")), "path", "left")
    return out.withColumn("classification", F.lit(None).cast("string")).drop("k", "g")


def resolved(spark, sf_dir) -> DataFrame:
    """The imports are stored once: their resolution reads them twice, and what follows from them reads the result of it."""
    return fx.resolved_imports(stored(facts(spark, sf_dir, "imports"), "imports"), modules(spark, sf_dir))


MODULES = "m AS (SELECT p_partkey AS k, (p_size % 8)::VARCHAR AS g, 'src/pkg' || (p_size % 8) || '/mod' || p_partkey || '.py' AS path FROM part)"
IMPORTS = f"""
{MODULES}, i AS (SELECT x.path, a.l_linenumber::BIGINT AS line, a.l_suppkey AS s, a.l_suppkey % 7 = 0 AS is_reexport, CASE WHEN a.l_linenumber % 5 <> 4 THEN y.path END AS target,
CASE a.l_linenumber % 5 WHEN 0 THEN 'src.pkg' || y.g || '.mod' || y.k WHEN 1 THEN 'pkg' || y.g || '.mod' || y.k WHEN 2 THEN '../pkg' || y.g || '/mod' || y.k WHEN 3 THEN 'mod' || y.k ELSE 'ext' || y.k END AS source,
CASE WHEN a.l_suppkey % 50 = 1 THEN '*' ELSE 'fn' || (y.k // 2) END AS name, CASE WHEN a.l_suppkey % 50 = 1 THEN '*' WHEN a.l_suppkey % 3 = 0 THEN 'al' || y.k ELSE 'fn' || (y.k // 2) END AS local
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN m x ON x.k = a.l_partkey JOIN m y ON y.k = b.l_partkey)"""
EXPORTS = """
x AS (SELECT path, 'fn' || (k // 2) AS name FROM m UNION ALL SELECT path, 'Cls' || k FROM m UNION ALL SELECT path, 'Cls' || k || '.run' FROM m WHERE k % 3 = 0 UNION ALL SELECT path, 'Cls' || k || '.go' FROM m WHERE k % 4 = 0)"""
CALLS = "c AS (SELECT path, line, local, CASE WHEN s % 4 = 0 THEN local || '.run' ELSE local END AS \"to\" FROM i WHERE local <> '*')"
USERS = "u AS (SELECT DISTINCT target AS path, path AS importer FROM i WHERE target <> path)"
LITERALS = f"{MODULES}, l AS (SELECT path, 'st' || l_suppkey || '_' || (l_orderkey % 50) AS value, CASE l_returnflag WHEN 'R' THEN 'checked' WHEN 'A' THEN 'produced' ELSE 'defined' END AS usage FROM lineitem JOIN m ON k = l_partkey)"

# ---- questions over facts


@query(f"WITH {IMPORTS} SELECT path, source, target, count(*) AS n FROM i GROUP BY path, source, target")
def import_resolution(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("path", "source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {IMPORTS} SELECT path AS src, target AS dst, array_to_string(list_sort(list(DISTINCT local)), ',') AS names, bool_or(is_reexport) AS is_reexport FROM i WHERE target IS NOT NULL GROUP BY path, target")
def import_graph(spark, sf_dir):
    return fx.import_edges(resolved(spark, sf_dir))


@query(f"WITH {IMPORTS}, {USERS} SELECT path, importer FROM u")
def module_importers(spark, sf_dir):
    return fx.importers(resolved(spark, sf_dir), facts(spark, sf_dir))


@query(f"WITH {IMPORTS}, {EXPORTS} SELECT DISTINCT path, name FROM x WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.target = x.path AND (i.name = x.name OR i.name = '*'))")
def module_unused_exports(spark, sf_dir):
    return fx.unused_exports(facts(spark, sf_dir, "exports"), resolved(spark, sf_dir))


@query(f"WITH {MODULES}, {EXPORTS} SELECT name, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM x GROUP BY name")
def name_definers(spark, sf_dir):
    return fx.definers(facts(spark, sf_dir, "exports")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"))


@query(f"""
WITH {IMPORTS}, {EXPORTS}, {CALLS}, {USERS}, d AS (SELECT DISTINCT x.path, x.name, c.path AS ref_path, c.line FROM x JOIN c ON c."to" = x.name AND c.path <> x.path),
h AS (SELECT DISTINCT x.path, x.name, i.path AS ref_path, 'import' AS kind, line FROM x JOIN i ON i.name = x.name AND i.target IS NOT NULL AND i.path <> x.path
UNION SELECT path, name, ref_path, 'call', line FROM d UNION SELECT a.path, a.name, b.path, 'export', CASE WHEN a.name LIKE 'fn%' THEN 1 ELSE 20 END FROM x a JOIN x b ON a.name = b.name AND a.path <> b.path
UNION SELECT x.path, x.name, c.path, 'dispatch', c.line FROM x JOIN u ON u.path = x.path JOIN c ON c.path = u.importer AND c."to" LIKE '%.run' WHERE x.name LIKE '%.run' AND NOT EXISTS (SELECT 1 FROM d WHERE d.path = x.path AND d.name = x.name AND d.ref_path = c.path))
SELECT path, name, kind, count(*) AS n, count(DISTINCT ref_path) AS files FROM h GROUP BY path, name, kind""")
def symbol_references(spark, sf_dir):
    known = stored(facts(spark, sf_dir, "exports", "imports", "calls", "member_writes"), "known-facts")
    found = fx.cross_references(known, stored(fx.resolved_imports(known, modules(spark, sf_dir)), "resolved"), detectors.symbols(known))
    return found.groupBy("path", "name", "kind").agg(F.count("*").alias("n"), F.countDistinct("ref_path").alias("files"))


@query(f"""
WITH {IMPORTS}, {CALLS}, n AS (SELECT c.path, c."to", i.target AS definer, i.name || substr(c."to", length(c.local) + 1) AS name FROM c JOIN i ON c.path = i.path AND c.local = i.local AND i.target IS NOT NULL)
SELECT DISTINCT n.path, n."to", definer, n.name, call_sites FROM n JOIN (SELECT definer, name, count(*) AS call_sites FROM n GROUP BY definer, name) USING (definer, name)""")
def call_resolution(spark, sf_dir):
    return fx.call_sites(facts(spark, sf_dir, "calls"), resolved(spark, sf_dir))


@query(f"WITH {IMPORTS}, {EXPORTS}, {USERS} SELECT path, (SELECT count(*) FROM x WHERE x.path = m.path)::INTEGER AS exports, (SELECT count(*) FROM u WHERE u.path = m.path) AS fan_in FROM m")
def module_fan_in(spark, sf_dir):
    return fx.fan_in(facts(spark, sf_dir, "exports"), resolved(spark, sf_dir))


@query(f"WITH {IMPORTS}, {USERS} SELECT path FROM m WHERE path NOT IN (SELECT path FROM u WHERE importer NOT LIKE 'src/pkg0/%')")
def parsed_importers_only(spark, sf_dir):
    known = facts(spark, sf_dir)
    return fx.only_parsed_importers(known, resolved(spark, sf_dir), known.where("path LIKE 'src/pkg0/%'"))


@query(f"WITH {LITERALS} SELECT DISTINCT path, value FROM l WHERE usage = 'checked'")
def checked_strings(spark, sf_dir):
    return fx.strings_by_usage(facts(spark, sf_dir, "string_literals"), "checked")


@query(f"WITH {IMPORTS}, {CALLS} SELECT path, \"to\", line, count(*) AS n FROM c WHERE path = (SELECT min(path) FROM c) AND line BETWEEN 1 AND 3 GROUP BY ALL")
def file_callees(spark, sf_dir):
    known = facts(spark, sf_dir, "calls")
    first = known.where("calls IS NOT NULL").agg(F.min("path")).head()[0]
    return fx.callees(known, first, "main", (1, 3)).groupBy("path", "to", "line").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source AS path, 'docs/' || doc_id || '.md' AS doc FROM documents")
def sources_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("classification"), F.array(F.struct("source")).alias("imports"))
    return fx.docs_referencing(docs)


# ---- detectors


@query(f"""
WITH RECURSIVE {MODULES}, b AS (SELECT 'Cls' || k AS cls, CASE WHEN k % 10 = 5 THEN 'Base' ELSE 'Cls' || (k // 2) END AS base FROM m WHERE k % 10 = 5 OR (k % 5 <> 0 AND k > 1)),
up(cls, base) AS (SELECT cls, base FROM b UNION SELECT up.cls, b.base FROM up JOIN b ON up.base = b.cls),
t AS (SELECT path, 'Cls' || k AS cls, 'run' AS method FROM m WHERE k % 3 = 0 UNION ALL SELECT path, 'Cls' || k, 'go' FROM m WHERE k % 4 = 0)
SELECT DISTINCT path, t.cls || '.' || method AS name FROM t JOIN up USING (cls) WHERE EXISTS (SELECT 1 FROM t o WHERE o.cls = up.base AND o.method = t.method) OR up.base NOT IN (SELECT 'Cls' || k FROM m)""")
def inherited_methods(spark, sf_dir):
    return detectors.implemented_methods(facts(spark, sf_dir, "exports"))


@query(f"""
WITH {LITERALS}, c AS (SELECT DISTINCT path, value FROM l WHERE usage = 'checked'), p AS (SELECT value, count(DISTINCT path) AS makers, min(path) AS one FROM l WHERE usage <> 'checked' GROUP BY value),
n AS (SELECT path AS consumer, count(*) AS checked, count(*) FILTER (WHERE makers > 1 OR one <> path) AS matched FROM c LEFT JOIN p USING (value) GROUP BY path)
SELECT consumer, checked, matched, checked - matched AS unmatched, round(matched::DOUBLE / checked, 2) AS confidence FROM n WHERE matched > 0 AND checked > matched""")
def string_contracts(spark, sf_dir):
    return detectors.contract_violations(facts(spark, sf_dir, "string_literals"))


@query(f"""
WITH {IMPORTS}, {LITERALS.split(", l AS", 1)[1].join(["l AS", ""])}, g AS (SELECT path AS src, target AS dst FROM i WHERE target IS NOT NULL UNION SELECT target, path FROM i WHERE target IS NOT NULL),
mk AS (SELECT value, path AS producer, count(*) AS n FROM l WHERE usage = 'produced' GROUP BY value, path), ck AS (SELECT DISTINCT value, path AS consumer FROM l WHERE usage = 'checked'),
df AS (SELECT DISTINCT value, path AS definer FROM l WHERE usage = 'defined'), q AS (SELECT * FROM mk JOIN ck USING (value) WHERE producer <> consumer),
e AS (SELECT definer AS a, producer AS b FROM q JOIN df USING (value) UNION SELECT definer, consumer FROM q JOIN df USING (value)),
near AS (SELECT a, b FROM e WHERE a = b UNION SELECT a, b FROM e JOIN g ON a = src AND b = dst UNION SELECT a, b FROM e JOIN g ON a = g.src JOIN g h ON g.dst = h.src AND h.dst = b),
ok AS (SELECT DISTINCT value, producer, consumer FROM q JOIN df USING (value) JOIN near x ON x.a = definer AND x.b = producer JOIN near y ON y.a = definer AND y.b = consumer)
SELECT value, consumer, arg_max(producer, (n, producer)) AS producer, max(n) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.value = q.value AND ok.producer = q.producer AND ok.consumer = q.consumer) GROUP BY value, consumer""")
def hidden_contracts(spark, sf_dir):
    known = facts(spark, sf_dir, "string_literals")
    return detectors.implicit_contracts(known, resolved(spark, sf_dir))


HASH = "substr(sha256(coalesce(text, '')), 1, 16)"


def shadows(spark, sf_dir) -> DataFrame:
    """What was documented earlier: another language's documents are missing, long ones have changed, some were made by another engine."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'es'")
    return docs.select(F.col("doc_id").alias("path"), F.when(F.col("n_chars") > 1000, "old").otherwise(T.hash16(F.coalesce("text", F.lit("")))).alias("source_hash"), F.when(F.col("source") < "src3", "v1").otherwise("v2").alias("impl_hash"))


@query(f"""
SELECT doc_id AS path, CASE WHEN lang = 'es' THEN 'missing' WHEN n_chars > 1000 THEN 'stale' ELSE 'stale-impl' END AS reason FROM documents WHERE lang = 'es' OR n_chars > 1000 OR source < 'src3'""")
def stale_documents(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), T.hash16(F.coalesce("text", F.lit(""))).alias("source_hash"))
    return detectors.stale(files, shadows(spark, sf_dir), "v2")


@query("SELECT doc_id AS path FROM documents WHERE lang <> 'es' AND n_chars <= 300")
def shadows_without_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").alias("path"))
    return detectors.orphaned_shadows(shadows(spark, sf_dir), files).select("path")


@query("""
WITH w AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]+') AS package FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS package FROM documents)
SELECT 'requirements.txt' AS manifest, 'python' AS ecosystem, package, 0::BIGINT AS hits FROM w WHERE package NOT IN (SELECT package FROM d)""")
def unnamed_dependencies(spark, sf_dir):
    """First words of the benchmark's items as packages; documents as sources."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", F.lit(".py").alias("ext"))
    wanted = table(spark, sf_dir, "benchmark").select(F.lit("requirements.txt").alias("manifest"), F.lit("python").alias("ecosystem"), F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("package")).distinct()
    return detectors.dead_dependencies(files, wanted)


#: Paths with the customer's name in the place of a person's: kind, how it begins, how it ends.
PLACES = [("windows_user", "C:\\Users\\", "\\notes"), ("unix_home", "see /home/", "/.config"), ("cloud_storage", "under \\OneDrive\\", "\\x"), ("dated_folder", "in /240131 ", "/old"), ("personal_folder", "on /desktop/", "/y"), ("my_folder", "at /My ", "/z"), ("none", "from /home/test/", "x")]
PLACED = "SELECT p.*, replace(c_name, '#', '_') AS who, upper(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) AS word, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS plain, c_custkey FROM customer, p"


@query(f"""
WITH p(kind, a, z) AS (VALUES {", ".join(f"('{k}', '{a}', '{z}')" for k, a, z in PLACES)}), t AS (SELECT c_custkey AS path, kind, a, z, CASE kind WHEN 'dated_folder' THEN word WHEN 'my_folder' THEN plain ELSE who END AS own FROM ({PLACED}))
SELECT path, CASE kind WHEN 'windows_user' THEN 1 WHEN 'unix_home' THEN 2 WHEN 'cloud_storage' THEN 3 WHEN 'dated_folder' THEN 4 WHEN 'personal_folder' THEN 5 ELSE 6 END AS line_no, kind, regexp_replace(a, '^[^C/\\\\]*', '') || own || z[1] AS hit FROM t WHERE kind <> 'none'""")
def personal_path_kinds(spark, sf_dir):
    """Six lines for each customer, a path of each kind, and one that gives nobody away."""
    name = F.translate("c_name", "#", "_")
    own = {"dated_folder": F.upper(F.regexp_replace("c_name", "[^A-Za-z]", "")), "my_folder": F.regexp_replace("c_name", "[^A-Za-z0-9]", "")}
    text = F.concat_ws("\n", *(F.concat(F.lit(a), own.get(kind, name), F.lit(z)) for kind, a, z in PLACES))
    return detectors.personal_paths(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), text.alias("text")))


# ---- merging, claims, evidence


@query("""
WITH s AS (SELECT DISTINCT 'item' || item_id AS path, regexp_extract(text, '[A-Za-z]{6,}') AS name FROM benchmark), w AS (SELECT DISTINCT doc_id::VARCHAR AS path, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS name FROM documents),
h AS (SELECT w.path AS src, s.path AS dst FROM w JOIN s USING (name)) SELECT src, dst FROM h UNION SELECT dst, src FROM h""")
def cooccurrences(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("path"), F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("name"))
    return merging.cooccurrence_edges(files, names)


@query(f"""
WITH {IMPORTS}, {EXPORTS}, {CALLS}, r AS (SELECT DISTINCT "to" AS name, path AS file, line FROM c UNION SELECT 'run', path, line FROM c WHERE "to" LIKE '%.run')
SELECT name, count(*) AS n FROM (SELECT DISTINCT x.name, file, line FROM (SELECT DISTINCT name FROM x WHERE name LIKE 'fn%') x JOIN r ON r.name = x.name) GROUP BY name""")
def merged_references(spark, sf_dir):
    known = facts(spark, sf_dir, "exports", "calls")
    calls = fx.table(known, "calls").select(F.col("to").alias("name"), F.col("path").alias("file"), "line")
    names = fx.definers(known).where("name LIKE 'fn%'").select("name").distinct()
    return merging.with_bare_names(calls, names).groupBy("name").agg(F.count("*").alias("n"))


@query("""
SELECT lang AS producer, source AS consumer, array_to_string(list_sort(list(DISTINCT length(text) % 10)), ',') AS "values", count(*) AS n, CASE WHEN count(*) = 1 THEN 0.4 ELSE least(0.9, 0.5 + 0.1 * count(*))::DOUBLE END AS confidence FROM documents GROUP BY lang, source""")
def contract_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("producer"), F.col("source").alias("consumer"), (F.length("text") % 10).cast("string").alias("value"), F.lit(0.4).alias("confidence"))
    return merging.grouped_contracts(rows).select("producer", "consumer", F.array_join("values", ",").alias("values"), "n", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {MODULES} SELECT a.path, CASE WHEN a.k = b.k THEN a.path WHEN a.g = b.g THEN 'src/pkg' || a.g ELSE 'src' END AS folder, CASE WHEN a.k = b.k THEN 3 WHEN a.g = b.g THEN 2 ELSE 1 END AS shared, CASE WHEN a.k = b.k THEN 'file' WHEN a.g = b.g THEN 'folder' ELSE 'project' END AS scope FROM m a JOIN m b ON b.k = a.k // 2 + 1")
def path_relations(spark, sf_dir):
    """What a module's path shares with that of the module of half its number."""
    own = modules(spark, sf_dir)
    other = own.select(F.col("k").alias("half"), F.col("path").alias("other"))
    rows = own.withColumn("half", (F.floor(F.col("k") / 2) + 1).cast("long")).join(other, "half")
    a, b = F.col("path"), F.col("other")
    return rows.select("path", merging.common_folder(a, b).alias("folder"), evidence.shared_prefix(a, b).cast("int").alias("shared"), evidence.scope(F.array(a, b)).alias("scope"))


@query("""
SELECT t.name, first(d.doc_id ORDER BY d.doc_id)::VARCHAR AS path, array_to_string(string_split(first(d.text ORDER BY d.doc_id), chr(10))[1:2], chr(10)) AS snippet FROM (SELECT DISTINCT source AS name FROM documents) t JOIN documents d ON d.source = t.name GROUP BY t.name""")
def type_definitions(spark, sf_dir):
    """The first document of each source as the definition of a type of two lines."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("%012d", "doc_id").alias("path"), "source", "text")
    symbols = docs.select(F.col("source").alias("name"), "path", F.lit("class").alias("kind"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    return merging.types_of(docs.select(F.col("source").alias("name")), symbols, docs).select("name", F.regexp_replace("path", "^0+(?=.)", "").alias("path"), "snippet")


def findings(spark, sf_dir) -> DataFrame:
    """Labelled documents as findings."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    message = F.concat(F.lit("[AST] L"), F.col("n_chars").cast("string"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(":  `"), F.col("lang"), F.lit("."), F.col("source"), F.lit("()` and 'toxic "), F.col("toxic").cast("string"), F.lit("' "))
    return docs.select("doc_id", "lang", "source", "n_chars", "quality", "toxic", message.alias("message"))


FINDINGS = "f AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query(f"""
WITH {FINDINGS} SELECT doc_id, substr(sha256('["detector:x", "' || lang || '/' || source || '", ' || CASE WHEN quality = 1 THEN 'null' ELSE '"q\\"' || doc_id || '"' END || ']'), 1, 16) AS id,
'`' || lang || '.' || source || '()` and ''toxic ' || toxic || '''' AS core, lang || '/' || source AS path FROM f""")
def finding_identities(spark, sf_dir):
    rows = findings(spark, sf_dir).withColumn("raw", F.concat(F.lit("./"), "lang", F.lit("\\"), "source"))
    path = T.normal_path(F.col("raw"))
    symbol = F.when(F.col("quality") == 1, F.lit(None)).otherwise(F.concat(F.lit('q"'), F.col("doc_id").cast("string")))
    return rows.select("doc_id", claims.finding_id(F.lit("detector:x"), path, symbol).alias("id"), T.message_core(F.col("message")).alias("core"), path.alias("path"))


@query(f"WITH {FINDINGS} SELECT doc_id, array_to_string(list_sort([lang || '.' || source, source]), ',') AS named, 'toxic ' || toxic AS quoted FROM f")
def cited_names(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return rows.select("doc_id", F.array_join(F.array_sort(evidence.backticked(F.col("message"))), ",").alias("named"), F.array_join(evidence.quoted_literals(F.col("message")), ",").alias("quoted"))


@query("SELECT l_orderkey AS id, substr(sha256(array_to_string(list_sort(list('{\"part\":' || l_partkey || '}')), chr(10))), 1, 16) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def evidence_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.to_json(F.struct(F.col("l_partkey").alias("part"))).alias("doc"))
    return rows.groupBy("id").agg(F.collect_list("doc").alias("evidence")).select("id", claims.fingerprint(F.col("evidence")).alias("fingerprint"))


@query(f"""
WITH {FINDINGS}, v AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN NULL WHEN quality = 1 THEN CASE WHEN source = 'src1' THEN 'uncertain' ELSE 'confirmed' END ELSE CASE WHEN source = 'src2' THEN 'uncertain' ELSE 'dismissed' END END AS verdict, toxic FROM f)
SELECT doc_id, verdict, CASE WHEN verdict = 'uncertain' THEN 'warning' WHEN verdict IS NOT NULL AND toxic = 1 THEN 'info' ELSE 'error' END AS severity FROM v WHERE verdict IS DISTINCT FROM 'dismissed'""")
def overlaid_verdicts(spark, sf_dir):
    """Verdicts on the same evidence count, contradicted ones are uncertain, dismissed ones go."""
    rows = findings(spark, sf_dir)
    claimed = rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("fingerprint"), F.lit("error").alias("severity"))
    verdict = F.when(F.col("quality") == 1, "confirmed").otherwise("dismissed")
    against = F.when((F.col("quality") == 1) & (F.col("source") == "src1"), "So I dismiss it.").when((F.col("quality") != 1) & (F.col("source") == "src2"), "It is confirmed!").when(F.col("quality") == 1, "I would not dismiss it.").otherwise("I cannot confirm it.")
    known = rows.select(F.col("doc_id").alias("finding_id"), F.when(F.col("n_chars") > 2000, "changed").otherwise(F.col("lang")).alias("fingerprint"), verdict.alias("verdict"), F.lit(0.9).alias("confidence"), F.when(F.col("toxic") == 1, "info").alias("severity"), F.concat(F.lit("Looked at. It was dismissed and confirmed before. "), against).alias("reasoning"))
    return claims.overlay(claims.decided(claimed, known)).select(F.col("id").alias("doc_id"), "verdict", "severity")


# ---- scorecards, concepts


def covering(spark, sf_dir) -> DataFrame:
    """Labelled documents as documentation: findings by toxicity, matched sources by quality."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    severity = F.when(F.col("toxic") == 1, "error").otherwise("warning")
    return rows.select(F.col("doc_id").alias("path"), F.when(F.col("lang") == "en", "process_artifact").otherwise(F.col("lang")).alias("classification"), F.when(F.col("quality") == 1, F.array("source")).otherwise(F.array().cast("array<string>")).alias("matched"), F.array(F.struct(severity.alias("severity"))).alias("findings"))


@query("SELECT CASE WHEN lang = 'en' THEN 'process_artifact' ELSE lang END AS classification, count(*) AS docs, round(count(*) FILTER (WHERE quality = 1) * 100.0 / count(*), 6)::DOUBLE AS pct FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def coverage_by_type(spark, sf_dir):
    return scorecard.coverage_by_type(covering(spark, sf_dir)).select("classification", "docs", F.round(F.col("pct").cast("double"), 6).alias("pct"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS errors, count(*) AS docs, round(count(*) FILTER (WHERE toxic = 1) / count(*)::DOUBLE, 9) AS per_doc FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en'")
def documentation_errors(spark, sf_dir):
    return scorecard.accuracy(covering(spark, sf_dir)).select("errors", "docs", F.round("per_doc", 9).alias("per_doc"))


@query("""
WITH t AS (SELECT sum(length(coalesce(text, '')) // 4)::BIGINT AS a, sum(length(regexp_replace(coalesce(text, ''), '[aeiou]', '', 'g')) // 4)::BIGINT AS b FROM documents)
SELECT a AS source_tokens, b AS shadow_tokens, round(1 - b::DOUBLE / a, 4) AS compression, round((1 - b::DOUBLE / a) * 100, 6) AS savings FROM t""")
def bundle_tokens(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(T.token_estimate(text).alias("source_tokens"), T.token_estimate(F.regexp_replace(text, "[aeiou]", "")).alias("shadow_tokens"))
    return scorecard.token_totals(rows).withColumn("savings", F.round("savings", 6))


@query("""
WITH n AS (SELECT 'src/pkg' || (p_size % 8) AS folder, p_size::BIGINT AS lines, CASE WHEN p_size > 5 THEN p_retailprice / 4000 END AS health FROM part), a AS (SELECT folder, lines, health FROM n UNION ALL SELECT 'src', lines, health FROM n UNION ALL SELECT '', lines, health FROM n)
SELECT folder AS path, count(*) AS files, sum(lines)::BIGINT AS lines, round(sum(lines * health) / sum(lines) FILTER (WHERE health IS NOT NULL), 6) AS health FROM a GROUP BY folder""")
def folder_rollup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/pkg"), (F.col("p_size") % 8).cast("string")).alias("parent"), F.col("p_size").cast("long").alias("lines"), F.when(F.col("p_size") > 5, F.col("p_retailprice") / 4000).alias("health"))
    files = repository.path_columns(modules(spark, sf_dir).select("path"))
    return scorecard.folder_nodes(parts, repository.directories(files)).withColumn("health", F.round("health", 6))


@query(f"""
WITH {MODULES}, f AS (SELECT 'src/pkg' || g AS path, 'pkg' || g AS name, substr(sha256(string_agg('mod' || k || '.py:' || substr(sha256(path), 1, 16), chr(10) ORDER BY 'mod' || k || '.py:' || substr(sha256(path), 1, 16))), 1, 16) AS digest FROM m GROUP BY g),
s AS (SELECT 'src' AS path, substr(sha256(string_agg(name || ':' || digest, chr(10) ORDER BY name || ':' || digest)), 1, 16) AS digest FROM f)
SELECT path, digest FROM f UNION ALL SELECT path, digest FROM s UNION ALL SELECT '', substr(sha256('src:' || digest), 1, 16) FROM s""")
def folder_digests(spark, sf_dir):
    files = repository.path_columns(modules(spark, sf_dir).select("path", T.hash16(F.col("path")).alias("source_hash")))
    return scorecard.folder_hashes(files).select("path", "digest")


@query(f"WITH {MODULES} SELECT 'src/pkg' || g AS path, 'src' AS parent, 2 AS depth, count(*) AS files FROM m GROUP BY g UNION ALL SELECT 'src', '', 1, 0 UNION ALL SELECT '', NULL, 0, 0")
def folders(spark, sf_dir):
    files = repository.path_columns(modules(spark, sf_dir).select("path"))
    own = repository.directories(files)
    direct = repository.children(own, files.select("path", "parent")).groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("files"))
    return own.join(direct, "path", "left").fillna(0, ["files"])


def concept_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers as concepts with their parts as files; orders as documents of a type by their priority that match their parts."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    owned = rows.groupBy(F.col("l_suppkey").alias("concept_id")).agg(F.collect_set("l_partkey").alias("source_files"))
    wanted = F.when(F.col("concept_id") % 2 == 0, F.array(F.lit("1-URGENT"), F.lit("tutorial"))).otherwise(F.array(F.lit("2-HIGH"), F.lit("5-LOW"), F.lit("tutorial")))
    docs = rows.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("matched")).join(table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("classification")), "l_orderkey")
    return owned.withColumn("appropriate_types", wanted), docs.select(F.col("l_orderkey").alias("path"), "classification", "matched")


CONCEPTS = """
o AS (SELECT DISTINCT l_suppkey AS concept_id, l_partkey AS source FROM lineitem), h AS (SELECT DISTINCT l_partkey AS source, o_orderpriority AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'),
v AS (SELECT DISTINCT concept_id, type FROM o JOIN h USING (source)), k AS (SELECT DISTINCT concept_id FROM o),
w AS (SELECT concept_id, unnest(CASE WHEN concept_id % 2 = 0 THEN ['1-URGENT', 'tutorial'] ELSE ['2-HIGH', '5-LOW', 'tutorial'] END) AS type FROM k)"""


@query(f"WITH {CONCEPTS} SELECT k.concept_id, coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM v WHERE v.concept_id = k.concept_id), '') AS covered, coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM w WHERE w.concept_id = k.concept_id AND NOT EXISTS (SELECT 1 FROM v WHERE v.concept_id = w.concept_id AND v.type = w.type)), '') AS missing FROM k")
def concept_coverage(spark, sf_dir):
    return concepts.coverage(*concept_rows(spark, sf_dir)).select("concept_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"))


@query(f"WITH {CONCEPTS} SELECT type, count(*) AS needed, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v WHERE v.concept_id = w.concept_id AND v.type = w.type)) AS have FROM w GROUP BY type")
def coverage_summary(spark, sf_dir):
    return concepts.summary(concepts.coverage(*concept_rows(spark, sf_dir)))


@query("""
WITH c AS (SELECT user_id, event_type FROM events), n AS (SELECT user_id % 20 AS leader, count(DISTINCT user_id) AS n FROM c GROUP BY 1),
e AS (SELECT user_id % 20 AS leader, event_type, count(DISTINCT user_id) AS c FROM c GROUP BY 1, 2) SELECT leader, string_agg(event_type, ',' ORDER BY event_type) AS shared FROM e JOIN n USING (leader) WHERE c = n GROUP BY leader""")
def shared_gaps(spark, sf_dir):
    """Users in twenty clusters; the event types that all of a cluster have."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("missing")).select((F.col("user_id") % 20).alias("leader"), "missing")
    return concepts.shared_gaps(rows).select("leader", F.array_join("shared", ",").alias("shared"))


# ---- traces, evaluation


def trace_events(spark, sf_dir) -> DataFrame:
    """Users' events as traces."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string")).alias("category"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.concat("event_type", F.when(F.col("value") > 100, "+").otherwise("-")).alias("kind"))


@query("""
WITH t AS (SELECT 'c' || user_id % 6 AS category, user_id, count(*) AS calls FROM events GROUP BY user_id)
SELECT category, count(*) AS traces, round(avg(calls), 6) AS calls_mean, median(calls)::DOUBLE AS calls_median, max(calls) AS calls_max FROM t GROUP BY category""")
def trace_distributions(spark, sf_dir):
    found = traces.distributions(trace_events(spark, sf_dir))
    return found.select("category", "traces", F.round("calls_mean", 6).alias("calls_mean"), "calls_median", "calls_max")


@query("""
WITH e AS (SELECT 'c' || user_id % 6 AS category, user_id, event_type || CASE WHEN value > 100 THEN '+' ELSE '-' END AS kind FROM events), n AS (SELECT category, count(DISTINCT user_id) AS n FROM e GROUP BY category),
r AS (SELECT category, kind, count(DISTINCT user_id)::DOUBLE / n AS rate FROM e JOIN n USING (category) GROUP BY category, kind, n) SELECT category, kind, CASE WHEN rate >= 0.7 THEN 'required' ELSE 'optional' END AS tier FROM r WHERE rate >= 0.3""")
def evidence_proposal(spark, sf_dir):
    return traces.proposal(traces.presence(trace_events(spark, sf_dir)))


@query("""
SELECT doc_id, CASE WHEN contains(p, lang) THEN 'needle' WHEN regexp_matches(p, '\\b(?:def|class|function|interface|struct)\\b') THEN 'definition' WHEN regexp_matches(p, '\\b(?:import|require|from)\\b') THEN 'import' ELSE 'other' END AS kind
FROM (SELECT doc_id, lang, substr(coalesce(text, ''), 1, 200) AS p FROM documents)""")
def search_kinds(spark, sf_dir):
    """What a search for the beginning of each document would be for."""
    pattern = F.substring(F.coalesce("text", F.lit("")), 1, 200)
    return table(spark, sf_dir, "documents").select("doc_id", traces.search_kind(pattern, F.array("lang")).alias("kind"))


def cases(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("slug"), F.col("lang").alias("category"), F.when(F.col("quality") == 1, "confirmed").otherwise("dismissed").alias("expected"), (F.col("toxic") == 1).alias("gray"), "n_chars")


@query("""
WITH c AS (SELECT doc_id AS slug, lang AS category, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'dismissed' END AS expected, n_chars FROM documents JOIN labels USING (doc_id)), p(variant, repeat) AS (VALUES ('a', 0), ('a', 1), ('b', 0), ('b', 1)),
r AS (SELECT variant, repeat, category, CASE WHEN variant = 'b' AND repeat = 1 AND n_chars < 500 THEN NULL WHEN n_chars > 800 + 100 * repeat THEN 'confirmed' ELSE 'dismissed' END AS verdict, expected FROM c, p)
SELECT variant, repeat, category, count(*) AS n, count(*) FILTER (WHERE verdict = expected) AS right_, count(*) FILTER (WHERE verdict IS NULL) AS undecided FROM r GROUP BY ALL""")
def evaluation_runs(spark, sf_dir):
    """Two variants, two repeats; the verdict depends on the length, and one run leaves short cases undecided."""
    rows = cases(spark, sf_dir)
    runs = [rows.select("slug", F.lit(v).alias("variant"), F.lit(k).alias("repeat"), F.when(F.col("n_chars") > 800 + 100 * k, "confirmed").otherwise("dismissed").alias("verdict"), F.lit(0.5).alias("confidence"), "n_chars") for v in ("a", "b") for k in (0, 1)]
    given = runs[0].union(runs[1]).union(runs[2]).union(runs[3].where("n_chars >= 500")).drop("n_chars")
    found = evaluation.runs(rows, ["a", "b"], 2, given)
    return found.groupBy("variant", "repeat", "category").agg(F.count("*").alias("n"), F.count_if("correct").alias("right_"), F.count_if(F.col("verdict").isNull()).alias("undecided"))


@query("""
WITH a AS (SELECT doc_id AS id, CASE WHEN n_chars > 800 THEN 'confirmed' ELSE 'dismissed' END AS old FROM documents WHERE lang <> 'fr'), b AS (SELECT doc_id AS id, CASE WHEN n_chars > 700 THEN 'confirmed' ELSE 'dismissed' END AS new, CASE WHEN source < 'src4' THEN 'info' ELSE 'error' END AS now FROM documents WHERE lang <> 'de')
SELECT id, old, new, CASE WHEN old IS NOT DISTINCT FROM new THEN 'same' WHEN old = 'dismissed' AND new = 'confirmed' AND now = 'info' THEN 'confirmed_as_info' ELSE 'changed' END AS kind FROM a FULL JOIN b USING (id)""")
def compared_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    verdict = lambda n: F.when(F.col("n_chars") > n, "confirmed").otherwise("dismissed").alias("verdict")
    old = rows.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), verdict(800), F.lit("error").alias("severity"))
    new = rows.where("lang <> 'de'").select(F.col("doc_id").alias("id"), verdict(700), F.when(F.col("source") < "src4", "info").otherwise("error").alias("severity"))
    return evaluation.compared(old, new)


@query("""
WITH c AS (SELECT l_orderkey AS id, 'k' || l_suppkey % 9 AS kind, o_orderpriority AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT category, id, count(DISTINCT kind) AS kinds FROM c GROUP BY ALL),
s AS (SELECT category, count(*) AS claims, round(count(*) FILTER (WHERE kinds < 3) / count(*)::DOUBLE, 9) AS insufficient_rate FROM n GROUP BY category) SELECT category, claims, insufficient_rate, kind, count(DISTINCT id) AS filled FROM s JOIN c USING (category) GROUP BY ALL""")
def evidence_fill(spark, sf_dir):
    """Orders as claims, suppliers' groups as kinds of evidence."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("k"), (F.col("l_suppkey") % 9).cast("string")).alias("kind"))
    claimed = rows.groupBy("l_orderkey").agg(F.collect_set("kind").alias("evidence_kinds")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("category")), "l_orderkey")
    return evaluation.fill_matrix(claimed.withColumn("insufficient", F.size("evidence_kinds") < 3)).withColumn("insufficient_rate", F.round("insufficient_rate", 9))


@query("""
WITH c AS (SELECT doc_id AS slug FROM documents JOIN labels USING (doc_id)), s AS (SELECT doc_id AS slug FROM documents WHERE lang = 'en')
SELECT (SELECT count(*) FROM c) AS cases, (SELECT count(*) FROM c WHERE slug NOT IN (SELECT slug FROM s)) + (SELECT count(*) FROM s WHERE slug NOT IN (SELECT slug FROM c)) AS problems, false AS passed""")
def corpus_gate(spark, sf_dir):
    splits = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("slug"), F.lit("dev").alias("split"))
    return evaluation.gate(cases(spark, sf_dir).select("slug"), splits, 10)


# ---- predicates on paths


@query(f"""
WITH {MODULES}, p AS (SELECT k, CASE k % 6 WHEN 0 THEN 'tests/mod' || k || '.py' WHEN 1 THEN 'src/test_' || k || '.py' WHEN 2 THEN 'testing/x' || k || '.py' WHEN 3 THEN 'docs/page' || k || '.rst' WHEN 4 THEN 'node_modules/a/' || k || '.js' ELSE 'img/.env.' || k END AS path FROM m)
SELECT path, k % 6 IN (0, 1) AS test, k % 6 IN (0, 1, 2) AS loosely, k % 6 = 3 AS doc, k % 6 <> 4 AS checkable, CASE k % 6 WHEN 3 THEN 'Docs_Page' || k ELSE NULL END AS import_name FROM p""")
def path_predicates(spark, sf_dir):
    k = F.col("k")
    text = lambda a, b="": F.concat(F.lit(a), k.cast("string"), F.lit(b))
    path = F.when(k % 6 == 0, text("tests/mod", ".py")).when(k % 6 == 1, text("src/test_", ".py")).when(k % 6 == 2, text("testing/x", ".py")).when(k % 6 == 3, text("docs/page", ".rst")).when(k % 6 == 4, text("node_modules/a/", ".js")).otherwise(text("img/.env."))
    rows = modules(spark, sf_dir).select("k", path.alias("path"))
    p = F.col("path")
    name = F.when(k % 6 == 3, repository.import_name(text("Docs-Page"), F.lit("rust")))
    return rows.select("path", repository.is_test(p).alias("test"), repository.is_test_loosely(p).alias("loosely"), repository.is_doc(p, [".md", ".rst"], ["README"], ["docs"]).alias("doc"), merging.checkable(p).alias("checkable"), name.alias("import_name"))


@query("""
WITH RECURSIVE p AS (SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id), e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(node, root) AS (SELECT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x) SELECT node, min(root) AS component FROM r GROUP BY node""")
def linked_events(spark, sf_dir):
    """Components of events that share user and type: the least of each group."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = rows.groupBy("user_id", "event_type").agg(F.min("event_id").alias("dst"))
    return graph.components(rows.join(first, ["user_id", "event_type"]).where("event_id <> dst").select(F.col("event_id").alias("src"), "dst"))


# ---- reports


@query(f"WITH {IMPORTS}, {EXPORTS} SELECT path, (SELECT count(*) FROM i WHERE i.path = m.path) AS imports, (SELECT count(*) FROM x WHERE x.path = m.path) AS exports FROM m")
def module_summary(spark, sf_dir):
    known = facts(spark, sf_dir, "exports", "imports")
    return reports.file_summary({"imports": fx.table(known, "imports"), "exports": fx.table(known, "exports")}, known)


@query("""
WITH e AS (SELECT user_id::VARCHAR || CASE WHEN value > 150 THEN '' ELSE ':' || event_type END AS key, event_type FROM events) SELECT key, count(*) AS unactuated, string_agg(event_type, ',' ORDER BY event_type) AS fields FROM e GROUP BY key""")
def enforcement_by_schema(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("value") > 150, "").otherwise(F.col("event_type")).alias("schema_name"), F.col("event_type").alias("name"))
    return reports.enforcement(rows).withColumn("fields", F.array_join("fields", ","))


@query("SELECT lang, count(*) AS claims, count(*) FILTER (WHERE quality IS NULL) AS undecided FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def undecided_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.col("quality").alias("verdict"))
    return reports.undecided(rows, ["lang"])


@query("SELECT string_agg(event_type, ',' ORDER BY event_type) AS phases FROM (SELECT event_type FROM events GROUP BY event_type HAVING max(value) > 100)")
def degraded_phases(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg((F.max("value") > 100).alias("failed"))
    return reports.degraded(rows)


@query(f"WITH {MODULES}, {EXPORTS} SELECT DISTINCT name FROM x UNION SELECT DISTINCT string_split(name, '.')[-1] FROM x")
def symbol_vocabulary(spark, sf_dir):
    return reports.vocabulary(fx.table(facts(spark, sf_dir, "exports"), "exports"))


@query("""
WITH c AS (SELECT doc_id, n_chars AS tokens, CASE WHEN source < 'src5' THEN n_chars ELSE 0 END AS h FROM documents WHERE lang <> 'de') SELECT d.doc_id AS path, coalesce(c.tokens, length(text) // 4) AS tokens, c.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id AND d.n_chars = c.h""")
def cached_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang <> 'de'").select(F.col("doc_id").alias("path"), F.lit("x").alias("counter"), F.when(F.col("source") < "src5", F.col("n_chars")).otherwise(0).alias("source_hash"), F.col("n_chars").alias("tokens"))
    files = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("source_hash"), T.token_estimate(F.col("text")).alias("estimate"))
    return reports.cached_tokens(files, cache.union(cache.withColumn("counter", F.lit("y"))), "x").select("path", "tokens", "hit")


@query("SELECT user_id AS path, count(*) AS checked, string_agg(event_type || event_id, ',' ORDER BY event_type || event_id) AS findings FROM events GROUP BY user_id")
def merged_check_results(spark, sf_dir):
    """Each user's checks, one for each event type, added up."""
    parts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path"), "event_type").agg(F.count("*").alias("checked"), F.collect_list(F.concat("event_type", F.col("event_id").cast("string"))).alias("findings"))
    return reports.merged_checks(parts).withColumn("findings", F.array_join("findings", ","))


@query(f"WITH {MODULES} SELECT path FROM m WHERE g NOT IN ('1', '2')")
def files_outside_snapshots(spark, sf_dir):
    cases = spark.createDataFrame([("src/pkg1", "corpus-case/1"), ("src/pkg2", "corpus-case/2"), ("src/pkg3", "other/1")], "folder string, schema string")
    return reports.outside_snapshots(modules(spark, sf_dir).select("path"), cases)


@query(f"""
WITH {MODULES}, d AS (SELECT k AS doc, CASE k % 4 WHEN 0 THEN 'see ' || path || ' here' WHEN 1 THEN 'in mod' || k || '.py' WHEN 2 THEN 'pkg' || g || '.mod' || k || '.run' ELSE 'none' END AS text FROM m)
SELECT doc, path FROM d JOIN m ON contains(text, path) OR contains(text, 'mod' || m.k || '.py') OR contains(text, 'pkg' || m.g || '.mod' || m.k)""")
def documents_naming_sources(spark, sf_dir):
    own = modules(spark, sf_dir)
    k = F.col("k")
    name = F.concat(F.lit("mod"), k.cast("string"))
    text = F.when(k % 4 == 0, F.concat(F.lit("see "), "path", F.lit(" here"))).when(k % 4 == 1, F.concat(F.lit("in "), name, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("pkg"), "g", F.lit("."), name, F.lit(".run"))).otherwise("none")
    return reports.document_sources(own.select(F.col("k").alias("doc"), text.alias("text")), own.select("path"))


@query("""
SELECT doc_id, lang AS root, CASE WHEN source = 'src1' THEN 'doc_' || lang WHEN source = 'src2' THEN source ELSE lang END AS category, CASE WHEN lang = 'en' THEN 'python' WHEN lang = 'de' THEN 'de' ELSE 'unknown' END AS language, CASE WHEN lang = 'fr' THEN 'contract' ELSE 'uncategorized' END AS gap FROM documents""")
def detector_names(spark, sf_dir):
    lang, source = F.col("lang"), F.col("source")
    detector = F.when(source == "src1", F.concat(F.lit("doc:"), lang)).when(source == "src2", source).otherwise(F.concat(source, F.lit(":"), lang))
    path = F.when(lang == "en", "a/b.PY").when(lang == "de", "c.de").otherwise("Makefile")
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", reports.comparison_root(F.concat(lang, F.lit(".get('"), source, F.lit("')"))).alias("root"), reports.category_of(detector).alias("category"), reports.language_of(path).alias("language"), reports.split_gap(F.lit("uncategorized"), F.when(lang == "fr", "contract").otherwise("dead_code")).alias("gap"))


@query("SELECT user_id AS slug, event_type || '.py' AS path, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS lines FROM events WHERE value <= 200 GROUP BY user_id, event_type")
def parsed_search_hits(spark, sf_dir):
    row = F.concat("event_type", F.lit(".py:"), F.col("event_id").cast("string"), F.lit(": text: more"))
    events = table(spark, sf_dir, "events")
    outputs = events.groupBy(F.col("user_id").alias("slug")).agg(F.array_join(F.collect_list(F.when(F.col("value") <= 200, row)), "\n").alias("output"))
    failed = events.select(F.col("user_id").alias("slug"), F.lit("Error: a.py:1: x").alias("output"))
    return reports.search_hits(outputs.union(failed)).withColumn("lines", F.array_join("lines", ","))


@query(f"WITH {MODULES} SELECT 'src/pkg' || g AS parent, string_agg('mod' || k || '.py', ',' ORDER BY 'mod' || k || '.py') AS children FROM m GROUP BY g UNION ALL SELECT 'src', (SELECT string_agg(DISTINCT 'pkg' || g, ',' ORDER BY 'pkg' || g) FROM m) UNION ALL SELECT '', 'src'")
def tree_children(spark, sf_dir):
    files = repository.path_columns(modules(spark, sf_dir).select("path"))
    nodes = files.select("path", "parent", F.lit(False).alias("is_dir")).union(repository.directories(files).select("path", "parent", F.lit(True)))
    return reports.tree_rows(nodes).withColumn("children", F.array_join("children", ","))


@query("""
WITH f AS (SELECT count(*) AS files, floor(sum(octet_length(encode(coalesce(text, '')))) / 3.3)::BIGINT AS source_tokens FROM documents)
SELECT files, source_tokens, floor(source_tokens * 1.2)::BIGINT AS input_tokens, floor(source_tokens * 0.3)::BIGINT AS output_tokens, round((floor(source_tokens * 1.2) * 3 + floor(source_tokens * 0.3) * 15) / 1e6, 6)::DOUBLE AS dollars FROM f""")
def run_estimate(spark, sf_dir):
    return reports.estimate(table(spark, sf_dir, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")))


@query("SELECT count(*) AS claims, count(*) FILTER (WHERE quality = 1) AS old_eligible, count(*) FILTER (WHERE toxic = 0) AS new_eligible, count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS old_escalated, count(*) FILTER (WHERE toxic = 0 AND n_chars > 500) AS new_escalated FROM documents JOIN labels USING (doc_id)")
def triage_cutover(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return reports.triage_delta(rows.select((F.col("quality") == 1).alias("old"), (F.col("toxic") == 0).alias("new"), (F.col("n_chars") > 500).alias("escalated")))


@query("SELECT doc_id, unnest([lang, 's\"' || source]) AS leaf FROM documents")
def json_leaves(spark, sf_dir):
    document = F.to_json(F.struct("lang", F.array(F.struct(F.concat(F.lit('s"'), "source").alias("deep"), F.col("n_chars"))).alias("list")))
    return reports.string_leaves(table(spark, sf_dir, "documents").select("doc_id", document.alias("d")), "doc_id", "d")


@query("SELECT event_id AS ord, event_type, CASE WHEN value > 50 THEN 'confirmed' END AS verdict FROM events")
def positional_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "event_type", "value")
    return reports.positional(rows.where("value > 50").select("ord", F.lit("confirmed").alias("verdict")), rows.drop("value"))
