"""Sidecars, changes and manifests made from the test tables, written to the shared folder, read back by their loaders, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plan_queries as pq
from .functions import text as T
from .plans import changes, detectors, evidence, reports
from .plans import facts as fx
from .queries import SQL, query, table
from .sources import documents, repository, sidecars
from .sources.storage import shared_path, stored

# ---- sidecars of the modules


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def written(spark, rows: DataFrame) -> str:
    """The folder that sidecars (kind, path, text) were written to."""
    root = shared_path(spark, "sidecars")
    sidecars.write(rows, root)
    return root


def records(spark, sf_dir) -> DataFrame:
    """What was found out about every module; every fifth has no signature, every fourth no symbols, every third no role."""
    k = F.regexp_extract("path", "mod([0-9]+)", 1).cast("int")
    known = pq.facts(spark, sf_dir, "imports", "exports").drop("classification")
    finding = lambda severity, line: F.struct(F.lit("debris").alias("category"), F.lit(line).alias("line_start"), F.lit(line + 2).alias("line_end"), F.lit(severity).alias("severity"), text("left ", k).alias("description"))
    symbol = F.struct(text("fn", F.floor(k / 2)).alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"), F.lit(10).alias("line_end"))
    return known.select(
        "path",
        T.hash16(F.col("path")).alias("source_hash"),
        text("about ", k).alias("body"),
        F.array_compact(F.array(F.when(k % 2 == 0, finding("error", 3)), F.when(k % 6 == 0, finding("warning", 9)))).alias("findings"),
        F.filter(F.array(symbol), lambda x: k % 4 != 0).alias("symbols"),
        F.when(k % 3 == 0, "schema").when(k % 3 == 1, "service").alias("file_role"),
        F.when(k % 5 != 0, text("does fn", F.floor(k / 2))).alias("purpose"),
        F.array(F.lit("modules"), F.regexp_extract("path", "pkg[0-9]+", 0)).alias("topics"),
        F.struct("imports", "exports", F.lit("ast").alias("extraction_method")).alias("facts"),
    )


def recorded(spark, sf_dir, kind: str) -> DataFrame:
    """(path, text) of one kind of the modules' sidecars, as they were written."""
    return sidecars.packed(spark, written(spark, sidecars.documents(records(spark, sf_dir), "v2").where(F.col("kind") == kind)), kind)


@query(SQL["module_unused_exports"])
def recorded_unused_exports(spark, sf_dir):
    known = stored(sidecars.facts(recorded(spark, sf_dir, "facts")), "loaded-facts")
    return fx.unused_exports(known, fx.resolved_imports(known, known))


@query(f"WITH {pq.MODULES} SELECT path, 'fn' || (k // 2) AS name, 'function' AS kind, 1 AS line_start, 10 AS line_end, CASE k % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'service' END AS role FROM m WHERE k % 4 <> 0 AND path NOT LIKE '%7.py'")
def recorded_symbols(spark, sf_dir):
    own, is_doc = recorded(spark, sf_dir, "symbols"), F.endswith("path", F.lit("7.py"))
    found = sidecars.symbols(own, is_doc).select("path", F.inline("symbols"))
    return found.join(sidecars.roles(own, is_doc), "path", "left")


@query(f"WITH {pq.MODULES} SELECT path FROM m WHERE k % 3 = 0 AND path NOT LIKE '%7.py'")
def files_by_role(spark, sf_dir):
    return sidecars.with_role(recorded(spark, sf_dir, "symbols"), "schema", F.endswith("path", F.lit("7.py")))


@query(f"WITH {pq.MODULES} SELECT path, 'file' AS kind, 'does fn' || (k // 2) AS purpose, 'modules,pkg' || g AS topics FROM m WHERE k % 5 <> 0")
def recorded_signatures(spark, sf_dir):
    return sidecars.signatures(recorded(spark, sf_dir, "signatures")).select("path", "kind", "purpose", F.array_join("topics", ",").alias("topics"))


@query(f"""
WITH {pq.MODULES}, f AS (SELECT path, k, 'error' AS severity, 3 AS line_start FROM m WHERE k % 2 = 0 UNION ALL SELECT path, k, 'warning', 9 FROM m WHERE k % 6 = 0)
SELECT path, 'debris' AS category, line_start, line_start + 2 AS line_end, severity, 'left ' || k AS description FROM f WHERE k % 7 <> 0""")
def recorded_findings(spark, sf_dir):
    """Every seventh file has changed since, and what was found in it no longer counts."""
    now = pq.modules(spark, sf_dir).select("path", F.when(F.col("k") % 7 == 0, "changed").otherwise(T.hash16(F.col("path"))).alias("source_hash"), F.lit("v2").alias("impl_hash"))
    found = documents.current_findings(sidecars.findings(recorded(spark, sf_dir, "findings")), now)
    return found.select("path", "category", "line_start", "line_end", "severity", "description")


@query("""
SELECT 'docs/' || doc_id || '.md' AS path, lang AS classification, quality / 2.0 AS confidence, source AS purpose, lang || ',' || source AS topics, 1 + toxic AS accuracy_error_count, 'd' || doc_id || ':warning' AS errors
FROM documents JOIN labels USING (doc_id)""")
def recorded_analyses(spark, sf_dir):
    """Toxic documents have an entry that is no object: it counts, and says nothing."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    head = text('{"classification":"', F.col("lang"), '","confidence":', F.col("quality") / 2, ',"topic_signature":{"purpose":"', F.col("source"), '","topics":["', F.col("lang"), '","', F.col("source"), '"]},"findings":[')
    rows = docs.select(F.lit("docs").alias("kind"), text(F.col("doc_id"), ".md.analysis.json").alias("path"), F.concat(head, F.when(F.col("toxic") == 1, '"odd",').otherwise(""), text('{"description":"d', F.col("doc_id"), '"}]}')).alias("text"))
    found = sidecars.analyses(sidecars.packed(spark, written(spark, rows), "docs"))
    errors = F.array_join(F.transform("findings", lambda e: F.concat_ws(":", e["description"], e["severity"])), ",")
    return found.select(text("docs/", F.col("path")).alias("path"), "classification", F.col("confidence"), "purpose", F.array_join("topics", ",").alias("topics"), "accuracy_error_count", errors.alias("errors"))


def summarised(spark, sf_dir) -> DataFrame:
    """Summaries of the folders, of which two have none."""
    modules = pq.modules(spark, sf_dir)
    whole = modules.where("g < 6").select("g").distinct().select(text("src/pkg", F.col("g"), "/_directory.shadow.md").alias("path"), F.repeat(F.concat(F.lit("all of "), "g"), 80).alias("text"))
    each = modules.select(text(F.col("path"), ".shadow.md").alias("path"), text("about ", F.col("k")).alias("text"))
    rows = whole.union(each).select(F.lit("shadow").alias("kind"), "path", "text")
    return sidecars.folder_summaries(sidecars.packed(spark, written(spark, rows), "shadow"))


@query(f"WITH {pq.MODULES} SELECT 'src/pkg' || g AS folder, substr(repeat('all of ' || g, 80), 1, 500) AS summary, count(*)::INT AS n_children, min(path) AS first FROM m WHERE g < '6' GROUP BY g")
def recorded_summaries(spark, sf_dir):
    return summarised(spark, sf_dir).select("folder", "summary", F.size("children").alias("n_children"), F.get("children", F.lit(0)).alias("first"))


@query(f"WITH {pq.MODULES} SELECT n_name AS doc, path FROM nation JOIN m ON g = (n_nationkey % 8)::VARCHAR WHERE g < '6'")
def topic_sources(spark, sf_dir):
    matches = table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc"), text("/src/pkg", F.col("n_nationkey") % 8, "/").alias("folder"))
    return sidecars.topic_matches(matches, summarised(spark, sf_dir))


# ---- a change of every fifth module, and documents made from orders that name modules by path and by file name


def changed_modules(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("M", "A", "D", "R100"))), (F.col("k") % 4 + 1).cast("int"))
    rows = pq.modules(spark, sf_dir).where("k % 5 = 0").select("path", status.alias("status"), F.col("k").alias("ord"))
    return changes.classified(rows, F.endswith("path", F.lit(".py")), F.endswith("path", F.lit(".md")))


def order_notes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(pq.modules(spark, sf_dir).select(F.col("k").alias("l_partkey"), "path"), "l_partkey")
    line = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("see "), "path")).otherwise(text("and mod", F.col("l_partkey"), ".py"))
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("ls"))
    return grouped.select(text("docs/", F.col("l_orderkey"), ".md").alias("path"), F.array_join("ls.line", "\n").alias("text"))


def module_state(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The files that are left, and shadows of two thirds of all, half of them of an older source."""
    modules = pq.modules(spark, sf_dir)
    own = T.hash16(F.col("path"))
    files = modules.where("NOT (k % 5 = 0 AND k % 4 = 2)").select("path", own.alias("source_hash"))
    older = F.when(F.col("k") % 3 == 1, "old").otherwise(own)
    body = text("@source: ", F.col("path"), "\n@source-hash: ", older, "\n\n", F.when(F.col("k") % 10 == 1, reports.WARNINGS["stale"] + "\n").otherwise(""), "body ", F.col("k"))
    return files, modules.where("k % 3 < 2").select("path", older.alias("source_hash"), F.when(F.col("k") % 6 == 0, "v1").otherwise("v2").alias("impl_hash"), body.alias("text"))


STALE = "s AS (SELECT path, k % 3 < 2 AS shadow, CASE WHEN k % 4 = 2 THEN 'deleted_source' WHEN k % 3 = 2 THEN 'missing' WHEN k % 3 = 1 OR k % 6 = 0 THEN 'stale' END AS status FROM m WHERE k % 5 = 0)"
NOTES = "t AS (SELECT 'docs/' || l_orderkey || '.md' AS doc, path, k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_no, CASE WHEN l_linenumber % 2 = 1 THEN 'see ' || path ELSE 'and mod' || k || '.py' END AS line FROM lineitem JOIN m ON k = l_partkey)"


@query(f"WITH {pq.MODULES}, {STALE} SELECT path, shadow AS shadow_exists, status FROM s WHERE status IS NOT NULL")
def changed_shadows(spark, sf_dir):
    files, shadows = module_state(spark, sf_dir)
    return changes.stale_shadows(changed_modules(spark, sf_dir), files, shadows, "v2")


def impact(spark, sf_dir, facts: DataFrame, notes: DataFrame | None = None) -> changes.Impact:
    files, shadows = module_state(spark, sf_dir)
    return changes.impact(changed_modules(spark, sf_dir), files, shadows, order_notes(spark, sf_dir) if notes is None else notes, facts, "v2")


@query(f"WITH {pq.MODULES}, {NOTES} SELECT doc, path, line_no, line, k % 4 = 2 AS source_deleted FROM t WHERE k % 5 = 0")
def change_references(spark, sf_dir):
    return impact(spark, sf_dir, pq.facts(spark, sf_dir, "exports")).references


@query(f"WITH {pq.MODULES}, {NOTES} SELECT doc, path, min(line_no) AS line_no, arg_min(line, line_no) AS line, k % 4 = 2 AS source_deleted FROM t WHERE k % 5 = 0 GROUP BY doc, path, k")
def change_references_by_facts(spark, sf_dir):
    notes = stored(order_notes(spark, sf_dir), "notes")
    rows = changes.reference_facts(notes, pq.modules(spark, sf_dir).select("path"))
    # of the facts only what says which documents name which sources, read once
    known = sidecars.facts(sidecars.packed(spark, written(spark, rows), "facts")).select("path", "classification", F.transform("imports", lambda x: F.struct(x["source"].alias("source"))).alias("imports"))
    return impact(spark, sf_dir, stored(known, "loaded-facts"), notes).references


@query(f"""
WITH {pq.MODULES}, {STALE}, {NOTES}, a AS (SELECT count(*) AS stale FROM s WHERE status IS NOT NULL), b AS (SELECT count(*) AS n_references, count(*) FILTER (k % 4 = 2) AS deleted FROM t WHERE k % 5 = 0)
SELECT stale, n_references, deleted, stale + n_references > 0 AS has_issues FROM a, b""")
def change_issues(spark, sf_dir):
    return impact(spark, sf_dir, pq.facts(spark, sf_dir, "exports")).issues()


OLD = "substr(sha256(path), 1, 16)"


@query(f"""
WITH {pq.MODULES}, h AS (SELECT *, '@source: ' || path || chr(10) || '@source-hash: ' || CASE k % 3 WHEN 1 THEN 'old' ELSE {OLD} END || chr(10) || chr(10) AS head FROM m WHERE k % 3 < 2 AND (k % 3 = 1 OR k % 6 = 0) AND NOT (k % 5 = 0 AND k % 4 = 2)),
w AS (SELECT *, CASE WHEN k % 3 = 1 THEN '{reports.WARNINGS["stale"]}' ELSE '{reports.WARNINGS["stale-impl"]}' END || chr(10) AS line FROM h)
SELECT path, CASE WHEN k % 3 = 1 THEN 'stale' ELSE 'stale-impl' END AS reason, (NOT (k % 10 = 1 AND k % 3 = 1))::INT AS added,
head || CASE WHEN k % 10 = 1 AND k % 3 = 0 THEN '{reports.WARNINGS["stale"]}' || chr(10) ELSE '' END || line || 'body ' || k AS text FROM w""")
def marked_shadows(spark, sf_dir):
    files, shadows = module_state(spark, sf_dir)
    return changes.marked(shadows, detectors.stale(files, shadows, "v2"))


# ---- manifests of all five formats


@query("""
SELECT 'pyproject.toml' AS manifest, 'python' AS ecosystem, lower(n_name) AS package FROM nation UNION SELECT 'package.json', 'node', '@' || lower(n_name) || '/ui' FROM nation
UNION SELECT 'Cargo.toml', 'rust', lower(n_name) || '-rs' FROM nation UNION SELECT 'go.mod', 'go', 'example.org/' || lower(n_name) FROM nation
UNION SELECT 'requirements-' || l_suppkey || '.txt', 'python', 'part' || l_partkey FROM lineitem""")
def declared_dependencies(spark, sf_dir):
    """A requirements file for each supplier, and one manifest of each other format with the nations."""
    name = F.lower("n_name")
    listed = lambda shape: F.array_join(F.array_sort(F.collect_list(shape)), "\n")
    quoted = lambda a, b: F.array_join(F.array_sort(F.collect_list(text(a, name, b))), ",\n")
    one = table(spark, sf_dir, "nation").agg(
        text('[project]\nname = "x"\ndependencies = [\n', quoted('"', ' >= 1.0"'), "\n]\n").alias("pyproject.toml"),
        text('{"name": "x", "dependencies": {\n', quoted('"@', '/ui": "^1"'), "\n}}\n").alias("package.json"),
        text('[package]\nname = "x"\n[dependencies]\n', listed(text(name, '-rs = "1"')), "\n").alias("Cargo.toml"),
        text("module x\n\nrequire (\n\t// direct\n", listed(text("\texample.org/", name, " v1.0.0")), "\n)\n").alias("go.mod"),
    )
    names = ["pyproject.toml", "package.json", "Cargo.toml", "go.mod"]
    single = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("path"), F.col(f"`{n}`").alias("text")) for n in names))))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(text("part", F.col("l_partkey"), " == 1.0"))), "\n").alias("text"))
    files = single.union(lines.select(text("requirements-", F.col("l_suppkey"), ".txt").alias("path"), F.concat(F.lit("# parts\n"), "text").alias("text")))
    return repository.dependencies(repository.path_columns(files))


# ---- evidence about places: modules of forty lines, of which a third of the findings are about a symbol and a third about a name


def numbered_modules(spark, sf_dir) -> DataFrame:
    line = lambda i: text("line ", i, " of ", F.col("k"), F.when(i == 15, text(" near", F.col("k"))).otherwise(""))
    spread = pq.modules(spark, sf_dir).repartition("path")  # texts are made where they are read, not in the few tasks of a small table
    return spread.select("path", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), line), "\n").alias("text"))


def module_symbols(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    one = lambda name, start, end, of=F.lit(True): F.when(of, F.struct(name.alias("name"), F.lit(start).alias("line_start"), F.lit(end).alias("line_end")))
    return pq.modules(spark, sf_dir).select("path", F.inline(F.array_compact(F.array(one(text("fn", F.floor(k / 2)), 1, 10), one(text("Cls", k), 20, 40), one(text("Cls", k, ".run"), 22, 25, k % 2 == 0)))))


def placed_findings(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    symbol = F.when(k % 3 == 0, text("fn", F.floor(k / 2))).when(k % 3 == 1, text("near", k))
    return pq.modules(spark, sf_dir).select(k.cast("string").alias("id"), "path", symbol.alias("symbol"), (k % 40 + 1).alias("line_start"), (k % 40 + 3).alias("line_end"))


def told(found: DataFrame, *fields: str) -> DataFrame:
    return found.select("id", *(F.get_json_object("payload", f"$.{f}").alias(f) for f in fields))


SHOWN = "i || ' of ' || k || CASE WHEN i = 15 THEN ' near' || k ELSE '' END"
AROUND = "CASE WHEN l BETWEEN 22 AND 25 AND k % 2 = 0 THEN ['Cls' || k || '.run', '22', '25'] WHEN l >= 20 THEN ['Cls' || k, '20', '40'] WHEN l <= 10 THEN ['fn' || (k // 2), '1', '10'] END"


@query(f"""
WITH {pq.MODULES}, f AS (SELECT k, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 15 ELSE k % 40 + 1 END AS l, CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE k % 40 + 3 END AS z FROM m),
g AS (SELECT *, greatest(l - 10, 1) AS a, least(z + 10, 40) AS b, {AROUND} AS own FROM f)
SELECT k::VARCHAR AS id, a::VARCHAR AS line_start, b::VARCHAR AS line_end, CASE WHEN k % 3 < 2 THEN 'symbol' ELSE 'lines' END AS anchor, CASE WHEN own[2]::INT <> l OR own[3]::INT <> z THEN own[1] END AS enclosing,
array_to_string(list_transform(range(a, b + 1), lambda i: i || chr(9) || 'line ' || {SHOWN}), chr(10)) AS code FROM g""")
def surrounding_code(spark, sf_dir):
    found = evidence.surrounding(placed_findings(spark, sf_dir), numbered_modules(spark, sf_dir), module_symbols(spark, sf_dir))
    return told(found, "line_start", "line_end", "anchor", "enclosing", "code")


@query(f"""
WITH {pq.MODULES}, f AS (SELECT *, {AROUND} AS own FROM (SELECT k, k % 40 + 1 AS l FROM m))
SELECT k::VARCHAR AS id, CASE WHEN l > 1 THEN array_to_string(list_transform(range(greatest(l - 10, 1), l), lambda i: 'line ' || {SHOWN}), chr(10)) END AS before,
CASE WHEN own IS NOT NULL THEN array_to_string(list_transform(range(own[2]::INT, least(own[3]::INT, own[2]::INT + 14) + 1), lambda i: 'line ' || {SHOWN}), chr(10)) END AS enclosing FROM f""")
def declared_intent(spark, sf_dir):
    return told(evidence.declared_intent(placed_findings(spark, sf_dir), numbered_modules(spark, sf_dir), module_symbols(spark, sf_dir)), "before", "enclosing")


@query(f"""
WITH {pq.MODULES} SELECT k::VARCHAR AS id, path AS file, 'file' AS scope, 'about ' || k AS excerpt FROM m WHERE k % 5 <> 0
UNION ALL SELECT k::VARCHAR, path, 'directory', 'all of ' || g FROM m WHERE k % 4 = 1 AND k % 5 <> 0 AND g < '6' UNION ALL SELECT k::VARCHAR, '', 'root', 'all' FROM m WHERE k % 4 IN (1, 3) AND k % 5 = 0""")
def documentation_scopes(spark, sf_dir):
    """Findings in code, about descriptions in code, and in documents that name a source outright or among their terms."""
    modules, k = pq.modules(spark, sf_dir), F.col("k")
    shadows = modules.where("k % 5 <> 0").select("path", text("about ", k).alias("text"))
    folders = modules.where("g < 6").select("g").distinct().select(text("src/pkg", F.col("g")).alias("folder"), text("all of ", F.col("g")).alias("text"))
    folders = folders.union(table(spark, sf_dir, "region").select(F.lit("").alias("folder"), F.lit("all").alias("text")).distinct())
    named = F.when(k % 4 == 3, F.array("path", text("src/pkg", F.col("g"), "/gone.py"), F.lit("word")))
    found = modules.select(k.cast("string").alias("id"), F.when(k % 4 < 2, F.col("path")).otherwise(text("docs/", k, ".md")).alias("path"), F.when(k % 4 == 0, "dead_code").otherwise("description").alias("gap_type"), F.when(k % 4 == 2, F.col("path")).alias("shadow_ref"), named.alias("search_terms"))
    return told(evidence.shadow_claims(found, shadows, folders), "file", "scope", "excerpt")
