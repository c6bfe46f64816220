"""State, frames, bindings and trees bound to data made from the test tables, each with SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import plan_queries as pq
from .functions import schema, statistics
from .functions import text as T
from .operators import documents, nearest
from .plans import evidence, frames
from .plans import facts as fx
from .queries import query, seconds, table
from .sources import ci
from .sources.storage import shared_path, stored
from .streaming import verdicts

# ---- verdicts kept over audits: two audits of the same findings, under two versions

RULES, KEEP = "report errors of users only", 5 * 86_400


@query("""
WITH l AS (SELECT user_id::VARCHAR || ':' || event_type AS finding_id, event_id AS ord, epoch_us(ts) AS us, substr(sha256(((props->>'$.k')::INT % 3)::VARCHAR), 1, 16) AS fingerprint, CASE WHEN value > 20 THEN 'confirmed' ELSE 'dismissed' END AS verdict,
CASE WHEN ts < TIMESTAMP '2024-01-16' THEN '1:engine' ELSE '2:engine:rules-' || substr(sha256('report errors of users only'), 1, 16) END AS version FROM events),
g AS (SELECT *, lag(us) OVER w AS us0, lag(version) OVER w AS version0, lag(fingerprint) OVER w AS fingerprint0 FROM l WINDOW w AS (PARTITION BY finding_id ORDER BY us, ord)),
b AS (SELECT *, us0 IS NULL OR us0 + 432000000000 <= us AS fresh FROM g),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY finding_id ORDER BY us, ord) AS life FROM b)
SELECT finding_id, last(version ORDER BY us, ord) AS version, last(fingerprint ORDER BY us, ord) AS fingerprint, last(verdict ORDER BY us, ord) AS verdict, count(*) AS seen,
count(*) FILTER (NOT fresh AND version = version0 AND fingerprint = fingerprint0) AS hits, count(*) FILTER (NOT fresh AND version <> version0) AS stale, last(version ORDER BY us, ord) <> '1:engine' AS valid
FROM n JOIN (SELECT finding_id, max(life) AS life FROM n GROUP BY finding_id) USING (finding_id, life) GROUP BY finding_id HAVING max(us) + 432000000000 > (SELECT max(us) FROM l)""")
def verdict_state(spark, sf_dir):
    first = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    stamp = verdicts.version_stamp(F.when(first, "1").otherwise("2"), F.lit("engine"), F.when(~first, RULES))
    fingerprint = T.hash16((F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    log = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(
        F.concat_ws(":", "user_id", "event_type").alias("finding_id"), fingerprint.alias("fingerprint"), F.when(F.col("value") > 20, "confirmed").otherwise("dismissed").alias("verdict"), stamp.alias("version"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), first.alias("first")
    )
    place, checkpoint = shared_path(spark, "verdict-log"), shared_path(spark, "verdict-state")
    for part in (log.where("first"), log.where("NOT first")):  # an audit each; the second one starts from the first one's checkpoint
        verdicts.append(part, place)
        verdicts.advance(spark, place, checkpoint, KEEP)
    current = f"2:engine:rules-{T.digest16(RULES)}"
    return verdicts.usable(verdicts.kept(spark, checkpoint), current, KEEP).select("finding_id", "version", "fingerprint", "verdict", "seen", "hits", "stale", "valid")


# ---- the nearest match


@query("""
WITH v AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS at, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL), e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS at FROM events WHERE event_type = 'error')
SELECT e.event_id, CASE WHEN e.at - v.at <= 21600 THEN v.seen END AS seen FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.at >= v.at""")
def as_of_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("at"))
    views = rows.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("seen"))
    return nearest.as_of(rows.where("event_type = 'error'").select("event_id", "user_id", "at"), views, ["user_id"], "at", 21_600, ["seen"]).select("event_id", "seen")


@query("""
WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS home FROM p WHERE contains(path, '/') GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT DISTINCT split_part(home, '/', 1) AS home FROM h UNION SELECT home FROM h)
SELECT path, arg_max(home, length(home)) AS home FROM p JOIN t ON starts_with(path, home || '/') GROUP BY path""")
def nearest_home(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    homes = paths.where(F.contains("path", F.lit("/"))).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("home")).count().where("count >= 2").select("home")
    return nearest.nearest_ancestor(paths, "path", homes.union(homes.select(F.split("home", "/")[0])), "home")


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS line_no FROM lineitem),
b AS (SELECT l_suppkey, 'v' || (l_partkey % 20) AS variable, line_no, 'T' || chr(65 + (l_partkey % 26)::INT) || 'x' AS type FROM l WHERE l_returnflag = 'R'),
f AS (SELECT l_suppkey, line_no, 'v' || (l_orderkey % 20) AS variable FROM l WHERE l_returnflag = 'N' AND l_linenumber = 1)
SELECT f.l_suppkey || ':' || f.line_no AS id, f.variable, b.type FROM f ASOF JOIN b ON f.l_suppkey = b.l_suppkey AND f.variable = b.variable AND f.line_no >= b.line_no WHERE f.line_no - b.line_no <= 39""")
def variable_types(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("x"))
    annotated = F.concat(F.lit("v"), (F.col("x.l_partkey") % 20).cast("string"), F.lit(": T"), F.char((65 + F.col("x.l_partkey") % 26).cast("int")), F.lit("x"))
    asked = F.when((F.col("x.l_returnflag") == "N") & (F.col("x.l_linenumber") == 1), F.concat(F.lit("`v"), (F.col("x.l_orderkey") % 20).cast("string"), F.lit(".qty` is unused")))
    texts = lines.select("path", F.struct("x", F.when(F.col("x.l_returnflag") == "R", annotated).otherwise("pass").alias("line"), asked.alias("message")).alias("y")).groupBy("path").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    texts = stored(texts.select("path", F.array_join("ys.line", "\n").alias("text"), F.col("ys.message").alias("messages")), "typed-lines")
    findings = texts.select("path", F.posexplode("messages").alias("k", "message")).where("message IS NOT NULL").select(F.concat_ws(":", "path", F.col("k") + 1).alias("id"), "path", (F.col("k") + 1).alias("line_start"), "message")
    return evidence.inferred_types(findings, texts.select("path", "text"))


# ---- callee frames: every module calls what it imports, from its function or from its class


@query(f"""
WITH RECURSIVE {pq.IMPORTS.removeprefix(chr(10))}, {pq.EXPORTS.strip()},
c0 AS (SELECT path, CASE WHEN s % 2 = 0 THEN 'fn' || (k // 2) ELSE 'Cls' || k || '.run' END AS sym, CASE WHEN s % 4 = 0 THEN local || '.run' ELSE local END AS "to", line + 3 * (s % 10) AS line FROM (SELECT *, regexp_extract(path, 'mod([0-9]+)', 1)::INT AS k FROM i) WHERE local <> '*'),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, "to", sym) AS pos, regexp_extract("to", '[^.]*$') AS bare FROM c0),
n AS (SELECT path, local AS name, arg_min(target, (line, target)) AS first, arg_max(target, (line, target)) AS last FROM i WHERE target IS NOT NULL GROUP BY path, local),
e AS (SELECT c.*, CASE WHEN (c.path, c.bare) IN (SELECT path, name FROM x) THEN c.path ELSE n.first END AS definer FROM c LEFT JOIN n ON n.path = c.path AND n.name = c.bare),
sy AS (SELECT path, 'fn' || (k // 2) AS name, 1 AS a, 10 AS z FROM m UNION ALL SELECT path, 'Cls' || k, 20, 40 FROM m),
own AS (SELECT path, unnest(CASE WHEN contains(sym, '.') THEN [sym, split_part(sym, '.', 2)] ELSE [sym] END) AS name, "to", bare, line, pos, definer FROM e),
al AS (SELECT * FROM own UNION ALL SELECT sy.path, sy.name, "to", bare, line, pos, definer FROM sy JOIN e ON e.path = sy.path AND line BETWEEN a AND z WHERE (sy.path, sy.name) NOT IN (SELECT path, name FROM own)),
e1 AS (SELECT path, name, "to", min(pos) AS p0, list(line ORDER BY pos)[1:5] AS ls FROM al GROUP BY ALL),
e2 AS (SELECT path, name, list(name || '@' || path || '>' || "to" || ':' || array_to_string(ls, ',') ORDER BY p0)[1:15] AS es FROM e1 GROUP BY path, name),
p2 AS (SELECT path, name, list({{'name': bare, 'file': definer, 'origin': 'callee'}} ORDER BY p0)[1:10] AS nx FROM (SELECT path, name, bare, definer, min(pos) AS p0 FROM al WHERE definer IS NOT NULL GROUP BY ALL) GROUP BY path, name),
f AS (SELECT path, name, total, coalesce(es, []) AS es, coalesce(nx, []) AS nx FROM (SELECT path, name, count(*) AS total FROM al GROUP BY ALL) LEFT JOIN e2 USING (path, name) LEFT JOIN p2 USING (path, name)),
t AS (SELECT k, path, CASE k % 3 WHEN 0 THEN ['fn' || (k // 2), 'calls', 'Cls' || k, 'first'] ELSE [] END AS words FROM m WHERE k % 3 < 2),
s0 AS (SELECT k, bare AS name, definer AS file, 0 AS rank, pos, '' AS word FROM t JOIN e USING (path) WHERE line BETWEEN -1 AND 7 AND definer IS NOT NULL
UNION ALL SELECT k, w, coalesce(last, w.path), 1, 0, w FROM (SELECT k, path, unnest(words) AS w FROM t) w LEFT JOIN n ON n.path = w.path AND n.name = w WHERE last IS NOT NULL OR (w.path, w) IN (SELECT path, name FROM x UNION SELECT path, name FROM sy)
UNION ALL SELECT k, 'fn' || (k // 2), path, 2, 0, '' FROM t),
s1 AS (SELECT k, list({{'name': name, 'file': file, 'origin': ['region', 'claim_text', 'enclosing'][o.rank + 1]}} ORDER BY o)[1:5] AS seeds FROM (SELECT k, name, file, min({{'rank': rank, 'pos': pos, 'word': word}}) AS o FROM s0 GROUP BY k, name, file) GROUP BY k),
r AS (SELECT k, 1 AS step, seeds, []::VARCHAR[] AS es, 0::BIGINT AS total, FALSE AS done FROM s1
UNION ALL SELECT k, step + 1, seeds || list_filter(coalesce(nx, []), lambda p: len(list_filter(seeds, lambda q: q.name = p.name AND q.file = p.file)) = 0)[1:5 - len(seeds)], (r.es || coalesce(f.es, []))[1:40], r.total + coalesce(f.total, 0), len(r.es) + len(coalesce(f.es, [])) >= 40
FROM r LEFT JOIN f ON f.path = seeds[step].file AND f.name = seeds[step].name WHERE NOT done AND step <= len(seeds)),
u AS (SELECT k, list("to" ORDER BY pos)[1:5] AS un FROM t JOIN e USING (path) WHERE line BETWEEN -1 AND 7 AND definer IS NULL GROUP BY k)
SELECT k::VARCHAR AS id, array_to_string(list_transform(seeds, lambda q: q.origin || ':' || q.name || '@' || q.file), '|') AS seeds, array_to_string(es, '|') AS edges, total AS edges_total, coalesce(array_to_string(un, '|'), '') AS unresolved
FROM (SELECT k, arg_max(seeds, step) AS seeds, arg_max(es, step) AS es, max(total) AS total FROM r GROUP BY k) LEFT JOIN u USING (k) WHERE len(es) > 0""")
def callee_frames(spark, sf_dir):
    own = F.regexp_extract("path", "mod([0-9]+)", 1).cast("int")
    function, s = F.concat(F.lit("fn"), F.floor(own / 2).cast("string")), F.col("s")
    symbol = F.when(s % 2 == 0, function).otherwise(F.concat(F.lit("Cls"), own.cast("string"), F.lit(".run")))
    to = F.when(s % 4 == 0, F.concat("local", F.lit(".run"))).otherwise(F.col("local"))
    call = F.struct((F.col("line") + 3 * (s % 10)).alias("line"), to.alias("to"), symbol.alias("from_symbol"))
    calls = pq.import_rows(spark, sf_dir).where("local <> '*'").groupBy("path").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    known = stored(pq.facts(spark, sf_dir, "imports", "exports").join(calls, "path", "left"), "framed-facts")
    modules = pq.modules(spark, sf_dir)
    symbols = modules.select("path", function.alias("name"), F.lit(1).alias("line_start"), F.lit(10).alias("line_end")).union(modules.select("path", F.concat(F.lit("Cls"), own.cast("string")), F.lit(20), F.lit(40)))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("`"), function, F.lit("` calls `Cls"), F.col("k").cast("string"), F.lit("` first"))).when(F.col("k") % 3 == 1, "raises early").otherwise("plain")
    findings = modules.select(F.col("k").cast("string").alias("id"), "path", F.lit(2).alias("line_start"), F.lit(4).alias("line_end"), said.alias("message"))
    found = frames.callee_frames(findings, known, stored(fx.resolved_imports(known, modules), "framed-imports"), symbols)
    seeds = F.transform("seeds", lambda q: F.concat(q["origin"], F.lit(":"), q["name"], F.lit("@"), q["file"]))
    edges = F.transform("edges", lambda e: F.concat(e["caller"], F.lit("@"), e["caller_file"], F.lit(">"), e["to"], F.lit(":"), F.array_join(e["lines"].cast("array<string>"), ",")))
    return found.select("id", F.array_join(seeds, "|").alias("seeds"), F.array_join(edges, "|").alias("edges"), "edges_total", F.array_join("unresolved", "|").alias("unresolved"))


# ---- workflows made from order lines: a job of seven lines for each first line of an order, in three shapes


@query("""
WITH j AS (SELECT l_suppkey AS s, l_orderkey AS o, l_partkey AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey) - 1 AS k FROM lineitem WHERE l_linenumber = 1)
SELECT '.github/workflows/s' || s || '.yml' AS path, 'job' || o AS name, (4 + 7 * k)::INT AS line_start, (10 + 7 * k)::INT AS line_end,
CASE p % 3 WHEN 0 THEN 'actions/a@v' || (p % 5) || '|python ./src/mod' || p || '.py --fast|make x' WHEN 1 THEN 'pytest tests/test_' || p || '.py $X/y.z' ELSE 'ls docs/d' || p || '.md A=1' END AS commands,
CASE p % 3 WHEN 0 THEN './src/mod' || p || '.py' WHEN 1 THEN 'tests/test_' || p || '.py|/y.z' ELSE 'docs/d' || p || '.md' END AS paths FROM j""")
def ci_jobs(spark, sf_dir):
    o, p = F.col("l_orderkey").cast("string"), F.col("l_partkey")
    part = p.cast("string")

    def shape(*rows: object) -> Column:
        return F.concat_ws("\n", *(F.lit(r) if isinstance(r, str) else r for r in (F.concat(F.lit("  job"), o, F.lit(":")), "    runs-on: x", "    steps:", *rows)))

    first = shape(F.concat(F.lit("      - uses: actions/a@v"), (p % 5).cast("string")), "      - run: |", F.concat(F.lit("          python ./src/mod"), part, F.lit(".py --fast")), "          make x")
    second = shape(F.concat(F.lit("      - run: pytest tests/test_"), part, F.lit(".py $X/y.z")), "        env:", "          A: b/c", "      - name: z")
    third = shape("      - run: |", F.concat(F.lit("          ls docs/d"), part, F.lit(".md A=1")), "", "    timeout: 5/6")
    jobs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_suppkey", F.struct("l_orderkey", p.alias("p"), F.when(p % 3 == 0, first).when(p % 3 == 1, second).otherwise(third).alias("text")).alias("job"))
    whole = F.concat(F.lit("name: ci\non: push\njobs:\n"), F.array_join(F.transform(F.array_sort(F.collect_list("job")), lambda x: x["text"]), "\n"), F.lit("\nenv:\n  late:\n    - run: a/b\n"))
    files = jobs.groupBy("l_suppkey").agg(whole.alias("text")).select(F.concat(F.lit(".github/workflows/s"), F.col("l_suppkey").cast("string"), F.lit(".yml")).alias("path"), "text")
    return ci.ci_elements(files).select("path", "name", "line_start", "line_end", F.array_join("commands", "|").alias("commands"), F.array_join("paths", "|").alias("paths"))


# ---- documents: an order with its lines as JSON


def order_documents(spark, sf_dir) -> DataFrame:
    """(o_orderkey, d): {"id", "status", "lines": [{"part", "qty"}, ...]}; some parts are missing, some quantities are texts."""
    qty = F.col("l_quantity").cast("int")
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), qty.alias("q"))
    part = F.when(F.col("l_partkey") % 50 > 0, F.concat(F.lit('"part":'), F.col("l_partkey").cast("string"), F.lit(",")))
    text = F.concat(F.lit("{"), F.coalesce(part, F.lit("")), F.lit('"qty":'), F.when(qty == 7, '"7"').otherwise(qty.cast("string")), F.lit("}"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(item, text.alias("t")).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("lines"))
    head = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('","lines":['), "lines", F.lit("]}"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", head.alias("d"))


LINES = "l AS (SELECT l_orderkey AS o_orderkey, l_partkey AS p, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS k FROM lineitem)"


@query(f"""
WITH {LINES}, d AS (SELECT o_orderkey, '{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","lines":[' || x || ']}}' AS d FROM orders JOIN
(SELECT o_orderkey, string_agg('{{' || CASE WHEN p % 50 > 0 THEN '"part":' || p || ',' ELSE '' END || '"qty":' || CASE WHEN q = 7 THEN '"7"' ELSE q::VARCHAR END || '}}', ',' ORDER BY k) AS x FROM l GROUP BY o_orderkey) USING (o_orderkey))
SELECT o_orderkey, t.fullkey AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' ELSE 'integer' END AS kind, t.atom->>'$' AS value FROM d, json_tree(d.d) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def document_leaves(spark, sf_dir):
    return documents.json_leaves(order_documents(spark, sf_dir), ["o_orderkey"], "d")


#: What an order's document should be.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["id", "lines", "total"],
    "properties": {
        "id": {"type": "integer", "maximum": 1000},
        "status": {"type": "string", "enum": ["F", "O"]},
        "lines": {"type": "array", "items": {"type": "object", "required": ["part"], "properties": {"part": {"type": "integer"}, "qty": {"type": "integer", "maximum": 48}}}},
    },
}


@query(f"""
WITH {LINES}, e AS (SELECT o_orderkey, 0 AS k, 0 AS f, 'missing required field ''total''' AS error FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM l)
UNION ALL SELECT o_orderkey, 0, 1, 'id: value ' || o_orderkey || ' > maximum 1000' FROM orders WHERE o_orderkey > 1000 AND o_orderkey IN (SELECT o_orderkey FROM l)
UNION ALL SELECT o_orderkey, 0, 2, 'status: value ' || o_orderstatus || ' not in enum [F, O]' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderkey IN (SELECT o_orderkey FROM l)
UNION ALL SELECT o_orderkey, k + 1, 0, 'lines[' || k || ']: missing required field ''part''' FROM l WHERE p % 50 = 0
UNION ALL SELECT o_orderkey, k + 1, 1, 'lines[' || k || '].qty: ' || CASE WHEN q = 7 THEN 'expected integer, got string' ELSE 'value ' || q || ' > maximum 48' END FROM l WHERE q = 7 OR q > 48)
SELECT o_orderkey, string_agg(error, '; ' ORDER BY k, f) AS errors FROM e GROUP BY o_orderkey""")
def document_errors(spark, sf_dir):
    return order_documents(spark, sf_dir).select("o_orderkey", F.array_join(schema.schema_errors(F.col("d"), ORDER_SCHEMA), "; ").alias("errors"))


@query("""
WITH m AS (SELECT p_partkey AS k, 'pkg' || (p_size % 8) AS g FROM part), f AS (SELECT g, string_agg('{"kind":"file","name":"mod' || k || '.py"}', ',' ORDER BY encode('mod' || k || '.py')) AS c FROM m GROUP BY g)
SELECT '' AS path, '{"children":[{"children":[' || string_agg('{"children":[' || c || '],"kind":"folder","name":"' || g || '"}', ',' ORDER BY g) || '],"kind":"folder","name":"src"}],"kind":"folder","name":""}' AS document FROM f""")
def folder_tree(spark, sf_dir):
    files = pq.modules(spark, sf_dir).select("path", F.lit("file").alias("kind"))
    above = files.select(F.explode(nearest.folders_above(F.col("path"))).alias("path"), F.lit("folder").alias("kind")).distinct()
    nodes = files.union(above).withColumns({"name": F.element_at(F.split("path", "/"), -1), "parent": F.when(F.col("path") != "", F.regexp_replace("path", "/?[^/]*$", ""))})
    return documents.assembled(nodes, "path", "parent", ["kind", "name"], ["kind", "name"]).select("path", F.to_json("document").alias("document"))


# ---- pass rates: a user's events that are no errors, against an expected rate


@query("""
WITH u AS (SELECT user_id, count(*)::INT AS n, count(*) FILTER (event_type <> 'error')::INT AS k FROM events GROUP BY user_id), x AS (SELECT user_id, n, k, unnest(range(k, n + 1)) AS i FROM u),
t AS (SELECT user_id, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.54) + (n - i) * ln(0.46))) AS p FROM x GROUP BY ALL)
SELECT user_id, n, k, round(p, 6) AS p_value, p < 0.01 AS holds FROM t""")
def pass_rates(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("event_type") != "error").cast("int").alias("k"))
    return users.select("user_id", "n", "k", statistics.pass_rate(F.col("k"), F.col("n"), F.lit(0.9)).alias("g")).select("user_id", "n", "k", F.round("g.p_value", 6).alias("p_value"), "g.holds")
