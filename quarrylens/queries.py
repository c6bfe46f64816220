"""The operators bound to the test tables, each with SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import audit, graph, intervals, leaders, lines, relations
from .plans import evaluation, merging
from .sources.storage import stored
from .streaming import incremental, limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 by the clock that the timestamp shows."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})").cast("long")


def day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")


EPOCH = "date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))"

# ---- scans, lines, text


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('de','en') AND NOT (source LIKE 'src1%' OR source = 'src3') AND n_chars BETWEEN 200 AND 5000")
def scan_filter_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs.where(F.col("lang").isin("de", "en") & F.col("n_chars").between(200, 5000) & ~T.matches_any(F.col("source"), ["src1*", "src3"]))
    return kept.select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash16 FROM documents")
def content_hash16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash16(F.col("text")).alias("hash16"))


@query("SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_explode(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"])


@query("""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS line_no FROM s)
SELECT doc_id, line_no, array_to_string(l[greatest(line_no - 2, 1):line_no + 2], chr(10)) AS context FROM x WHERE contains(l[line_no], 'icense')""")
def line_context_frame(spark, sf_dir):
    return lines.context_frames(table(spark, sf_dir, "documents"), ["doc_id"], lambda line: F.contains(line, F.lit("icense")))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("n_lines"))


@query("SELECT lang, count(*) AS n_docs, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4)::DOUBLE / sum(n_chars)::DOUBLE, 4) AS ratio FROM documents GROUP BY lang")
def token_estimate(spark, sf_dir):
    tokens = F.sum(T.token_estimate(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), tokens.alias("tokens"), F.round(tokens / F.sum("n_chars"), 4).alias("ratio"))


@query("""
WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash16 FROM documents), g AS (SELECT hash16, min(doc_id) AS anchor, count(*) AS n FROM h GROUP BY hash16 HAVING count(*) > 1)
SELECT hash16, anchor, n, doc_id FROM h JOIN g USING (hash16)""")
def exact_dup_groups(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", T.hash16(F.col("text")).alias("hash16"))
    groups = hashed.groupBy("hash16").agg(F.min("doc_id").alias("anchor"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, "hash16").select("hash16", "anchor", "n", "doc_id")


@query("""
SELECT line, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY line HAVING count(DISTINCT doc_id) > 1""")
def near_dup_line_repeat(spark, sf_dir):
    rows = lines.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs > 1")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)
SELECT w.word, count(t.doc_id) AS n FROM w LEFT JOIN t USING (word) GROUP BY w.word""")
def reference_scan(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return lines.token_references(table(spark, sf_dir, "documents"), "doc_id", words, "word")


@query("""
WITH h AS (SELECT DISTINCT regexp_extract(lower(text), '[a-z]{8,}', 0) AS word FROM benchmark), l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(lower(line), '[a-z]+')) AS word FROM l)
SELECT doc_id, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM t JOIN h USING (word) WHERE word <> '' GROUP BY doc_id""")
def first_match_per_doc(spark, sf_dir):
    heads = table(spark, sf_dir, "benchmark").select(F.regexp_extract(F.lower("text"), "[a-z]{8,}", 0).alias("word")).where("word <> ''")
    return lines.first_match(lines.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"], heads, "word")


@query()
def chunk_overlap(spark, sf_dir):
    return lines.chunks(table(spark, sf_dir, "documents"), ["doc_id"], 1000).select("doc_id", "chunk_no", "first_line", "last_line", T.hash16(F.col("chunk")).alias("hash16"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[A-Za-z0-9.]*[A-Za-z0-9]')) AS hit FROM documents")
def email_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.EMAIL_LIKE), F.lit(0))).alias("hit"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS sum_k, max((props->>'$.k')::INT) AS max_k FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'href="([^"]*)"', 1) AS first_href, len(regexp_extract_all(html, 'href="([^"]*)"')) AS n_hrefs FROM pages""")
def html_strip_title(spark, sf_dir):
    href = F.lit('href="([^"]*)"')
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("first_href"), F.size(F.regexp_extract_all("html", href, F.lit(1))).cast("long").alias("n_hrefs")
    )


@query("""
SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'holdout' END AS split
FROM (SELECT doc_id, ('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM documents)""")
def hash_split(spark, sf_dir):
    ratios = {"train": 0.7, "val": 0.15, "holdout": 0.15}
    return table(spark, sf_dir, "documents").select("doc_id", T.split_name(F.col("doc_id").cast("string"), "42", ratios).alias("split"))


# ---- joins and sets


@query("""
WITH n AS (SELECT p_partkey, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity >= 40 AND l_returnflag = 'R') ON p_partkey = l_partkey GROUP BY p_partkey),
t AS (SELECT coalesce(least(quantile_disc(n, 0.1) FILTER (WHERE n > 0), 10), 0)::BIGINT AS threshold FROM n)
SELECT p_partkey, n, threshold FROM n, t WHERE n <= threshold""")
def low_ref_threshold(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity >= 40 AND l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"))
    counts = table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").fillna(0, ["n"])
    threshold = counts.agg(audit.nearest_rank("n", 0.1, 10).alias("threshold"))
    return counts.join(F.broadcast(threshold), F.col("n") <= F.col("threshold"))  # one row


@query("""
SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01')
UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def zero_ref_anti(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' AND l_shipdate < timestamp_ntz'1997-04-01'").select(F.col("l_partkey").alias("id")).distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(shipped, "id", "left_anti")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return relations.union_of({"part": parts, "document": docs})


@query("""
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)""")
def star_import_anti(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    named = docs.join(labels.select("doc_id"), "doc_id").select("source", F.col("doc_id").cast("string").alias("name"))
    whole = docs.join(labels.where("toxic = 1 AND quality = 0"), "doc_id").select("source", F.lit("*").alias("name"))
    return relations.unused(docs.withColumn("name", F.col("doc_id").cast("string")), named.union(whole), "source", "name").select("doc_id", "source")


@query("""
SELECT c_custkey, 'order' AS kind, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
UNION ALL SELECT c_custkey, 'event', count(*) FROM customer JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def cross_refs_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relations.union_of({"order": customers.join(orders, "c_custkey"), "event": customers.join(events, "c_custkey")})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def importers_semi(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(rich, "n_nationkey", "left_semi")


@query("SELECT l_partkey, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def fan_in(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("n_customers"))


def nation_edges(spark, sf_dir) -> DataFrame:
    """(src, dst, l_returnflag): nations of supplier and customer of each line."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    rows = rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    return rows.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), "c_custkey").select("src", "dst", "l_returnflag")


NATIONS = "SELECT s_nationkey AS src, c_nationkey AS dst, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT src, dst, bool_or(l_returnflag = 'R') AS returned, count(*) AS n FROM ({NATIONS}) GROUP BY src, dst")
def edge_agg(spark, sf_dir):
    return nation_edges(spark, sf_dir).groupBy("src", "dst").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM ({NATIONS})) SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src")
def two_hop_link(spark, sf_dir):
    return graph.two_hops(nation_edges(spark, sf_dir))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def substring_join(spark, sf_dir):
    return relations.containing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


@query("""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark), w AS (SELECT doc_id, string_split(text, ' ')[1] AS w FROM documents),
c AS (SELECT doc_id, 0 AS rank, w AS name FROM w UNION ALL SELECT doc_id, 1, lower(w) FROM w UNION ALL SELECT doc_id, 2, regexp_replace(lower(w), '[^a-z]', '', 'g') FROM w)
SELECT doc_id, arg_min(name, rank) AS name, min(rank) AS rank FROM c JOIN n USING (name) GROUP BY doc_id""")
def priority_resolve(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    word = F.get(F.split("text", " ", -1), F.lit(0))
    return relations.first_candidate(table(spark, sf_dir, "documents"), ["doc_id"], [word, F.lower(word), F.regexp_replace(F.lower(word), "[^a-z]", "")], names, "name")


@query("""
WITH s AS (SELECT DISTINCT l_partkey AS k, year(l_shipdate) AS y FROM lineitem), a AS (SELECT k FROM s WHERE y = 1996), b AS (SELECT k FROM s WHERE y = 1997)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'except_back', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def set_ops(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y"))
    a, b = (shipped.where(F.col("y") == year).select("k") for year in (1996, 1997))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_back": b.subtract(a)}
    return relations.union_of({k: df.agg(F.count("*").alias("n")) for k, df in ops.items()}, "op")


@query("""
WITH e AS (SELECT event_id, user_id, ts::DATE = (SELECT max(ts::DATE) FROM events) AS now FROM events), ran AS (SELECT DISTINCT user_id FROM e WHERE now)
SELECT event_id, user_id, 'previous' AS origin FROM e WHERE NOT now AND user_id NOT IN (SELECT user_id FROM ran) UNION ALL SELECT event_id, user_id, 'current' FROM e WHERE now""")
def producer_merge(spark, sf_dir):
    """Users with events on the last day ran again: their earlier rows are replaced."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    last = events.agg(F.max("day").alias("last"))
    dated = events.join(F.broadcast(last)).withColumn("now", F.col("day") == F.col("last"))  # one row
    current = dated.where("now").select("event_id", "user_id", F.lit("current").alias("origin"))
    return relations.replace_partitions(dated.where("NOT now").select("event_id", "user_id", F.lit("previous").alias("origin")), current, "user_id", current.select("user_id").distinct(), "event_id")


@query("""
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 <> 0 THEN substr(sha256(text), 1, 16) END AS f FROM documents),
c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE substr(sha256(text), 1, 16) END AS f FROM documents WHERE doc_id % 2 = 0)
SELECT lang, count(*) AS n, count(c.doc_id) AS hits, round(count(c.doc_id)::DOUBLE / count(*), 6) AS hit_rate FROM d LEFT JOIN c ON d.doc_id = c.doc_id AND d.f = c.f GROUP BY lang""")
def verdict_cache_probe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.hash16(F.col("text")).alias("h"))
    cache = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("h")).alias("f"))
    probed = relations.cache_probe(docs.select("doc_id", "lang", F.when(F.col("doc_id") % 7 != 0, F.col("h")).alias("f")), cache, "doc_id", "f")
    hits = F.count_if("hit")
    return probed.groupBy("lang").agg(F.count("*").alias("n"), hits.alias("hits"), F.round(hits / F.count("*"), 6).alias("hit_rate"))


@query("""
SELECT d.doc_id, quality, toxic, len(string_split(text, chr(10))) AS n_lines FROM documents d LEFT JOIN labels USING (doc_id)""")
def file_metrics_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", T.line_count(F.col("text")).alias("n_lines"))
    return docs.select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(counted, "doc_id", "left").select("doc_id", "quality", "toxic", "n_lines")


# ---- intervals


def episodes(spark, sf_dir, unit: int = 60) -> DataFrame:
    start = F.floor(seconds("ts") / unit)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.floor("value").cast("long")).alias("end"))


EPISODES = f"SELECT event_id, user_id, event_type, {EPOCH} // 60 AS s, {EPOCH} // 60 + floor(value)::BIGINT AS e FROM events"


@query(f"""
WITH i AS (SELECT event_id AS episode, user_id, {EPOCH} AS s, {EPOCH} + floor(value)::BIGINT * 60 AS e FROM events WHERE event_type = 'error'),
p AS (SELECT event_id, user_id, {EPOCH} AS t FROM events WHERE event_type = 'click')
SELECT event_id, arg_min(episode, (e - s, episode)) AS episode FROM p JOIN i ON p.user_id = i.user_id AND t BETWEEN s AND e GROUP BY event_id""")
def range_join_smallest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("at"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("episode"), F.col("at").alias("start"), (F.col("at") + F.floor("value").cast("long") * 60).alias("end"))
    return intervals.smallest_enclosing(events.where("event_type = 'click'"), errors, "user_id", "at", "event_id", "episode", "start", "end", 3600)


@query("""
SELECT o_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS ship_day, arg_min(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 365 DAY GROUP BY o_orderkey""")
def range_contain_first(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"))
    found = intervals.first_containing(orders, items, "o_orderkey", inside, ["o_orderkey"], ["l_shipdate", "l_linenumber"])
    return found.select("o_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"), "l_linenumber")


ISLANDS = """
WITH r AS (SELECT {keys}, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e FROM lineitem),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM r),
g AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f), m AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM g GROUP BY {keys}, i)
"""


def ship_ranges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", day("l_shipdate").alias("s"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("e"))


@query(ISLANDS.format(keys="l_partkey") + "SELECT l_partkey, s, e FROM m")
def merge_intervals(spark, sf_dir):
    return intervals.merge_intervals(ship_ranges(spark, sf_dir), ["l_partkey"], "s", "e")


@query(ISLANDS.format(keys="l_partkey, l_returnflag") + "SELECT l_partkey, l_returnflag, sum(e - s + 1)::BIGINT AS covered FROM m GROUP BY l_partkey, l_returnflag")
def covered_by_flag(spark, sf_dir):
    return intervals.covered(ship_ranges(spark, sf_dir), ["l_partkey", "l_returnflag"], "s", "e")


PAIRS = f"SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM ({EPISODES}) a JOIN ({EPISODES}) b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type AND a.s <= b.e AND b.s <= a.e"


def episode_pairs(spark, sf_dir) -> DataFrame:
    return intervals.overlap_pairs(episodes(spark, sf_dir), "user_id", "event_id", "start", "end", 120, "event_type")


@query(PAIRS)
def interval_overlap_pairs(spark, sf_dir):
    return episode_pairs(spark, sf_dir)


@query(f"""
WITH RECURSIVE p AS ({PAIRS}), x AS (SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p),
r(node, other) AS (SELECT src, src FROM x UNION SELECT r.node, x.dst FROM r JOIN x ON r.other = x.src),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT component, count(*) AS n_nodes, count(DISTINCT event_type) AS n_types FROM c JOIN events ON node = event_id GROUP BY component""")
def overlap_components(spark, sf_dir):
    pairs = episode_pairs(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = graph.components(pairs).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), "event_type"), "node")
    return found.groupBy("component").agg(F.count("*").alias("n_nodes"), F.countDistinct("event_type").alias("n_types"))


# ---- graphs


def supply_graph(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return graph.both_ways(rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))


def seed(spark, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "node string")


@query("""
WITH RECURSIVE o AS (SELECT DISTINCT 's' || l_suppkey::VARCHAR AS a, 'p' || l_partkey::VARCHAR AS b FROM lineitem), x AS (SELECT a AS src, b AS dst FROM o UNION ALL SELECT b, a FROM o),
r(node) AS (SELECT DISTINCT src FROM x WHERE src = 's1' UNION SELECT x.dst FROM r JOIN x ON r.node = x.src) SELECT node FROM r""")
def bfs_reach(spark, sf_dir):
    return graph.reachable(supply_graph(spark, sf_dir), seed(spark, "s1")).select("node")


TREE = """
x AS (SELECT 'r' || n_regionkey::VARCHAR AS src, 'n' || n_nationkey::VARCHAR AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey::VARCHAR, 'c' || c_custkey::VARCHAR FROM customer
UNION ALL SELECT 'c' || o_custkey::VARCHAR, 'o' || o_orderkey::VARCHAR FROM orders)"""


@query(f"WITH RECURSIVE {TREE}, r(node) AS (SELECT 'r0' UNION SELECT x.dst FROM r JOIN x ON r.node = x.src) SELECT src AS node FROM x WHERE src NOT IN (SELECT node FROM r) UNION SELECT dst FROM x WHERE dst NOT IN (SELECT node FROM r)")
def unreachable(spark, sf_dir):
    """Nations, customers and orders that a region does not lead to."""

    def edges(name: str, a: str, above: str, b: str, own: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), above).alias("src"), F.concat(F.lit(b), own).alias("dst"))

    tree = edges("nation", "r", "n_regionkey", "n", "n_nationkey").union(edges("customer", "n", "c_nationkey", "c", "c_custkey")).union(edges("orders", "c", "o_custkey", "o", "o_orderkey"))
    return graph.unreachable(tree, seed(spark, "r0"))


# ---- ranking and windows


@query("""
SELECT l_suppkey, l_extendedprice, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rank, count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem) WHERE rank <= 3""")
def topn_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return relations.top_per_group(rows, ["l_suppkey"], order, 3).select("l_suppkey", "l_extendedprice", F.col("rank").cast("long").alias("rank"), "total")


@query("""
WITH f AS (SELECT user_id, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, arg_min(event_id, (abs(event_id - first_id), event_id)) AS event_id FROM events JOIN f USING (user_id) WHERE event_id <> first_id GROUP BY user_id""")
def nearest_row(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = events.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("at"))
    return relations.nearest(events, first, "user_id", "event_id", "at")


@query("""
SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def dedupe_keep_first(spark, sf_dir):
    return relations.keep_first(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"])


@query("""
WITH s AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations)
SELECT conv_id, block::BIGINT AS block, min(turn) AS first, max(turn) AS last, count(*) AS n FROM s GROUP BY conv_id, block""")
def block_segment(spark, sf_dir):
    return relations.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")


@query("""
WITH g AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)
SELECT doc_id, source, (row_number() OVER (ORDER BY f, source, doc_id) - 1) // 12 AS batch FROM documents JOIN g USING (source)""")
def batching_12(spark, sf_dir):
    return relations.batches(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 12)


# ---- aggregates, findings, verdicts


def audits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    id_ = F.when(F.col("value") >= 100, F.concat_ws(":", "user_id", "event_type"))
    rows = events.select(F.col("event_id").alias("ord"), id_.alias("finding_id"), F.concat_ws(":", "user_id", "event_type", F.floor(F.col("value") / 20).cast("string")).alias("composite"), (F.from_json("props", "k int")["k"] >= 50).alias("dismissed"))
    return rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1")


CLOSURE = """
WITH r AS (SELECT event_id AS ord, CASE WHEN value >= 100 THEN user_id::VARCHAR || ':' || event_type END AS id, user_id::VARCHAR || ':' || event_type || ':' || floor(value / 20)::BIGINT::VARCHAR AS comp, (props->>'$.k')::INT >= 50 AS dismissed FROM events),
b AS (SELECT * FROM r WHERE ord % 2 = 0), c AS (SELECT * FROM r WHERE ord % 2 = 1),
b1 AS (SELECT ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM b WHERE id IS NOT NULL), c1 AS (SELECT ord, id, dismissed, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM c WHERE id IS NOT NULL),
p1 AS (SELECT b1.ord AS b, c1.ord AS c, dismissed FROM b1 JOIN c1 USING (id, n)),
lb AS (SELECT * FROM b WHERE ord NOT IN (SELECT b FROM p1)), lc AS (SELECT * FROM c WHERE ord NOT IN (SELECT c FROM p1)),
b2 AS (SELECT ord, comp, row_number() OVER (PARTITION BY comp ORDER BY ord) AS n FROM lb), c2 AS (SELECT ord, comp, dismissed, row_number() OVER (PARTITION BY comp ORDER BY ord) AS n FROM lc),
p2 AS (SELECT b2.ord AS b, c2.ord AS c, dismissed FROM b2 JOIN c2 USING (comp, n)), p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
x AS (SELECT CASE WHEN dismissed THEN 'closed_by_dismissal' ELSE 'still_open' END AS bucket, b, c FROM p
UNION ALL SELECT 'closed', ord, NULL FROM lb WHERE ord NOT IN (SELECT b FROM p2) UNION ALL SELECT 'new', NULL, ord FROM lc WHERE ord NOT IN (SELECT c FROM p2))
"""


@query(CLOSURE + "SELECT bucket, b, c FROM x")
def closure_diff(spark, sf_dir):
    return audit.closure(*audits(spark, sf_dir), "finding_id", "composite", "ord", "dismissed")


@query(CLOSURE + "SELECT bucket, count(*) AS n FROM x GROUP BY bucket")
def closure_counts(spark, sf_dir):
    return closure_diff(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, count(*) AS n, count(k) AS covered, round(100.0 * count(k)::DOUBLE / count(*), 4) AS pct FROM part
LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01') ON k = p_partkey GROUP BY p_brand""")
def coverage_pct(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' AND l_shipdate < timestamp_ntz'1997-04-01'").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("k")).distinct()
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(shipped, "p_partkey", "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("k").alias("covered"), F.round(F.count("k") * 100.0 / F.count("*"), 4).alias("pct"))


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS others,
NOT bool_or(event_type = 'error' AND value > 200) AS passed FROM events GROUP BY 1""")
def severity_counts(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(kind == "error").alias("errors"), F.count_if(kind == "click").alias("clicks"), F.count_if(~kind.isin("error", "click")).alias("others"), (~F.bool_or((kind == "error") & (F.col("value") > 200))).alias("passed")
    )


HEALTH = """
WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS others, count(*) FILTER (WHERE value < 5) AS junk FROM events GROUP BY user_id),
h AS (SELECT user_id, n, errors, others, pow(0.8::DOUBLE, errors) * pow(0.95::DOUBLE, others) * CASE WHEN junk > 0 THEN greatest(0.0::DOUBLE, 0.8::DOUBLE - least(junk::DOUBLE / n, 1.0::DOUBLE)) ELSE 1.0::DOUBLE END AS h FROM u)
"""


def user_health(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "signup").alias("others"), F.count_if(F.col("value") < 5).alias("junk"))
    return users.withColumn("h", audit.file_health(F.col("errors"), F.col("others"), F.col("junk") / F.col("n")))


@query(HEALTH + "SELECT user_id, errors, others, round(h, 6) AS health FROM h")
def health_score(spark, sf_dir):
    return user_health(spark, sf_dir).select("user_id", "errors", "others", F.round("h", 6).alias("health"))


@query(HEALTH + "SELECT round(sum(n * h) / sum(n), 6) AS health FROM h")
def health_mean(spark, sf_dir):
    return user_health(spark, sf_dir).agg(F.round(audit.weighted_mean(F.col("h"), F.col("n")), 6).alias("health"))


@query("""
WITH v AS (SELECT user_id, event_type, (props->>'$.k') || '-' || floor(value / 50)::BIGINT::VARCHAR AS v FROM events), c AS (SELECT DISTINCT user_id, v FROM v WHERE event_type = 'error'),
p AS (SELECT v, count(DISTINCT user_id) AS m, min(user_id) AS one FROM v WHERE event_type = 'purchase' GROUP BY v),
k AS (SELECT user_id, count(*) AS checked, count(*) FILTER (WHERE m > 1 OR one <> user_id) AS matched FROM c LEFT JOIN p USING (v) GROUP BY user_id)
SELECT user_id, checked, matched, checked - matched AS unmatched, round(matched::DOUBLE / checked, 2) AS confidence FROM k WHERE matched > 0 AND checked > matched""")
def ratio_violation(spark, sf_dir):
    value = F.concat_ws("-", F.from_json("props", "k int")["k"].cast("string"), F.floor(F.col("value") / 50).cast("string"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", value.alias("v"))
    produced = rows.where("event_type = 'purchase'").select("v", F.col("user_id").alias("producer"))
    return audit.ratio_violations(rows.where("event_type = 'error'"), "user_id", "v", produced)


@query("""
WITH l AS (SELECT l_partkey AS value, s_nationkey AS producer, c_nationkey AS consumer FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
m AS (SELECT value, producer, count(*) AS n FROM l GROUP BY value, producer), k AS (SELECT DISTINCT value, consumer FROM l),
r AS (SELECT a.n_nationkey AS producer, b.n_nationkey AS consumer FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
p AS (SELECT * FROM m JOIN k USING (value) WHERE producer <> consumer AND NOT EXISTS (SELECT 1 FROM r WHERE r.producer = m.producer AND r.consumer = k.consumer))
SELECT value, consumer, arg_max(producer, (n, producer)) AS producer, max(n) AS n FROM p GROUP BY value, consumer""")
def fragile_pairs(spark, sf_dir):
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("consumer"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(homes, "o_custkey").select("l_orderkey", "consumer")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    rows = rows.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("producer")), "l_suppkey")
    # both sides read them, so lines meet their orders once; dealt by value, they need no further shuffle
    rows = stored(rows.join(orders, "l_orderkey").select(F.col("l_partkey").alias("value"), "producer", "consumer"), "met").repartition("value")
    nations = table(spark, sf_dir, "nation")
    same = nations.select(F.col("n_nationkey").alias("producer"), "n_regionkey").join(nations.select(F.col("n_nationkey").alias("consumer"), "n_regionkey"), "n_regionkey").select("producer", "consumer")
    return audit.fragile_pairs(rows, rows, same)


@query("""
WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), ',') AS v FROM lineitem GROUP BY l_orderkey)
SELECT v AS "values", min(l_orderkey) AS anchor, count(*) AS n FROM s GROUP BY v""")
def contract_cluster(spark, sf_dir):
    return audit.clusters_by_set(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""
WITH v AS (SELECT lang, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'dismissed' END AS e, CASE WHEN n_chars > 1500 THEN 'confirmed' WHEN n_chars > 500 THEN 'dismissed' WHEN n_chars > 200 THEN 'uncertain' END AS v, toxic = 1 AS g FROM documents JOIN labels USING (doc_id)),
a AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT g AND v IS NOT NULL AND e = 'confirmed') AS pc, count(*) FILTER (WHERE NOT g AND v = 'confirmed' AND e = 'confirmed') AS tp,
count(*) FILTER (WHERE NOT g AND v IS NOT NULL AND e = 'dismissed') AS nc, count(*) FILTER (WHERE NOT g AND v = 'confirmed' AND e = 'dismissed') AS fp,
count(*) FILTER (WHERE NOT g AND v IS NOT NULL) AS d, count(*) FILTER (WHERE NOT g AND v = e) AS ok, count(*) FILTER (WHERE v = 'uncertain') AS unc, count(*) FILTER (WHERE v IS NULL) AS und FROM v GROUP BY lang)
SELECT lang, n, round(coalesce(tp::DOUBLE / nullif(pc, 0), 0), 6) AS tp_rate, round(coalesce(fp::DOUBLE / nullif(nc, 0), 0), 6) AS fp_rate, round(coalesce(ok::DOUBLE / nullif(d, 0), 0), 6) AS accuracy,
round(unc::DOUBLE / n, 6) AS uncertain_rate, round(und::DOUBLE / n, 6) AS undecided_rate FROM a""")
def eval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    verdicts = rows.select("lang", F.when(F.col("quality") == 1, "confirmed").otherwise("dismissed").alias("expected"), F.when(n > 1500, "confirmed").when(n > 500, "dismissed").when(n > 200, "uncertain").alias("verdict"), (F.col("toxic") == 1).alias("gray"))
    found = audit.eval_metrics(verdicts, ["lang"])
    return found.select("lang", "n", *(F.round(c, 6).alias(c) for c in found.columns if c not in ("lang", "n")))


@query("""
WITH v AS (SELECT user_id, event_type, CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' END AS v FROM events), c AS (SELECT user_id, event_type, v, count(*) AS c FROM v GROUP BY ALL)
SELECT user_id, event_type, sum(c)::BIGINT AS n, count(*) AS "distinct", round(max(c)::DOUBLE / sum(c)::DOUBLE, 6) AS modal_share, count(*) > 1 AS flipped FROM c GROUP BY user_id, event_type HAVING sum(c) >= 2""")
def resample_flip(spark, sf_dir):
    verdict = F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", verdict.alias("verdict"))
    return audit.resample(rows, ["user_id", "event_type"], "verdict").withColumn("modal_share", F.round("modal_share", 6))


BOUNDS = [("click", 0.0, 10.0), ("view", 100.0, 1000.0), ("error", 60.0, 1.0), ("signup", 0.0, 1000.0), ("other", 0.0, 1.0)]


@query(f"""
WITH m AS (SELECT event_type AS metric, round(avg(value), 4) AS value FROM events GROUP BY 1), b(metric, low, high) AS (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in BOUNDS)})
SELECT metric, value, CASE WHEN low > high THEN 'malformed' WHEN value < low THEN 'below' ELSE 'above' END AS problem FROM m JOIN b USING (metric) WHERE low > high OR value < low OR value > high""")
def threshold_gate(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 4).alias("value"))
    return audit.threshold_gate(metrics, spark.createDataFrame(BOUNDS, "metric string, low double, high double"))


@query("""
SELECT event_id, 'value_range' AS rule FROM events WHERE NOT value BETWEEN 0 AND 300 UNION ALL SELECT event_id, 'known_type' FROM events WHERE event_type NOT IN ('click', 'view', 'error', 'signup')
UNION ALL SELECT event_id, 'small_k' FROM events WHERE NOT (props->>'$.k')::INT < 95""")
def schema_validate(spark, sf_dir):
    rules = {"value_range": F.col("value").between(0, 300), "known_type": F.col("event_type").isin("click", "view", "error", "signup"), "small_k": F.from_json("props", "k int")["k"] < 95}
    return audit.violations(table(spark, sf_dir, "events"), ["event_id"], rules)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, substr(sha256(o_orderkey::VARCHAR || ':' || o_orderstatus), 1, 16) AS d FROM orders),
c AS (SELECT o_custkey AS c_custkey, substr(sha256(array_to_string(list_sort(list(o_orderkey::VARCHAR || ':' || d)), chr(10))), 1, 16) AS d FROM o GROUP BY 1),
n AS (SELECT c_nationkey AS n_nationkey, substr(sha256(array_to_string(list_sort(list(c_custkey::VARCHAR || ':' || d)), chr(10))), 1, 16) AS d FROM c JOIN customer USING (c_custkey) GROUP BY 1)
SELECT n_regionkey AS r_regionkey, substr(sha256(array_to_string(list_sort(list(n_nationkey::VARCHAR || ':' || d)), chr(10))), 1, 16) AS digest FROM n JOIN nation USING (n_nationkey) GROUP BY 1""")
def merkle_rollup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", T.hash16(F.concat_ws(":", "o_orderkey", "o_orderstatus")).alias("digest"))
    customers = audit.rollup_hash(orders, "c_custkey", "o_orderkey", "digest").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    nations = audit.rollup_hash(customers, "n_nationkey", "c_custkey", "digest").join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
    return audit.rollup_hash(nations, "r_regionkey", "n_nationkey", "digest")


@query("""
SELECT p_partkey, score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS label FROM
(SELECT p_partkey, (CASE WHEN p_size > 40 THEN 4 ELSE 0 END + CASE WHEN p_retailprice > 950 THEN 3 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END)::BIGINT AS score FROM part)""")
def priority_score(spark, sf_dir):
    score, label = audit.priority([(F.col("p_size") > 40, 4), (F.col("p_retailprice") > 950, 3), (F.col("p_type") == "ECONOMY", 2), (F.contains("p_name", F.lit("ring")), 1)], 6, 3)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), label.alias("label"))


@query("""
WITH RECURSIVE u AS (SELECT user_id, user_id % 8 AS scope, coalesce(list(DISTINCT strftime(ts, '%d')) FILTER (event_type = 'error'), []) AS days, coalesce(list(DISTINCT strftime(ts, '%H')) FILTER (event_type = 'signup'), []) AS hours FROM events GROUP BY user_id),
o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY user_id) AS k FROM u),
r AS (SELECT scope, k, user_id, user_id AS leader, [{'o': user_id, 'd': days, 'h': hours}] AS ls FROM o WHERE k = 1
UNION ALL SELECT scope, k, user_id, coalesce(hit, user_id), CASE WHEN hit IS NULL THEN ls || [{'o': user_id, 'd': days, 'h': hours}] ELSE ls END FROM
(SELECT o.*, r.ls, list_filter(r.ls, lambda x: len(list_intersect(x.d, o.days)) > 0.5 * least(len(x.d), len(o.days)) AND len(list_intersect(x.h, o.hours)) > 0)[1].o AS hit FROM r JOIN o ON o.scope = r.scope AND o.k = r.k + 1))
SELECT user_id, leader FROM r""")
def leader_cluster(spark, sf_dir):
    def spoken(kind: str, pattern: str) -> Column:
        return F.collect_set(F.when(F.col("event_type") == kind, F.date_format("ts", pattern)))

    users = table(spark, sf_dir, "events").groupBy("user_id").agg(spoken("error", "dd").alias("days"), spoken("signup", "HH").alias("hours"))
    return leaders.leader_clusters(users.withColumn("scope", F.col("user_id") % 8), "user_id", "days", tags="hours", scope=("scope",))


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id, event_type")
def stream_incremental(spark, sf_dir):
    return incremental.replayed(spark, f"{sf_dir}/events.parquet")


# ---- budgets, splits, agreement


@query("""
SELECT source, doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 40000""")
def running_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return merging.ranked_within(docs, ["source"], [F.col("doc_id")], "n_chars", 40_000)


@query("""
WITH w AS (SELECT user_id, event_id, list_sort(list(length(props) * 40 + floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS l FROM events)
SELECT user_id AS key, event_id AS ord, ceil(greatest(l[ceil(len(l) * 0.9)::INT] * 1.2::DOUBLE, list_avg(l) * 1.35::DOUBLE, 128.0::DOUBLE))::BIGINT AS reserve FROM w""")
def output_reservation(spark, sf_dir):
    tokens = F.length("props") * 40 + F.floor("value").cast("long")
    return limits.reservations(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), tokens.alias("tokens")))


@query("""
SELECT doc_id AS slug, 'no split' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id + 5 FROM labels)
UNION ALL SELECT doc_id + 5, 'no case' FROM labels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents)""")
def split_coverage(spark, sf_dir):
    cases = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"))
    splits = table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("slug"))
    return evaluation.split_coverage(cases, splits)


@query("""
SELECT lang AS category, count(*) AS n, round(avg((quality = (n_chars > 300)::INT)::INT), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def bootstrap_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    entries = rows.select(F.col("lang").alias("category"), F.col("quality").alias("expected"), (F.col("n_chars") > 300).cast("int").alias("verdict"))
    return evaluation.agreement(entries).withColumn("rate", F.round("rate", 6))


@query()
def request_windows(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), seconds("ts").cast("double").alias("at"), F.length("props").cast("long").alias("tokens"))
    return limits.request_windows(log, 3600.0 * 24)
