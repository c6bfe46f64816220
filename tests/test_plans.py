"""Evidence, concepts, traces and limits on small tables."""

import collections
import json
import random

from pyspark.sql import functions as F

from quarrylens.plans import concepts, detectors, evidence, traces
from quarrylens.plans import facts as fx
from quarrylens.streaming import limits

from .conftest import rows


def test_references_show_some_and_count_all(spark):
    files = spark.createDataFrame([("a/x.py", "def f(): pass"), ("a/y.py", "\n".join(["f()"] * 9)), ("b/z.py", "g(f)")], "path string, text string")
    found = spark.createDataFrame([("1", "a/x.py", "f", 1, "")], "id string, path string, symbol string, line_start int, message string")
    ((_, payload),) = rows(evidence.references(found, files))
    got = json.loads(payload)
    assert got["total"] == 10 and got["files"] == 2 and [h["file"] for h in got["hits"]] == ["a/y.py"] * 3 + ["b/z.py"]


def test_needles_and_names(spark):
    df = spark.createDataFrame([("1", "p", None, "see `a.bcd()` and `x`"), ("2", "p", None, "the 'key one' is"), ("3", "p", "s", "`q`")], "id string, path string, symbol string, message string")
    assert rows(evidence.needles(df), "id", "needle") == [("1", "a.bcd"), ("1", "bcd"), ("1", "x"), ("2", "key one"), ("3", "s")]


def test_smallest_enclosing_symbol(spark):
    files = spark.createDataFrame([("p", "\n".join(f"l{k}" for k in range(1, 40)))], "path string, text string")
    symbols = spark.createDataFrame([("p", "C", 1, 30), ("p", "C.m", 10, 15), ("p", "D", 31, 39)], "path string, name string, line_start int, line_end int")
    found = spark.createDataFrame([("1", "p", 12)], "id string, path string, line_start int")
    got = json.loads(rows(evidence.surrounding(found, files, symbols))[0][1])
    assert got["enclosing"] == "C.m" and got["code"].startswith("2\tl2\n") and got["code"].endswith("22\tl22")


def test_overlapping_claims(spark):
    data = [("1", "p", "a", 1, 3), ("2", "p", "b", 3, 5), ("3", "p", "a", 5, 6), ("4", "p", "a", 1, 2), ("5", "q", "b", 1, 9)]
    df = spark.createDataFrame(data, "id string, path string, detector string, line_start int, line_end int")
    assert rows(evidence.overlapping_claims(df)) == [("1", "1"), ("2", "1"), ("3", "1")]


def test_concepts(spark):
    given = spark.createDataFrame([("c1", ["a", "b"], ["guide", "reference"], 6, 12), ("c2", ["z"], ["guide"], 0, 0)], "concept_id string, source_files array<string>, appropriate_types array<string>, fan_in int, public_count int")
    docs = spark.createDataFrame([("d", "guide", ["b"])], "path string, classification string, matched array<string>")
    covered = concepts.coverage(given, docs)
    assert rows(covered, "concept_id", "missing") == [("c1", ["reference"]), ("c2", ["guide"])]
    assert rows(concepts.summary(covered)) == [("guide", 2, 1), ("reference", 1, 0)]
    assert [(r.concept_id, r.score, r.label) for r in concepts.priorities(covered).collect()] == [("c1", 5, "medium"), ("c2", 3, "medium")]
    assert rows(concepts.shared_gaps(spark.createDataFrame([("l", ["a", "b"]), ("l", ["b"])], "leader string, missing array<string>"))) == [("l", ["b"])]


def test_windows_start_with_a_request(spark):
    log = spark.createDataFrame([("k", float(t), 1) for t in (0, 10, 59, 61, 100, 122)], "key string, at double, tokens long")
    assert [(r["window"], r.in_window) for r in limits.request_windows(log).orderBy("at").collect()] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 1)]


def test_bucket_refills(spark):
    log = spark.createDataFrame([("k", 0.0, 60), ("k", 30.0, 30), ("k", 30.5, 30)], "key string, at double, tokens long")
    assert [(r.wait, r.left) for r in limits.token_bucket(log, 60).orderBy("at").collect()] == [(0.0, 0.0), (0.0, 0.0), (29.5, 0.0)]


def test_reservations(spark):
    log = spark.createDataFrame([("k", i, 100 * (i + 1)) for i in range(10)], "key string, ord int, tokens long")
    assert [r.reserve for r in limits.reservations(log).orderBy("ord").collect()][-1] == 1080


def test_traces(spark):
    data = [("s1", "c", 0, "grep", "needle"), ("s1", "c", 1, "read", "finding"), ("s2", "c", 0, "read", "finding")]
    events = spark.createDataFrame(data, "slug string, category string, seq int, action string, kind string")
    ((_, n, mean, median, top, firsts),) = rows(traces.distributions(events))
    assert (n, mean, median, top, firsts) == (2, 1.5, 1.5, 2, {"grep": 1, "read": 1})
    assert rows(traces.proposal(traces.presence(events))) == [("c", "finding", "required"), ("c", "needle", "optional")]
    found = spark.createDataFrame([("s", 0, ["a"]), ("s", 1, None), ("s", 2, ["b"])], "slug string, seq int, found array<string>")
    assert rows(traces.with_earlier_hits(found), "seq", "hits") == [(0, []), (1, ["a"]), (2, ["a"])]
    kind = traces.search_kind(F.col("p"), F.array(F.lit("foo")))
    assert [r[0] for r in spark.createDataFrame([("foo.*",), ("class X",), ("import y",), ("z",)], "p string").select(kind).collect()] == ["needle", "definition", "import", "other"]


def test_imports_of_many_files_meet_by_bases_and_without_broadcasts(spark):
    imports = [("a/x.py", [("./y", ["f"]), ("../b/z", ["*"]), ("b.z", ["g"]), ("z", ["g"]), ("os", ["path"]), (".y", ["f"]), ("../../b/z", ["g"]), (None, ["g"])]), ("b/z.py", None), ("src/b/z.py", None), ("a/y/__init__.py", None), ("b/y.py", [("./y", ["f"])])]
    known = spark.createDataFrame([(p, [(s, n, None) for s, n in i] if i else [], [("g", "function", 1)], []) for p, i in imports], "path string, imports array<struct<source:string,names:array<string>,name_map:map<string,string>>>, exports array<struct<name:string,kind:string,line:int>>, calls array<struct<to:string,line:int>>")
    known = known.withColumn("imports", F.transform("imports", lambda x: x.withField("line", F.lit(1)))).withColumn("member_writes", F.array().cast("array<struct<member:string,line:int>>"))
    found = fx.resolved_imports(known, known)
    assert found.columns == ["path", "source", "names", "name_map", "line", "target"]
    expected = {("a/x.py", "./y", "a/y/__init__.py"), ("a/x.py", "../b/z", "b/z.py"), ("a/x.py", "b.z", "b/z.py"), ("a/x.py", "z", "b/z.py"), ("a/x.py", "os", None), ("a/x.py", ".y", "a/y/__init__.py"), ("a/x.py", "../../b/z", "b/z.py"), ("a/x.py", None, None), ("b/y.py", "./y", "b/y.py")}
    assert {tuple(r) for r in found.select("path", "source", "target").collect()} == expected
    for made in (found, fx.unused_exports(known, found), fx.cross_references(known, found, known.select("path", F.lit("g").alias("name"))), fx.importers(found, known)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_implicit_contracts_of_linked_producers(spark):
    """Every pair of a value's producers and consumers, by brute force, on a graph in which many first producers are linked."""
    rng = random.Random(7)
    files = [f"src/m{k}.py" for k in range(30)]
    imports = {(rng.choice(files), rng.choice(files)) for _ in range(25)}
    uses = [(rng.choice(files), f"value{rng.randrange(12)}", rng.choice(["produced", "produced", "checked", "defined", "defined"])) for _ in range(400)]
    near = {(a, a) for a in files} | imports | {(b, a) for a, b in imports}
    near |= {(a, d) for a, b in near for c, d in near if b == c}
    of = lambda usage: {(p, v) for p, v, u in uses if u == usage}
    counts, expected = collections.Counter((v, p) for p, v, u in uses if u == "produced"), []
    linked = 0
    for consumer, value in of("checked"):
        loose = [(n, p) for (v, p), n in counts.items() if v == value and p != consumer]
        free = [x for x in loose if not any(v == value and (d, x[1]) in near and (d, consumer) in near for d, v in of("defined"))]
        linked += bool(loose) and (not free or max(loose) != max(free))
        if free:
            expected.append((value, consumer, max(free)[1], max(free)[0]))
    assert linked > 10 and len(expected) > 20
    literals = [(p, [(v, u) for q, v, u in uses if q == p]) for p in files]
    facts = spark.createDataFrame(literals, "path string, string_literals array<struct<value:string,usage:string>>")
    resolved = spark.createDataFrame([(a, b) for a, b in imports] + [("src/m1.py", None)], "path string, target string")
    assert rows(detectors.implicit_contracts(facts, resolved), "value", "consumer", "producer", "n") == sorted(expected, key=repr)
