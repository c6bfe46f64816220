import json

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import evidence, registry, reports

from .conftest import rows


def test_roots_and_origins(spark):
    df = spark.createDataFrame([("a.b[0]",), ("f(x).y",), (" k [1]",), ("",), (None,)], "e string")
    assert [r[0] for r in df.select(reports.comparison_root(F.col("e"))).collect()] == ["a", "f", "k", "", ""]
    imports = spark.createDataFrame([("m", "os.path", None, ["join"]), ("m", "./own", None, ["x"]), ("m", "lib", "lib.py", ["y"]), ("n", "all", None, ["*"])], "path string, source string, target string, names array<string>")
    checked = spark.createDataFrame([("m", x) for x in ("join", "path", "x", "y", "window", "")] + [("n", "any")], "path string, root string")
    assert rows(reports.external_origin(checked, imports, ["window"]), "root", "external") == sorted([("join", True), ("path", True), ("x", False), ("y", False), ("window", True), ("", False), ("any", True)], key=repr)


def test_noise(spark):
    df = spark.createDataFrame([("open FILE x", "f", "f"), ("d[k] of json", "data", "data"), ("d[k] of json", "d", "d"), ("http header", "x", "x"), ("", "o", "getattr(o, 'k')"), ("plain", "s", None)], "t string, r string, s string")
    found = df.select(reports.noise(F.col("t"), F.col("r"), F.col("s"), (["path"], ["file"]), (["data"], ["json"]), ["header"]))
    assert [r[0] for r in found.collect()] == [True, True, False, True, True, False]


def test_names(spark):
    df = spark.createDataFrame([("doc:stale", "a/b.py", "uncategorized", "contract"), ("debris:dead", "x.TSX", "uncategorized", "other"), ("own", "Makefile", "kept", "contract"), ("", "a.zig", None, None)], "d string, p string, g string, a string")
    assert rows(df.select(reports.category_of(F.col("d")).alias("c"), reports.language_of(F.col("p")).alias("l"), reports.split_gap(F.col("g"), F.col("a")).alias("g"))) == sorted([("doc_stale", "python", "contract"), ("dead", "typescript", "uncategorized"), ("own", "unknown", "kept"), ("uncategorized", "zig", None)], key=repr)


def test_search_hits(spark):
    df = spark.createDataFrame([("s", "a.py:3: x\na.py:1: y\nnoise\nb.py:2: z"), ("t", "No matches for a.py:3: x")], "slug string, output string")
    assert rows(reports.search_hits(df)) == [("s", "a.py", [1, 3]), ("s", "b.py", [2])]


def test_snapshots(spark):
    files = spark.createDataFrame([("a.py",), ("c/case1/x.py",), ("c/case1/deep/y.py",), ("c/other/z.py",)], "path string")
    cases = spark.createDataFrame([("c/case1", "corpus-case/2"), ("c/other", "else/1")], "folder string, schema string")
    assert rows(reports.outside_snapshots(files, cases)) == [("a.py",), ("c/other/z.py",)]


def test_document_sources(spark):
    docs = spark.createDataFrame([(1, "see src/app/core.py now"), (2, "call app.core.run or util.py"), (3, "nothing, a.py")], "doc int, text string")
    sources = spark.createDataFrame([("src/app/core.py",), ("lib/util.py",), ("a.py",), ("b",)], "path string")
    assert rows(reports.document_sources(docs, sources)) == [(1, "src/app/core.py"), (2, "lib/util.py"), (2, "src/app/core.py"), (3, "a.py")]


def test_stale_warnings_are_put_once_and_stripped(spark):
    text = "@source: a\n@hash: b\n\nBody\n\nmore"
    df = spark.createDataFrame([(text,), ("no header",)], "t string")
    one = df.select(reports.with_warning(F.col("t"), F.lit("stale")).alias("t"))
    two = one.select(reports.with_warning(F.col("t"), F.lit("stale")).alias("t"))
    both = two.select(reports.with_warning(F.col("t"), F.lit("stale-impl")).alias("t"))
    w = reports.WARNINGS
    assert [r.t for r in one.collect()] == [r.t for r in two.collect()] == [f"@source: a\n@hash: b\n\n{w['stale']}\nBody\n\nmore", f"{w['stale']}\nno header"]
    assert both.head().t == f"@source: a\n@hash: b\n\n{w['stale']}\n{w['stale-impl']}\nBody\n\nmore"
    assert both.select(reports.body(F.col("t"))).head()[0] == "Body\n\nmore"
    assert df.select(reports.with_warning(F.col("t"), F.lit("other"))).head()[0] == text


def test_counters(spark):
    found = spark.createDataFrame([("a", "S", "x"), ("a", "S", "b"), ("a", None, "y")], "path string, schema_name string, name string")
    assert rows(reports.enforcement(found)) == [("a", 1, ["y"]), ("a:S", 2, ["b", "x"])]
    assert rows(reports.enforcement_share(found, 6)) == [(6, 3, 50.0)] and rows(reports.enforcement_share(found, None)) == [(None, None, None)] and rows(reports.enforcement_share(found.limit(0), 0)) == [(0, 0, 0.0)]
    phases = spark.createDataFrame([("b", True), ("a", True), ("c", False)], "phase string, failed boolean")
    assert rows(reports.degraded(phases)) == [("a,b",)] and rows(reports.degraded(phases.where("not failed"))) == [(None,)]
    parts = spark.createDataFrame([("p", 1, ["z"]), ("p", 2, ["a", "b"])], "path string, checked int, findings array<string>")
    assert rows(reports.merged_checks(parts)) == [("p", 3, ["a", "b", "z"])]
    assert rows(reports.vocabulary(spark.createDataFrame([("C.run",), ("f",)], "name string"))) == [("C.run",), ("f",), ("run",)]
    claims = spark.createDataFrame([(True, False, True), (True, True, False)], "old boolean, new boolean, escalated boolean")
    assert rows(reports.triage_delta(claims)) == [(2, 2, 1, 1, 0)]
    top, more = reports.capped(spark.range(5).toDF("n"), [F.desc("n")], 3)
    assert [r.n for r in top.collect()] == [4, 3, 2] and more and not reports.capped(spark.range(3).toDF("n"), [F.desc("n")], 3)[1]


def test_trees_zips_and_checks(spark):
    nodes = spark.createDataFrame([("", None, True), ("b", "", True), ("a.py", "", False), ("b/x", "b", False)], "path string, parent string, is_dir boolean")
    assert rows(reports.tree_rows(nodes)) == [("", ["b", "a.py"]), ("b", ["x"])]
    asked, told = spark.createDataFrame([(0, "p"), (1, "q")], "ord int, path string"), spark.createDataFrame([(1, "dismissed")], "ord int, verdict string")
    assert rows(reports.positional(told, asked), "path", "verdict") == sorted([("p", None), ("q", "dismissed")], key=repr)
    mined = spark.createDataFrame([("s", "needle")], "slug string, kind string")
    entries = spark.createDataFrame([("s", ["one"], ["needle"]), ("s", ["two", "three"], ["import"]), ("t", ["four"], ["needle"])], "slug string, phrases array<string>, kinds array<string>")
    assert rows(reports.cross_check(mined, entries)) == [("s", "three"), ("s", "two"), ("t", "four")]


def test_ledger_leaves_and_files(spark, tmp_path):
    ledger = spark.createDataFrame([("abc", 1), ("abd", 2)], "id string, n int")
    assert reports.ledger_entry(ledger, "abd").head().n == 2
    with pytest.raises(ValueError, match="abc, abd"):
        reports.ledger_entry(ledger, "abx")
    document = json.dumps({"a": 'q"uo\\te', "b": [{"c": "x:y"}, "é", 3, None], "k": ":"})
    assert rows(reports.string_leaves(spark.createDataFrame([(1, document)], "k int, d string"), "k", "d")) == sorted([(1, 'q"uo\\te'), (1, "x:y"), (1, "é"), (1, ":")], key=repr)
    (tmp_path / "i.json").write_text(json.dumps({"issues": [{"id": "a"}, {"id": "b"}]}, indent=1))
    assert rows(reports.issues(spark, str(tmp_path / "i.json"), "id: string")) == [("a",), ("b",)]
    reports.write_by_analyzer(spark.createDataFrame([("x", 1), ("y", 2)], "analyzer string, n int"), f"{tmp_path}/out")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"analyzer=x", "analyzer=y"}


def test_registries(spark):
    known = registry.Registry()

    @known.register("a", "b")
    def good(n):
        return spark.range(n).toDF("n")

    @known.register("b")
    def bad(n):
        raise RuntimeError("no")

    assert known.names() == ["a", "b"] == known.enabled() and known.enabled(without=["a"]) == ["b"] and "a" in known
    with pytest.raises(ValueError, match="zz"):
        known.enabled(["zz"])
    found, failed = registry.run(spark, known, ["a", "b"], "n long", 2)
    assert failed == ["b"] and found["a"].count() == 2 and found["b"].collect() == []
    assert registry.by_precedence([("flag", None), ("file", 3), ("default", 1)]) == (3, "file")
    with pytest.raises(ValueError, match="flag"):
        registry.by_precedence([("flag", None)])


def test_intent_and_types_of_findings(spark):
    text = "# why\nclass Box:\n    # holds\n    def put(self):\n        pass\n\nx = 1"
    files = spark.createDataFrame([("a.py", text)], "path string, text string")
    symbols = spark.createDataFrame([("a.py", "Box", "class", 2, 5), ("a.py", "Box.put", "method", 4, 5)], "path string, name string, kind string, line_start int, line_end int")
    found = spark.createDataFrame([("i", "a.py", 5, "uses `Box` here"), ("j", "a.py", 7, "`Nothing`"), ("k", "a.py", None, "`Box`")], "id string, path string, line_start int, message string")
    intent = {r.id: json.loads(r.payload) for r in evidence.declared_intent(found, files, symbols).collect()}
    assert intent == {"i": {"before": "# why\nclass Box:\n    # holds\n    def put(self):", "enclosing": "    def put(self):\n        pass"}, "j": {"before": "# why\nclass Box:\n    # holds\n    def put(self):\n        pass\n"}}
    types = {r.id: json.loads(r.payload)["types"] for r in evidence.type_signatures(found, symbols, files).collect()}
    assert types == {x: [{"name": "Box", "path": "a.py", "snippet": "class Box:\n    # holds\n    def put(self):\n        pass"}] for x in ("i", "k")}
