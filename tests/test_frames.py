"""Callee frames: order, caps, totals, and a chain that only promotion reaches."""

from pyspark.sql import functions as F

from quarrylens.plans import frames

from .conftest import rows

CALL = "array<struct<from_symbol:string,to:string,line:int>>"
FACTS = f"path string, exports array<struct<name:string>>, calls {CALL}"
RESOLVED = "path string, names array<string>, target string, line int"
SYMBOLS = "path string, name string, line_start int, line_end int"
FINDINGS = "id string, path string, line_start int, line_end int, message string"


def framed(spark, facts, imports, symbols, findings):
    tables = (spark.createDataFrame(f, FACTS) for f in (facts,)), spark.createDataFrame(imports, RESOLVED), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(findings, FINDINGS)
    (f,), r, s, found = (list(tables[0]), *tables[1:])
    return {x.id: x for x in frames.callee_frames(found, f, r, s).collect()}


def test_a_chain_that_only_promotion_reaches(spark):
    facts = [("a.py", [("f",)], [("f", "b.g", 2), ("f", "print", 3), ("f", "b.g", 4)]), ("b.py", [("g",), ("h",)], [("C.g", "h", 10), ("h", "JSON.dump", 20)]), ("c.py", [], None)]
    imports = [("a.py", ["b.g"], "b.py", 1)]
    found = framed(spark, facts, imports, [], [("1", "a.py", 2, 2, "it raises before `f`"), ("2", "a.py", 2, 2, "nothing of the kind"), ("3", "none.py", 1, 1, "call"), ("4", "a.py", 50, None, "order"), ("5", "a.py", 2, 2, None)])
    assert set(found) == {"1"}
    one = found["1"]
    assert [tuple(s) for s in one.seeds] == [("g", "b.py", "region"), ("f", "a.py", "claim_text"), ("h", "b.py", "callee")]
    assert [tuple(e) for e in one.edges] == [("g", "b.py", "h", [10]), ("f", "a.py", "b.g", [2, 4]), ("f", "a.py", "print", [3]), ("h", "b.py", "JSON.dump", [20])]
    assert one.edges_total == 5 and one.unresolved == ["print"]


def test_caps_keep_the_first_and_totals_count_all(spark):
    calls = [("f", f"x{k // 7:02}", k) for k in range(7 * 20)]
    others = [(f"m{k}.py", [(f"g{k}",)], [(f"g{k}", f"y{k}_{j:02}", j) for j in range(16)]) for k in range(6)]
    facts = [("a.py", [("f",)], [*calls, *((None, f"g{k}", None) for k in range(6))]), *others]
    imports = [("a.py", [f"g{k}"], f"m{k}.py", k) for k in range(6)]
    (one,) = framed(spark, facts, imports, [], [("1", "a.py", 10_000, None, "`f` then `g0` `g1` `g2` `g3` `g4` `g5`")]).values()
    assert [(s.name, s.file) for s in one.seeds] == [("f", "a.py"), ("g0", "m0.py"), ("g1", "m1.py"), ("g2", "m2.py"), ("g3", "m3.py")]
    assert len(one.edges) == 40 and one.edges_total == 140 + 16 * 2  # the third frame passes the cap, so the others are not opened
    (two,) = framed(spark, facts, [], [], [("1", "a.py", 10_000, None, "`f` calls")]).values()
    assert len(two.edges) == 15 and two.edges_total == 140 and two.edges[0].lines == [0, 1, 2, 3, 4] and two.edges[14].to == "x14"


def test_symbols_without_calls_have_those_in_their_lines(spark):
    facts = [("a.py", [], [("outer", "x", 12), ("outer", "  y\n z  ", 13), ("outer", "late", 90)])]
    symbols = [("a.py", "inner", 10, 20), ("a.py", "whole", 1, 200)]
    (one,) = framed(spark, facts, [], symbols, [("1", "a.py", 15, 16, "returns early")]).values()
    assert [tuple(s) for s in one.seeds] == [("inner", "a.py", "enclosing")]
    assert [(e.to, e.lines) for e in one.edges] == [("x", [12]), ("y z", [13])]
    told = frames.with_line_texts(spark.createDataFrame([one.asDict()], "id string, seeds array<struct<name:string,file:string,origin:string>>, edges array<struct<caller:string,caller_file:string,to:string,lines:array<bigint>>>, edges_total long, unresolved array<string>"), spark.createDataFrame([("a.py", "\n" * 11 + "  x(y)\n")], "path string, text string"))
    assert [(e.to, e.line_text) for e in told.head().edges] == [("x", "x(y)"), ("y z", "")]
    assert rows(told.select(F.size("seeds"))) == [(1,)]


def test_calls_are_joined_with_spans_once(spark, monkeypatch):
    written, keep = {}, frames.stored
    monkeypatch.setattr(frames, "stored", lambda df, name: keep(written.setdefault(name, df), name))
    facts = [("a.py", [("f",)], [("f", "b.g", 2), ("f", "x.print", 3), (None, "b.h", 8)]), ("b.py", [("g",), ("h",)], None)]
    found = framed(spark, facts, [("a.py", ["b.g", "b.h"], "b.py", 1)], [("a.py", "late", 7, 9)], [("1", "a.py", 2, 2, "it raises before `f` and `late`")])
    assert {(e.caller, e.to, *e.lines) for e in found["1"].edges} == {("f", "b.g", 2), ("f", "x.print", 3), ("late", "b.h", 8)}
    plan = written["frames"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bucket") == 0 and "frame-calls" in written
