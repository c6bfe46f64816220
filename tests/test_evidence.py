"""Evidence about a finding's place: code around it, declared intent, documentation by scope."""

import json

from quarrylens.plans import evidence

from .conftest import rows

SYMBOLS = "path string, name string, line_start int, line_end int"
FOUND = "id string, path string, symbol string, line_start int, line_end int"


def payloads(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.id, []).append(json.loads(r.payload))
    return out


def test_code_around_the_symbol_its_name_or_the_lines(spark):
    files = spark.createDataFrame([("p", "\n".join(["x"] * 29 + ["call(g.h)", "x", "g.h"] + ["y" * 900] * 3)), ("empty", ""), ("none", None)], "path string, text string")
    symbols = spark.createDataFrame([("p", "C", 1, 35), ("p", "f", 5, 6), ("p", "open", 3, None), ("p", "tie", 1, 35)], SYMBOLS)
    found = spark.createDataFrame([("own", "p", "f", 30, 31), ("near", "p", "g.h", 33, 33), ("lines", "p", "gone", 20, 22), ("plain", "p", None, 2, None), ("nowhere", "p", None, None, None), ("open", "p", "open", 9, 9), ("e", "empty", "f", 1, 1), ("n", "none", "f", 1, 1), ("o", "other", "f", 1, 1)], FOUND)
    got = {k: v[0] for k, v in payloads(evidence.surrounding(found, files, symbols)).items()}
    assert set(got) == {"own", "near", "lines", "plain", "nowhere", "open"}
    place = {k: (v["line_start"], v["line_end"], v["anchor"], v.get("enclosing")) for k, v in got.items()}
    assert place == {"own": (1, 16, "symbol", None), "near": (22, 35, "symbol", "C"), "lines": (10, 32, "lines", "C"), "plain": (1, 12, "lines", "C"), "nowhere": (1, 11, "lines", "C"), "open": (1, 13, "symbol", "C")}
    assert got["near"]["code"].splitlines()[-1] == "35\t" + "y" * 400 and got["own"]["code"].startswith("1\tx\n2\tx")


def test_intent_ends_with_the_symbol_and_needs_something_to_show(spark):
    files = spark.createDataFrame([("p", "\n".join(f"l{k}" for k in range(1, 61)))], "path string, text string")
    symbols = spark.createDataFrame([("p", "C", 20, 50), ("p", "f", 21, 22)], SYMBOLS)
    found = spark.createDataFrame([("a", "p", None, 22, None), ("b", "p", None, 40, None), ("c", "p", None, 1, None), ("d", "p", None, None, None), ("e", "p", None, 60, None)], FOUND)
    got = {k: v[0] for k, v in payloads(evidence.declared_intent(found, files, symbols)).items()}
    assert set(got) == {"a", "b", "e"}
    assert got["a"] == {"before": "\n".join(f"l{k}" for k in range(12, 22)), "enclosing": "l21\nl22"}
    assert got["b"]["enclosing"] == "\n".join(f"l{k}" for k in range(20, 35))
    assert got["e"] == {"before": "\n".join(f"l{k}" for k in range(50, 60))}


def test_documentation_by_the_least_scope(spark):
    shadows = spark.createDataFrame([("a/x.py", "of x"), ("a/y.py", "of y"), ("b/z.py", "z" * 3000), ("b/null.py", None)], "path string, text string")
    folders = spark.createDataFrame([("a", "of a"), ("", "of all"), ("docs", "of docs")], "folder string, text string")
    found = spark.createDataFrame(
        [
            ("code", "a\\x.py", "dead_code", None, None), ("both", "a/x.py", "description", None, None), ("file", "docs/d.md", "description", "a/x.py", ["a/x.py", "x"]),
            ("folder", "docs/d.md", "description", "a\\x.py", ["a/y.py", "a/gone.py"]), ("root", "docs/d.md", "description", None, ["a/y.py", "b/z.py"]), ("none", "docs/d.md", "description", None, None),
            ("other", "docs/d.md", "stale_doc", "a/x.py", None), ("gone", "docs/d.md", "description", "a/gone.py", None), ("long", "b/z.py", "dead_code", None, None), ("null", "b/null.py", "dead_code", None, None),
        ],
        "id string, path string, gap_type string, shadow_ref string, search_terms array<string>",
    )
    got = {k: [(e["file"], e["scope"], e["excerpt"][:8]) for e in v] for k, v in payloads(evidence.shadow_claims(found, shadows, folders)).items()}
    assert got == {
        "code": [("a/x.py", "file", "of x")],
        "both": [("a/x.py", "directory", "of a"), ("a/x.py", "file", "of x")],
        "file": [("a/x.py", "file", "of x")],
        "folder": [("a", "directory", "of a")],
        "root": [("", "root", "of all")],
        "none": [("", "root", "of all")],
        "gone": [("docs/d.md", "directory", "of docs")],
        "long": [("b/z.py", "file", "zzzzzzzz")],
    }
    assert len(payloads(evidence.shadow_claims(found, shadows))["long"][0]["excerpt"]) == 2000
    assert rows(evidence.shadow_claims(found.limit(0), shadows, folders)) == []


def test_lines_and_symbols_of_files_are_not_broadcast(spark):
    files = spark.createDataFrame([("p", "a\nb\nc")], "path string, text string")
    symbols = spark.createDataFrame([("p", "f", 1, 3)], SYMBOLS)
    found = spark.createDataFrame([("a", "p", "f", 2, 2)], FOUND)
    for made in (evidence.declared_intent(found, files, symbols), evidence.surrounding(found, files, symbols)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert made.count() == 1
