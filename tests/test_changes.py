"""The impact of a change: shadows, references, marks."""

from pyspark.sql import functions as F

from quarrylens.plans import changes, reports

from .conftest import rows


def setting(spark):
    raw = spark.createDataFrame([("src/a.py", "M", 1), ("src/b.py", "D", 2), ("src/c.py", "A", 3), ("src/d.py", "R100", 4), ("src/e.py", "X", 5), ("d.md", "T", 6), ("src/gone.py", "M", 7)], "path string, status string, ord int")
    changed = changes.classified(raw, F.endswith("path", F.lit(".py")), F.endswith("path", F.lit(".md")))
    files = spark.createDataFrame([("src/a.py", "new"), ("src/c.py", "c"), ("src/d.py", "d"), ("src/e.py", "e")], "path string, source_hash string")
    shadows = spark.createDataFrame([("src/a.py", "old", "v2"), ("src/b.py", "b", "v2"), ("src/d.py", "d", "v1"), ("src/e.py", "e", "v2")], "path string, source_hash string, impl_hash string")
    docs = spark.createDataFrame([("d.md", "top\n  see src/b.py, and a.py\nb.py again"), ("e.md", "of nothing"), ("n.md", None)], "path string, text string")
    return changed, files, shadows, docs


def test_kinds_and_stale_shadows(spark):
    changed, files, shadows, _ = setting(spark)
    assert dict(rows(changed, "path", "change_type"))["src/e.py"] == "modified"
    assert dict(rows(changed, "path", "change_type"))["src/d.py"] == "renamed"
    found = rows(changes.stale_shadows(changed.where("is_source"), files, shadows, "v2"))
    assert found == [("src/a.py", True, "stale"), ("src/b.py", True, "deleted_source"), ("src/c.py", False, "missing"), ("src/d.py", True, "stale")]


def test_references_by_text_take_the_first_source_of_a_line(spark):
    changed, files, shadows, docs = setting(spark)
    facts = spark.createDataFrame([("x.py", None, [("src/b.py",)])], "path string, classification string, imports array<struct<source:string>>")
    found = changes.impact(changed, files, shadows, docs, facts, "v2")
    assert rows(found.references) == [("d.md", "src/a.py", 2, "see src/b.py, and a.py", False), ("d.md", "src/b.py", 3, "b.py again", True)]
    assert rows(found.issues()) == [(4, 2, 1, True)] and rows(found.docs, "path") == [("d.md",)]


def test_references_by_facts_where_documents_have_some(spark):
    changed, files, shadows, docs = setting(spark)
    facts = spark.createDataFrame([("d.md", "doc", [("src/b.py",), ("src/b.py",)]), ("e.md", "doc", [("src/a.py",)]), ("gone.md", "doc", [("src/a.py",)]), ("n.md", "doc", [("src/c.py",)])], "path string, classification string, imports array<struct<source:string>>")
    found = changes.impact(changed, files, shadows, docs, facts, "v2")
    assert rows(found.references, "doc", "path", "line_no") == [("d.md", "src/b.py", 2), ("e.md", "src/a.py", 0), ("n.md", "src/c.py", 0)]


def test_nothing_changed(spark):
    changed, files, shadows, docs = setting(spark)
    found = changes.impact(changed.limit(0), files, shadows, docs, spark.createDataFrame([], "path string, classification string, imports array<struct<source:string>>"), "v2")
    assert rows(found.issues()) == [(0, 0, 0, False)]


def test_marks_are_put_once(spark):
    shadows = spark.createDataFrame([("a", "@source: a\n\nbody"), ("b", "@source: b\n\nbody"), ("c", None), ("d", "@source: d\n\nbody")], "path string, text string")
    stale = spark.createDataFrame([("a", "stale"), ("b", "stale-impl"), ("c", "stale"), ("e", "missing"), ("d", "missing")], "path string, reason string")
    first = changes.marked(shadows, stale)
    assert rows(first, "path", "added") == [("a", 1), ("b", 1), ("c", 1)]
    assert first.where("path = 'a'").head().text == f"@source: a\n\n{reports.WARNINGS['stale']}\nbody"
    again = changes.marked(first.select("path", "text"), stale)
    assert rows(again, "path", "added") == [("a", 0), ("b", 0), ("c", 0)]
