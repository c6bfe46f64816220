"""Loaders and writers of sidecars on awkward documents."""

import json

from pyspark.sql import functions as F

from quarrylens.plans import changes
from quarrylens.plans import facts as fx
from quarrylens.sources import sidecars

from .conftest import rows


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "path string, text string")


def test_bad_entries_go_alone_and_good_ones_stay(spark):
    doc = {"source": "src\\a.py", "exports": ["oops", {"name": "f", "line": 3, "decorators": ["x"]}, None, 7, {"name": "g", "line": "far"}], "imports": {"not": "a list"}, "string_literals": None}
    found = sidecars.facts(frame(spark, [("a.facts.json", json.dumps(doc))])).collect()
    assert len(found) == 1
    row = found[0]
    assert (row.path, row.source_hash, row.classification) == ("src/a.py", "", None)
    assert [(e["name"], e.line, e.decorators) for e in row.exports] == [("f", 3, ["x"]), ("g", None, None)]
    assert row.imports == [] and row.calls == [] and row.member_writes == [] and row.string_literals == []


def test_unreadable_documents_and_those_without_a_key_are_skipped(spark):
    texts = [("1", "{"), ("2", ""), ("3", None), ("4", "[]"), ("5", "{}"), ("6", '{"source": ""}'), ("7", '{"source": null}'), ("8", '"source"'), ("9", '{"source": "ok"}')]
    assert [r.path for r in sidecars.facts(frame(spark, texts)).collect()] == ["ok"]
    empty = frame(spark, [])
    for load in (sidecars.facts, sidecars.signatures, sidecars.findings, sidecars.analyses, sidecars.folder_summaries):
        assert load(empty).count() == 0


def test_of_a_sources_several_documents_the_last_counts(spark):
    one = lambda name, source: json.dumps({"source": source, "exports": [{"name": name}]})
    found = sidecars.facts(frame(spark, [("a", one("first", "x/y.py")), ("c", one("last", "x\\y.py")), ("b", one("middle", "x/y.py")), ("c", one("last", "x\\y.py"))]))
    assert [(r.path, r.exports[0].name) for r in found.collect()] == [("x/y.py", "last")]


def test_maps_and_nested_arrays_come_back_as_the_plans_read_them(spark):
    doc = {"source": "a.py", "imports": [{"source": "b", "names": ["al"], "name_map": {"al": "f"}, "is_reexport": False, "line": 1}], "exports": [{"name": "c", "parameters": [{"name": "p", "optional": True}]}]}
    known = sidecars.facts(frame(spark, [("a", json.dumps(doc)), ("b", '{"source": "b.py", "exports": [{"name": "f"}, {"name": "g"}]}')]))
    assert rows(fx.unused_exports(known, fx.resolved_imports(known, known))) == [("a.py", "c"), ("b.py", "g")]
    assert known.where("path = 'a.py'").head().exports[0].parameters[0].optional is True


def test_symbols_and_roles_leave_documentation_out(spark):
    doc = lambda source, **more: json.dumps({"source": source, **more})
    some = frame(spark, [("1", doc("a.py", symbols=[{"name": "f", "kind": "function", "line_start": 1}], file_role="schema")), ("2", doc("a.md", symbols=[{"name": "h"}], file_role="schema")), ("3", doc("b.py", symbols=[], file_role="")), ("4", doc("c.py", symbols=["x"], file_role="util"))])
    is_doc = F.endswith("path", F.lit(".md"))
    assert [(r.path, r.symbols[0].line_start, r.symbols[0].line_end) for r in sidecars.symbols(some, is_doc).collect()] == [("a.py", 1, None)]
    assert rows(sidecars.roles(some, is_doc)) == [("a.py", "schema"), ("c.py", "util")]
    assert rows(sidecars.with_role(some, "schema", is_doc)) == [("a.py",)]
    assert rows(sidecars.with_role(some, "schema", F.lit(False))) == [("a.md",), ("a.py",)]


def test_a_tree_of_one_document_a_file(spark, tmp_path):
    for name, text in {"src/a.py.shadow.md": "a", "src/_directory.shadow.md": "s" * 600, "src/in/b.py.shadow.md": "b", "_directory.shadow.md": "root", "src/notes.txt": "no", "in.shadow.md": "top"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    summaries = sidecars.folder_summaries(sidecars.tree(spark, str(tmp_path)))
    assert rows(summaries.select("folder", F.length("summary").alias("n"), F.array_join("children", ",").alias("c"))) == [("", 4, "in"), ("src", 500, "src/a.py")]
    matches = spark.createDataFrame([("d.md", "src/"), ("d.md", "/src"), ("e.md", "(root)"), ("f.md", ""), ("g.md", "gone")], "doc string, folder string")
    assert rows(sidecars.topic_matches(matches, summaries)) == [("d.md", "src/a.py"), ("e.md", "in"), ("f.md", "in")]


def test_signatures_of_folders_are_another_thing(spark):
    some = frame(spark, [("src/_directory.signature.json", '{"path": "src", "purpose": "all"}'), ("src/a.py.signature.json", '{"path": "src/a.py", "purpose": "one", "topics": ["t"]}')])
    assert rows(sidecars.signatures(some).select("path", "purpose")) == [("src/a.py", "one")]


def test_analyses_count_what_is_no_object(spark):
    some = frame(spark, [("docs/a.md.analysis.json", '{"findings": ["odd", {"severity": "error"}, {"description": "d"}], "confidence": 0.5}'), ("docs/b.md.analysis.json", "{}"), ("docs/c.md.analysis.json", "no"), ("docs/other.json", "{}")])
    found = {r.path: r for r in sidecars.analyses(some).collect()}
    assert set(found) == {"docs/a.md", "docs/b.md"}
    assert found["docs/a.md"].accuracy_error_count == 3
    assert [(e.description, e.severity) for e in found["docs/a.md"].findings] == [("", "error"), ("d", "warning")]
    assert (found["docs/b.md"].accuracy_error_count, found["docs/b.md"].topics, found["docs/b.md"].findings) == (0, [], [])


def test_what_is_written_comes_back_and_other_kinds_stay(spark, tmp_path):
    schema = "path string, source_hash string, body string, findings array<struct<category:string,line_start:int,severity:string>>, symbols array<struct<name:string,kind:string,line_start:int,line_end:int>>, file_role string, purpose string, topics array<string>, facts struct<exports:array<struct<name:string>>,extraction_method:string>"
    given = spark.createDataFrame([("a.py", "h1", 'says "hi"\né', [("debris", 1, "error")], [("f", "function", 1, 2)], "util", "p", ["t"], ([("f",)], "ast")), ("b.py", "h2", None, [], [], None, None, None, None)], schema)
    made, root = sidecars.documents(given, "v1"), str(tmp_path / "out")
    assert rows(made.groupBy("kind").count()) == [("facts", 1), ("findings", 2), ("shadow", 2), ("signatures", 1), ("symbols", 1)]
    sidecars.write(made, root)
    assert rows(sidecars.facts(sidecars.packed(spark, root, "facts")).select("path", "source_hash", "extraction_method")) == [("a.py", "h1", "ast")]
    assert rows(sidecars.packed(spark, root, "shadow").where("path = 'a.py.shadow.md'"), "text") == [('@source: a.py\n@source-hash: h1\n@impl-hash: v1\n\nsays "hi"\né',)]
    assert rows(sidecars.findings(sidecars.packed(spark, root, "findings")).select("path", "impl_hash", F.size("findings"), "at")) == [("a.py", "v1", 1, "a.py.findings.json"), ("b.py", "v1", 0, "b.py.findings.json")]
    sidecars.write(made.where("kind = 'symbols'").limit(0).union(made.where("kind = 'facts'")), root)
    assert sidecars.packed(spark, root, "symbols").count() == 1 and sidecars.packed(spark, root, "facts").count() == 1


def test_references_of_documents_by_the_first_form_that_fits(spark):
    docs = frame(spark, [("d.md", "see src/pkg/mod.py and pkg.other here"), ("e.md", "nothing"), ("f.md", None), ("g.md", "mod.py")])
    sources = spark.createDataFrame([("src/pkg/mod.py",), ("src/pkg/other.py",), ("a.c",)], "path string")
    known = sidecars.facts(changes.reference_facts(docs, sources).select("path", "text"))
    assert rows(known.select("path", "classification", F.array_join("imports.source", ","))) == [("d.md", "doc", "src/pkg/mod.py,src/pkg/other.py"), ("e.md", "doc", ""), ("f.md", "doc", ""), ("g.md", "doc", "src/pkg/mod.py")]
    said = json.loads(changes.reference_facts(docs, sources).where("path = 'd.md.facts.json'").head().text)["imports"]
    assert [x["context"] for x in said] == ["doc references src/pkg/mod.py via 'src/pkg/mod.py'", "doc references src/pkg/other.py via 'pkg.other'"]


def test_the_schema_of_whole_documents_is_not_made(spark):
    texts = spark.createDataFrame([("a.facts.json", '{"source": "a", "imports": [{"source": "b"}, 1]}')], "path string, text string")
    found = sidecars.facts(texts)
    assert "schema_of_variant" not in found._jdf.queryExecution().toString()
    assert [x["source"] for x in found.head()["imports"]] == ["b"]


def test_written_sidecars_are_small_and_whole(spark, tmp_path):
    rows = spark.createDataFrame([("facts", f"a{k}.facts.json", f'{{"source": "a{k}"}}' + " " * 2000) for k in range(50)], "kind string, path string, text string")
    sidecars.write(rows.repartition(2), str(tmp_path / "s"))
    files = list((tmp_path / "s").rglob("part-*"))
    assert files and sum(p.stat().st_size for p in files) < 20_000
    back = sidecars.packed(spark, str(tmp_path / "s"), "facts")
    assert sorted(map(tuple, back.collect())) == sorted((r.path, r.text) for r in rows.collect())
