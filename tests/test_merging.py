"""Merging and evaluation on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import evaluation, merging

from .conftest import rows

LITERAL = "path string, value string, line int, ord int, usage string, kind string"


def test_literals_prefer_the_same_line(spark):
    parsed = spark.createDataFrame([("p", "a", 1, 0), ("p", "a", 9, 1), ("p", "b", 2, 2)], "path string, value string, line int, ord int")
    judged = spark.createDataFrame([("p", "a", 3, 0, "x", "k"), ("p", "a", 1, 1, "y", "k"), ("p", "a", 1, 2, "z", "k"), ("p", "new", 5, 3, "n", "k")], LITERAL)
    assert rows(merging.merged_literals(parsed, judged), "value", "line", "usage") == sorted([("a", 1, "z"), ("a", 9, "x"), ("b", 2, None), ("new", 5, "n")], key=repr)


def test_edges_and_names(spark):
    files = spark.createDataFrame([("a", "def f"), ("b", "f(x)"), ("c", "ff")], "path string, text string")
    symbols = spark.createDataFrame([("a", "f")], "path string, name string")
    assert rows(merging.cooccurrence_edges(files, symbols)) == [("a", "b"), ("b", "a")]
    refs = spark.createDataFrame([("A.m", "x", 1), ("m", "x", 1), ("m", "y", 2)], "name string, file string, line int")
    assert rows(merging.with_bare_names(refs, spark.createDataFrame([("A.m",)], "name string"))) == [("A.m", "x", 1), ("A.m", "y", 2)]


def test_grouped_contracts(spark):
    df = spark.createDataFrame([("p", "c", "v1", 0.7), ("p", "c", "v2", 0.7), ("q", "c", "v", 0.3)], "producer string, consumer string, value string, confidence double")
    assert rows(merging.grouped_contracts(df)) == [("p", "c", ["v1", "v2"], 2, 0.7), ("q", "c", ["v"], 1, 0.3)]


def test_small_functions(spark):
    df = spark.createDataFrame([("a/b/c", "a/b/d", "x = 'it\\'s' + y", 7, 14)], "p string, q string, line string, i int, o int")
    got = df.select(merging.common_folder(F.col("p"), F.col("q")), merging.inside_quotes(F.col("line"), F.col("i")), merging.inside_quotes(F.col("line"), F.col("o"))).head()
    assert tuple(got) == ("a/b", True, False)
    paths = spark.createDataFrame([("node_modules/.env.local",), ("dist/a.js",), ("a.png",), ("a.py",)], "p string")
    assert [r[0] for r in paths.select(merging.checkable(F.col("p"))).collect()] == [True, False, False, True]
    zero = spark.createDataFrame([(0, 5, False), (0, 0, False), (0, 5, True), (1, 5, False)], "r int, s int, t boolean")
    assert [r[0] for r in zero.select(merging.clean_zero(F.col("r"), F.col("s"), F.col("t"))).collect()] == [True, False, False, False]


def test_running_limit_cuts_all_after_the_first_overflow(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 1)], "k string, o int, n int")
    assert rows(merging.ranked_within(df, ["k"], [F.col("o")], "n", 10)) == [("k", 1, 5)]


def test_types(spark):
    files = spark.createDataFrame([("p", "a\nclass T:\n  x\nb")], "path string, text string")
    symbols = spark.createDataFrame([("T", "class", "p", 2, 3), ("f", "function", "p", 1, 1)], "name string, kind string, path string, line_start int, line_end int")
    assert rows(merging.types_of(spark.createDataFrame([("T",), ("f",)], "name string"), symbols, files)) == [("T", "p", "class T:\n  x")]


def test_runs_and_comparisons(spark):
    cases = spark.createDataFrame([("c1", "confirmed", False), ("c2", "dismissed", True)], "slug string, expected string, gray boolean")
    verdicts = spark.createDataFrame([("c1", "v", 0, "confirmed", 1.0), ("c2", "v", 1, "confirmed", 0.5)], "slug string, variant string, repeat int, verdict string, confidence double")
    assert rows(evaluation.runs(cases, ["v"], 2, verdicts), "slug", "repeat", "correct") == sorted([("c1", 0, True), ("c1", 1, None), ("c2", 0, None), ("c2", 1, False)], key=repr)
    splits = spark.createDataFrame([("c1", "train"), ("gone", "val")], "slug string, split string")
    assert rows(evaluation.split_coverage(cases, splits)) == [("c2", "no split"), ("gone", "no case")]
    assert rows(evaluation.gate(cases, splits, 1)) == [(2, 2, False)]
    old = spark.createDataFrame([("1", "dismissed", "error"), ("2", None, None)], "id string, verdict string, severity string")
    new = spark.createDataFrame([("1", "confirmed", "info"), ("2", None, None), ("3", "confirmed", "error")], "id string, verdict string, severity string")
    assert rows(evaluation.compared(old, new), "id", "kind") == [("1", "confirmed_as_info"), ("2", "same"), ("3", "changed")]
    assert rows(evaluation.select_cases([cases], with_gray=False), "slug") == [("c1",)]


def test_corpus_takes_accepted_cases_of_its_schema(spark, tmp_path):
    def put(name, schema, accepted):
        folder = tmp_path / "cat" / f"case_{name}"
        folder.mkdir(parents=True)
        (folder / "case.json").write_text(json.dumps({"schema": schema, "slug": name, "category": "cat"}))
        (folder / "expected.json").write_text(json.dumps({"schema": "corpus-expected/1", "slug": name, "verdict": "confirmed", "accepted": accepted}))

    put("a", "corpus-case/1", True)
    put("b", "corpus-case/1", False)
    assert rows(evaluation.corpus(spark, str(tmp_path)), "slug", "expected", "gray") == [("a", "confirmed", False)]
    put("c", "other/9", True)
    with pytest.raises(ValueError):
        evaluation.corpus(spark, str(tmp_path))


def test_fill_matrix(spark):
    claims = spark.createDataFrame([("c", False, ["code"]), ("c", True, [])], "category string, insufficient boolean, evidence_kinds array<string>")
    assert rows(evaluation.fill_matrix(claims)) == [("c", 2, 0.5, "code", 1)]
