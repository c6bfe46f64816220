"""JSON leaves, trees, schemas and exact tails against plain Python."""

import json
import random
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from quarrylens.functions import schema, statistics
from quarrylens.operators import documents

from .conftest import rows


def leaves(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}["{k}"]')
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]")
    else:
        yield path, value


def test_leaves_at_any_depth(spark):
    deep = "x"
    for k in range(12):
        deep = {"a": [deep, k]} if k % 2 else [deep, {"b c": None}]
    given = [(1, json.dumps(deep)), (2, '"only"'), (3, "{}"), (4, "no json"), (5, None), (6, json.dumps({"s": "a:b", "é": True, "n": -1.5, "l": [[], [{}], ["./src\\a.py"]]}))]
    got = documents.json_leaves(spark.createDataFrame(given, "k int, d string"), ["k"], "d")
    expected = [(k, p, v) for k, d in given if k not in (4, 5) for p, v in leaves(json.loads(d))]
    assert rows(got, "k", "path", "value") == sorted(((k, p, "true" if v is True else None if v is None else str(v)) for k, p, v in expected), key=repr)
    assert {r[0] for r in rows(got.where("k IN (1, 6)").select("kind").distinct())} == {"string", "integer", "number", "boolean", "null"}
    files = spark.createDataFrame([("src/a.py",), ("x",)], "path string")
    assert rows(documents.named_files(got, ["k"], files)) == [(1, "x"), (6, "src/a.py")]


def test_trees_of_any_depth(spark):
    rng = random.Random(1)
    nodes = [(0, None, "root", "d")] + [(k, rng.choice([k - 1, rng.randrange(k)]), f"n{rng.randrange(5)}", rng.choice("df")) for k in range(1, 40)] + [(100, 101, "loop", "d"), (101, 100, "loop", "d"), (200, 999, "alone", "f")]

    def tree(k):
        own = {"name": nodes_by[k][2], "kind": nodes_by[k][3]}
        below = sorted((n for n in nodes if n[1] == k), key=lambda n: (n[3], n[2], n[0]))
        return own | ({"children": [tree(n[0]) for n in below]} if below else {})

    nodes_by = {n[0]: n for n in nodes}
    df = spark.createDataFrame(nodes, "id int, up int, name string, kind string")
    got = documents.assembled(df, "id", "up", ["name", "kind"], ["kind", "name"])
    assert {r.id: json.loads(r.d) for r in got.select("id", F.to_json("document").alias("d")).collect()} == {0: tree(0), 200: tree(200)}
    assert documents.assembled(df.limit(0), "id", "up", ["name"], ["name"]).count() == 0


SCHEMA = {
    "type": "object",
    "required": ["name", "items"],
    "properties": {
        "name": {"type": "string", "enum": ["a", "b"]},
        "n": {"type": "integer", "minimum": 1, "maximum": 5},
        "x": {"type": "number", "minimum": 0.5},
        "flag": {"type": "boolean"},
        "any": {},
        "items": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
    },
}


def test_all_errors_with_their_paths(spark):
    given = {
        '{"name": "a", "items": [], "n": 5, "x": 0.5, "flag": false, "any": [1]}': [],
        '{"name": "c", "n": 9, "x": 0.25, "flag": 1}': ["missing required field 'items'", "name: value c not in enum [a, b]", "n: value 9 > maximum 5", "x: value 0.25 < minimum 0.5", "flag: expected boolean, got integer"],
        '{"name": null, "items": [{"id": 1, "tags": ["t", 2]}, {"tags": "t"}, 3], "n": true, "x": 2}': ["name: expected string, got null", "n: expected integer, got boolean", "items[0].tags[1]: expected string, got integer", "items[1]: missing required field 'id'", "items[1].tags: expected array, got string", "items[2]: expected object, got integer"],
        '{"name": "b", "items": [{"id": 1.5}], "n": 0}': ["n: value 0 < minimum 1", "items[0].id: expected integer, got number"],
        "[]": ["expected object, got array"],
        "{": ["no JSON document"],
    }
    df = spark.createDataFrame([(k, d) for k, d in enumerate([*given, None])], "k int, d string")
    got = [r[0] for r in df.orderBy("k").select(schema.schema_errors(F.col("d"), SCHEMA)).collect()]
    assert [sorted(x) for x in got] == [sorted(x) for x in [*given.values(), ["no JSON document"]]]


def tail(k, n, p):
    p = Fraction(p)
    return float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)))


def test_exact_tails(spark):
    given = [(k, n, p) for n in (0, 1, 7, 60, 400) for k in {-1, 0, 1, n // 2, n - 1, n, n + 1} for p in (0.0, 0.01, 0.5, 0.97, 1.0)]
    df = spark.createDataFrame([*given, (None, 5, 0.5), (1, -1, 0.5), (1, 5, 1.5)], "k int, n int, p double")
    got = {(r.k, r.n, r.p): r.t for r in df.select("k", "n", "p", statistics.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()}
    for k, n, p in given:
        assert abs(got[k, n, p] - tail(k, n, p)) < 1e-9 * max(1, n), (k, n, p)
    assert got[None, 5, 0.5] is got[1, -1, 0.5] is got[1, 5, 1.5] is None


def test_sample_sizes_and_gates(spark):
    def size(rate):
        for n in range(5, 71):
            least = next((k for k in range(n + 1) if tail(k, n, rate * 0.6) < 0.01), n + 1)
            if tail(least, n, rate) >= 0.99:
                return n
        return 70

    rates = [0.5, 0.8, 0.9, 0.97, 1.0]
    df = spark.createDataFrame([(r,) for r in [*rates, None]], "r double")
    assert {x.r: x.n for x in df.select("r", statistics.sample_size(F.col("r")).alias("n")).collect()} == {r: size(r) for r in rates} | {None: None}
    gate = spark.createDataFrame([(19, 20, 0.9), (12, 20, 0.9)], "k int, n int, r double").select(statistics.pass_rate(F.col("k"), F.col("n"), F.col("r")).alias("g")).collect()
    assert [x.g.holds for x in gate] == [True, False] and abs(gate[1].g.p_value - tail(12, 20, 0.9 * 0.6)) < 1e-9


def test_a_value_is_looked_at_once(spark):
    rules = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "string"}}}}}}
    df = spark.createDataFrame([(1, '{"a": null, "b": [{"c": 1}, {}, []]}')], "k int, d string").select(schema.schema_errors(F.col("d"), rules).alias("e"))
    assert df.head()[0] == ["a: expected integer, got null", "b[0].c: expected string, got integer", "b[2]: expected object, got array"]
    assert df._jdf.queryExecution().analyzed().toString().count("schema_of_variant") < 50
