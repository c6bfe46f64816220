"""Nearest matches against plain loops."""

import random

from quarrylens.operators import nearest
from quarrylens.plans import evidence

from .conftest import rows


def test_as_of_like_a_loop(spark):
    rng = random.Random(1)
    left = [(k, rng.choice(["p", "q", None]), rng.choice([None, *range(60)])) for k in range(200)]
    right = [(rng.choice(["p", "q", None]), rng.choice([None, *range(0, 60, 7)]), rng.choice("xyz")) for _ in range(30)]
    for tolerance in (0, 5, 100):
        expected = []
        for k, key, at in left:
            near = [(a, v) for own, a, v in right if None not in (key, at, a) and own == key and 0 <= at - a <= tolerance]
            expected.append((k, key, at, max(near)[1] if near else None))
        got = nearest.as_of(spark.createDataFrame(left, "id int, key string, at int"), spark.createDataFrame(right, "key string, at int, v string"), ["key"], "at", tolerance, ["v"])
        assert rows(got) == sorted(expected, key=repr)


def test_variables_have_the_last_type_above(spark):
    text = "\n".join(["def f(opts: 'Old', n: int):", "  opts.a", "x: T", *[""] * 39, "opts.b", "opts :New = 1, opts: Newer", "opts.c"])
    found = [("1", "p", 2, "`opts.a` is unused"), ("2", "p", 43, "`opts.b` and `x.y`"), ("3", "p", 45, "`opts.c`, `opts.d`"), ("4", "p", None, "`opts.a`"), ("5", "none", 2, "`opts.a`"), ("6", "p", 1, "`opts`")]
    df = spark.createDataFrame(found, "id string, path string, line_start int, message string")
    got = evidence.inferred_types(df, spark.createDataFrame([("p", text)], "path string, text string"))
    assert rows(got) == [("1", "opts", "Old"), ("3", "opts", "New")]


def test_deepest_folder(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b/c/x.ts", "a/b/x.ts", "a/bc/x.ts", "x.ts", "z/x.ts")], "path string")
    homes = spark.createDataFrame([("a/b",), ("a",), ("a/b/c/x.ts",)], "home string")
    assert rows(nearest.nearest_ancestor(paths, "path", homes, "home")) == [("a/b/c/x.ts", "a/b"), ("a/b/x.ts", "a/b"), ("a/bc/x.ts", "a")]
    top = homes.union(spark.createDataFrame([("",)], "home string"))
    assert ("x.ts", "") in rows(nearest.nearest_ancestor(paths, "path", top, "home"))


def test_longest_alias(spark):
    aliases = [("a", "@app/*", "src/app/*"), ("a", "@app/core/*", "src/core/*"), ("a", "@app/core/x", "src/x.ts"), ("a", "*.css", "styles/*"), ("a", "@lib*", "lib"), ("b", "*", "any/*")]
    names = [("a", "@app/core/y"), ("a", "@app/core/x"), ("a", "@app/z"), ("a", "m.css"), ("a", ".css"), ("a", "css"), ("a", "@library"), ("b", "@app/z"), ("b", ""), (None, "x"), ("a", None)]
    got = nearest.expanded(spark.createDataFrame(names, "scope string, name string"), spark.createDataFrame(aliases, "scope string, pattern string, target string"), "scope", "name")
    assert rows(got) == sorted([("a", "@app/core/y", "src/core/y"), ("a", "@app/core/x", "src/x.ts"), ("a", "@app/z", "src/app/z"), ("a", "m.css", "styles/m"), ("a", ".css", "styles/"), ("a", "@library", "lib"), ("b", "@app/z", "any/@app/z"), ("b", "", "any/")], key=repr)
