"""Operators on small tables, and random ones against plain Python."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import audit, graph, intervals, lines, relations

from .conftest import rows


def merged(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("ranges", [[(1, 1)], [(1, 3), (4, 6)], [(1, 3), (5, 6)], [(5, 9), (1, 6)], [(1, 9), (2, 3)], [(1, 2), (1, 2)]])
def test_merge_intervals(spark, ranges):
    df = spark.createDataFrame([("k", a, b) for a, b in ranges], "k string, s int, e int")
    assert rows(intervals.merge_intervals(df, ["k"], "s", "e"), "s", "e") == merged(ranges)


def test_merge_intervals_random(spark):
    rng = random.Random(1)
    data = [(k, a := rng.randint(0, 200), a + rng.randint(0, 9)) for k in range(20) for _ in range(15)]
    df = spark.createDataFrame(data, "k int, s int, e int")
    expected = sorted(((k, a, b) for k in range(20) for a, b in merged([x[1:] for x in data if x[0] == k])), key=repr)
    assert rows(intervals.merge_intervals(df, ["k"], "s", "e")) == expected


def test_overlap_pairs_random(spark):
    rng = random.Random(2)
    data = [(i % 5, i, a := rng.randint(0, 300), a + rng.randint(0, 60)) for i in range(80)]
    df = spark.createDataFrame(data, "k int, r int, s int, e int")
    expected = sorted(((x[0], x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3]), key=repr)
    assert rows(intervals.overlap_pairs(df, "k", "r", "s", "e", 10)) == expected


def test_overlap_is_false_for_nulls(spark):
    df = spark.createDataFrame([(1, 2, None, 3)], "a int, b int, c int, d int")
    assert rows(df.select(intervals.overlap(*map(F.col, "abcd")))) == [(False,)]


def test_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert rows(graph.components(spark.createDataFrame(edges, "src int, dst int")), "node", "component") == sorted(((x, find(x)) for x in parent), key=repr)


def test_reachable_ignores_seeds_outside_and_takes_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("nowhere",)], "node string")
    assert rows(graph.reachable(edges, seeds), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.unreachable(edges, seeds)) == [("x",), ("y",)]


def test_closure_prefers_ids_and_pairs_one_to_one(spark):
    schema = "ord int, finding_id string, composite string, dismissed boolean"
    base = spark.createDataFrame([(1, "x", "p", False), (2, None, "p", False), (3, None, "p", False), (4, "gone", "q", False)], schema)
    now = spark.createDataFrame([(11, "x", "moved", True), (12, None, "p", False), (13, None, "fresh", False)], schema)
    assert rows(audit.closure(base, now, "finding_id", "composite", "ord", "dismissed")) == sorted(
        [("closed_by_dismissal", 1, 11), ("still_open", 2, 12), ("closed", 3, None), ("closed", 4, None), ("new", None, 13)], key=repr
    )


def test_message_core_and_paths(spark):
    df = spark.createDataFrame([("[AST] L12-14: unused", "./a\\b"), ("plain", "././c/d")], "m string, p string")
    assert rows(df.select(T.message_core(F.col("m")), T.normal_path(F.col("p")))) == [("plain", "c/d"), ("unused", "a/b")]


def test_universal_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\n", "a b", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.universal_line_count(F.col("t"))).collect()] == [len(t.splitlines()) for t in texts]


def test_ignore_patterns(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("build/out/y.py",), ("src/z.pyc",), ("src/z.py",)], "p string")
    assert rows(df.where(T.matches_any(F.col("p"), ["node_modules", "build/out", "*.pyc"]))) == [("a/node_modules/x.js",), ("build/out/y.py",), ("src/z.pyc",)]


def test_exact_references_use_up_qualified_names(spark):
    df = spark.createDataFrame([("f", "A.b and b\nab")], "path string, text string")
    assert rows(lines.exact_references(df, "path", ["A.b", "b"])) == [("f", 1, "A.b"), ("f", 1, "b")]
    df = spark.createDataFrame([("f", "A.b")], "path string, text string")
    assert rows(lines.exact_references(df, "path", ["A.b", "b"])) == [("f", 1, "A.b")]


def test_context_frame_at_edges(spark):
    df = spark.createDataFrame([(1, "hit\nb\nc\nd\nhit")], "k int, text string")
    assert rows(lines.context_frames(df, ["k"], lambda x: x == "hit")) == [(1, 1, "hit\nb\nc"), (1, 5, "c\nd\nhit")]


def test_containing_finds_passages_inside_words(spark):
    texts = spark.createDataFrame([(1, "xx one two three four five sixx"), (2, "one two three four five"), (3, "short one here")], "d int, text string")
    passages = spark.createDataFrame([(7, "one two three four five six"), (8, "ort one"), (9, "")], "i int, text string")
    assert rows(relations.containing(texts, "d", passages, "i")) == [(1, 7), (3, 8)]


def test_health_and_rates(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (0, 0, 0.1), (0, 0, 2.0)], "e int, o int, j double")
    assert [round(r[0], 6) for r in df.select(audit.file_health(F.col("e"), F.col("o"), F.col("j"))).collect()] == [1.0, 0.8, 0.7, 0.0]
    assert df.agg(audit.rate(F.col("e") == 1, F.col("o") == 5)).head()[0] == 0.0


def test_resample_counts_null_as_a_verdict(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", None), ("b", None), ("c", "x")], "k string, v string")
    assert rows(audit.resample(df, ["k"], "v")) == [("a", 2, 2, 0.5, True), ("b", 2, 1, 1.0, False)]


def test_replace_partitions(spark):
    old = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "r")], "id int, producer string")
    new = spark.createDataFrame([(1, "p"), (4, "p")], "id int, producer string")
    ran = spark.createDataFrame([("p",)], "producer string")
    assert rows(relations.replace_partitions(old, new, "producer", ran, "id")) == [(1, "p"), (3, "q"), (4, "p")]


def test_null_fingerprints_never_hit(spark):
    df = spark.createDataFrame([(1, "f"), (2, None), (3, "")], "id int, fp string")
    assert rows(relations.cache_probe(df, df, "id", "fp"), "id", "hit") == [(1, True), (2, False), (3, False)]


def test_contradicting_verdicts(spark):
    df = spark.createDataFrame([("confirmed", "Looks bad. So I dismiss it."), ("confirmed", "I would not dismiss it."), ("dismissed", "We confirm this."), ("uncertain", "confirm")], "v string, r string")
    assert [r[0] for r in df.select(T.last_sentence_contradicts(F.col("v"), F.col("r"))).collect()] == [True, False, True, False]


def test_containing_takes_passages_of_any_length(spark):
    import random

    rng = random.Random(4)
    signs = ["a", "b", " ", "  ", "é", "ab"]
    texts = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(99, None)]
    passages = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))) for k in range(120)] + [(200, None)]
    found = relations.containing(spark.createDataFrame(texts, "d int, text string"), "d", spark.createDataFrame(passages, "i int, text string"), "i")
    assert rows(found) == sorted(((d, i) for d, t in texts for i, p in passages if t is not None and p and p in t), key=repr)


def test_links_of_two_steps_are_looked_up_for_given_pairs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 5)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4), (5, 5), (4, 1), (1, 3)], "src int, dst int")
    assert rows(graph.within_two(pairs, edges)) == [(1, 2), (1, 3), (2, 4), (5, 5)]


def test_containing_brings_no_passages_together_by_a_common_beginning(spark):
    """20,000 passages and texts that all begin alike are 400 million pairs by their beginnings."""
    n = 20_000
    texts = spark.range(n).select("id", F.concat(F.lit("see "), F.lit("src/mod"), F.col("id").cast("string"), F.lit(".py\nand more")).alias("text"))
    passages = spark.range(n).select(F.col("id").alias("i"), F.concat(F.lit("src/mod"), F.col("id").cast("string"), F.lit(".py")).alias("text"))
    begun = time.monotonic()
    found = relations.containing(texts, "id", passages, "i")
    assert found.agg(F.count("*"), F.count_if(F.col("id") == F.col("i"))).head()[:] == (n, n)
    assert time.monotonic() - begun < 60


def test_containing_by_pieces_equals_a_search(spark):
    rng = random.Random(7)
    word = lambda most: "".join(rng.choice("ab/ä𝄞\n") for _ in range(rng.randint(1, most)))
    texts = [(i, " ".join(word(30) for _ in range(rng.randint(0, 4)))) for i in range(60)] + [(60, ""), (61, None), (62, "  ")]
    passages = [(i, " ".join(word(rng.choice((1, 3, 6, 14))) for _ in range(rng.randint(1, 2)))) for i in range(120)]
    passages += [(200 + i, t[a : a + n]) for i, (_, t) in enumerate(texts[:60]) if t for a in [rng.randrange(len(t))] for n in [rng.randint(1, 26)]]
    expected = sorted((d, i) for d, t in texts for i, p in passages if t is not None and p and p in t)
    found = relations.containing(spark.createDataFrame(texts, "d int, text string"), "d", spark.createDataFrame(passages, "i int, text string"), "i")
    assert sorted(map(tuple, found.collect())) == expected


def test_fragile_pairs_look_through_ranked_producers(spark, monkeypatch):
    monkeypatch.setattr(audit, "GATHERED", 2)  # a value's producers in several rows
    rng = random.Random(3)
    made = [(f"v{rng.randrange(5)}", rng.choice("abcdefgh")) for _ in range(120)]
    checked = [(f"v{rng.randrange(6)}", rng.choice("abcdefghij")) for _ in range(60)]
    linked = sorted({(rng.choice("abcdefgh"), rng.choice("abcdefghij")) for _ in range(30)})
    counts = collections.Counter(made)

    def expected(robust):
        best = {}
        for value, consumer in set(checked):
            loose = [(n, p) for (v, p), n in counts.items() if v == value and p != consumer and not robust(v, p, consumer)]
            if loose:
                best[value, consumer] = max(loose)
        return sorted(((v, c, p, n) for (v, c), (n, p) in best.items()), key=repr)

    frames = [spark.createDataFrame(x, f"value string, {name} string") for x, name in ((made, "producer"), (checked, "consumer"))]
    pairs = spark.createDataFrame(linked, "producer string, consumer string")
    assert rows(audit.fragile_pairs(*frames, pairs)) == expected(lambda v, p, c: (p, c) in linked)
    own = spark.createDataFrame([("v1", *x) for x in linked], "value string, producer string, consumer string")
    assert rows(audit.fragile_pairs(*frames, own)) == expected(lambda v, p, c: v == "v1" and (p, c) in linked)


def test_reachable_does_not_shuffle_all_edges_for_a_small_front(spark, monkeypatch):
    written, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append((name, df)) or keep(df, name))
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(11)] + [("n11", "n0")], "src string, dst string")
    seeds = spark.createDataFrame([("n3",), ("n3",), ("none",)], "node string")
    assert rows(graph.reachable(edges, seeds)) == sorted(((f"n{(3 + k) % 12}", k) for k in range(12)), key=repr)
    plans = [df._jdf.queryExecution().executedPlan().toString() for name, df in written if name == "front"]
    assert plans[1:] and all("SortMergeJoin" not in plan for plan in plans[1:])


def test_links_of_two_steps_are_found_where_codes_clash_and_lists_are_long(spark, monkeypatch):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [("n0", f"n{k}") for k in range(1, 12)]
    pairs = sorted({(f"n{rng.randrange(42)}", f"n{rng.randrange(42)}") for _ in range(600)})
    to = collections.defaultdict(set)
    for a, b in links:
        to[a].add(b)
    expected = sorted(((a, b) for a, b in pairs if b in to[a] or any(b in to[v] for v in to[a])), key=repr)
    edges, asked = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string")
    plain = rows(graph.within_two(asked, edges))
    monkeypatch.setattr(graph, "LONG", 3)  # many lists stay, the pairs' other ends come to them
    monkeypatch.setattr(graph, "code", lambda node: F.pmod(F.hash(node), F.lit(7)))  # codes settle nothing
    assert plain == rows(graph.within_two(asked, edges)) == expected


def test_pairs_meet_their_neighbours_as_one_row(spark, monkeypatch):
    """200 pairs whose ends have 500 neighbours each were 100,000 rows when neighbours were looked up one by one."""
    written, keep = {}, graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.setdefault(name, keep(df, name)))
    edges = spark.range(200 * 500).select(F.concat(F.lit("a"), F.col("id") % 200).alias("src"), F.concat(F.lit("v"), "id").alias("dst"))
    pairs = spark.range(200).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("b").alias("dst"))
    found = graph.within_two(pairs, edges.union(spark.createDataFrame([("v7", "b")], edges.schema)))
    assert rows(found) == [("a7", "b")]
    assert written["met"].count() == 1 and "over" not in written


def test_texts_do_not_come_back_for_passages_of_one_word(spark):
    texts = spark.createDataFrame([(1, "see mod12.py now"), (2, "src/mod1.py mod1.py"), (3, "")], "id int, text string")
    passages = spark.createDataFrame([(1, "mod1"), (2, "mod1.py"), (3, "none")], "i int, text string")
    found = relations.containing(texts, "id", passages, "i")
    assert rows(found) == [(1, 1), (2, 1), (2, 2)]
    assert "contains(__text" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
