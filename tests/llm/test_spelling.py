import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quarrylens.llm import queries, spelling

from .cases import awkward, table, with_clashes


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            drawn = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = drawn % len(run)
            counts[run[:at] + run[at + 1 :] if drawn % 199 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def dense(seed, count=400):
    """Documents of words of few letters, so that many are near each other and some halves are shared by most."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(count)] + ["stem" + "".join(rng.choice("xyzw") for _ in range(rng.randint(2, 4))) for _ in range(count)]
    return [(k, " ".join(rng.choice(words[: 1 + int(rng.random() ** 3 * len(words))]) for _ in range(300))) for k in range(60)]


@pytest.mark.parametrize("limits", [{}, {"group_rows": 5, "bucket_rows": 50}])
def test_same_as_all_pairs(spark, limits):
    docs = dense(1)
    expected = plain_variants(plain_words(docs))
    assert sum(x[1] is not None for x in expected) > 20 and max(x[4] for x in expected) > 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(spelling.variants(df, **limits)) == expected


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(150)})
    automaton = spelling.Automaton(words)
    for k, word in enumerate(words):
        state, number = automaton.walk(automaton.root, 0, word)
        assert automaton.final[state] and number == k
    assert len({(automaton.final[s], tuple(sorted((c, t) for c, (t, _) in e.items()))) for s, e in enumerate(automaton.edges)}) == len(automaton.edges)
    assert automaton.sizes[automaton.root] == len(words)
    assert spelling.Automaton([]).sizes == [0]


def test_groups_of_one_place_end_the_refinement(spark):
    words = spark.createDataFrame([(f"stable{c}", 9) for c in "abcdefghij"] + [("stable", 50)], "word string, n long")
    rows = spelling.refined(spelling.dealt(words), 2).collect()
    assert max(r.high - r.low for r in rows if r.part.count("stable")) == 1
    near = {r.word: (r.n_near, r.best) for r in spelling.neighbours(words, 2, 4).collect()}
    assert near == {"stable": (10, "stablea")} | {f"stable{c}": (10, "stable") for c in "abcdefghij"}


def test_chains_and_ties(spark):
    counts = {"colour": 1000, "colours": 200, "coloursx": 40, "coloursxy": 8, "kolour": 5, "bbbbbb": 7, "bbbbbbb": 7, "abbbbb": 7}
    docs = [(k, " ".join(w for w, n in counts.items() for _ in range(n))) for k in range(1)]
    result = found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert result == plain_variants(plain_words(docs))


def test_awkward_rows(spark):
    rows = awkward() * 5
    docs = [(d, t) for d, t, *_ in rows]
    assert found(spelling.variants(with_clashes(table(spark, rows)))) == plain_variants(plain_words(docs))


def test_empty_table(spark):
    assert found(spelling.variants(table(spark, []))) == []


def test_query(spark, data):
    expected = plain_variants(plain_words((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()))
    assert found(queries.op13_spelling(spark, data)) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op13_spelling']})").fetchall(), key=repr) == expected
