import random
import re
import time

import pytest

from quarrylens.llm import decontam

from .cases import awkward, table, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for d, text in docs:
        w, names = words(text), set()
        hit = [False] * len(w)
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    names |= own
                    hit[k : k + size] = [True] * size
        out.append((repr(d), len(w), sum(hit), sorted(x for x in names if x is not None)))
    return sorted(out)


def found(docs, items, **options):
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, items, **options).collect())


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("max_words", [10**6, 40])
def test_random_items(spark, max_words):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "É", "1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(k), say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(15)] + [(None, say(12)), ("0", say(12)), ("n", None)]
    docs = [(k, say(rng.randint(0, 120)) + rng.choice(["", " " + items[k % 15][1] + " x"]), "", "", 0) for k in range(40)]
    assert found(table(spark, docs), items_of(spark, items), max_words=max_words) == brute([r[:2] for r in docs], items)


def test_awkward_rows(spark):
    items = [("p", awkward()[0][1]), ("q", "one"), ("r", "")]
    assert found(with_clashes(table(spark)), items_of(spark, items)) == brute([r[:2] for r in awkward()], items)


def test_empty_tables(spark):
    assert found(table(spark, []), items_of(spark, [("a", "b")])) == []
    assert all(n == 0 for _, _, n, _ in found(table(spark), items_of(spark, [])))


def test_spans_are_cut_and_heavy_documents_go(spark):
    passage = "some words of a test item that nobody should ever train on"
    docs = [(1, f"Été: {passage.upper()}! " + "clean " * 40, "en", "s", 7), (2, passage, "en", "s", 8), (3, "clean", "en", "s", 5), (4, None, None, None, None)]
    kept = {r.doc_id: r for r in decontam.decontaminated(with_clashes(table(spark, docs)), items_of(spark, [("i", passage)])).collect()}
    assert set(kept) == {1, 3, 4}
    assert kept[1].text == "Été: ! " + "clean " * 40 and kept[1].n_chars == len(kept[1].text)
    assert (kept[3].text, kept[3].n_chars, kept[4].text, kept[3].cleaned) == ("clean", 5, None, "13")


def test_longest_match_is_tracked(spark):
    row = decontam.contamination(table(spark, [(1, "x a b c d y", "", "", 0)]), items_of(spark, [("i", "z a b c d q")])).head()
    assert (row.longest, row.n_hit) == (4, 0)


def test_repeated_short_items_cost_no_time_by_word():
    one = decontam.Automaton([(str(k), b"the") for k in range(20_000)] + [("two", b"of the"), ("w", b"a b c d e f g h i j k")] + [(f"w{k}", b"a b c d e f g h i j k") for k in range(5_000)], 10)
    started = time.process_time()
    longest, hits, names = one.scan([b"of", *[b"the"] * 5_000, *b"a b c d e f g h i j k".split() * 200])
    assert time.process_time() - started < 0.5
    assert (longest, len(names)) == (11, 25_002)
    assert hits == [(0, 7201)]
