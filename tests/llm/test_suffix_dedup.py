import random

import numpy as np
import pytest

from quarrylens.llm import suffix_dedup

from .cases import awkward, table, with_clashes


def brute(rows, length):
    first = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - length + 1):
                first[t[i : i + length]] = min(first.get(t[i : i + length], d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - length + 1):
                if first[t[i : i + length]] < d:
                    gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((repr(d), len(t), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out)


def found(df, **options):
    return sorted((repr(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, **options).collect())


@pytest.mark.parametrize("hot", [1024, 2])
def test_awkward_rows(spark, hot):
    expected = brute([(d, (t or "").encode()) for d, t, *_ in awkward()], 50)
    assert found(with_clashes(table(spark)), hot=hot) == expected


@pytest.mark.parametrize("hot", [1024, 3])
def test_random_repeats(spark, hot):
    rng = random.Random(4)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = [(rng.randint(0, 60), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "", "", 0) for _ in range(80)]
    assert found(table(spark, rows), hot=hot) == brute([(r[0], r[1].encode()) for r in rows], 50)


def test_empty_table(spark):
    assert found(table(spark, [])) == []


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 9)
    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (3000, 49, 50, 0, 700)]
    rows, starts, counts, _ = suffix_dedup.anchored(texts, 50)
    windows = sorted((r, s + i) for r, s, c in zip(rows.tolist(), starts.tolist(), counts.tolist()) for i in range(c))
    assert windows == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]


def test_refined_pointers_are_the_order_of_the_strings():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(2000)) * 2
    pointer = suffix_dedup.refined(np.frombuffer(data, np.uint8), 50)
    strings = [data[i : i + 50] for i in range(len(data) - 49)]
    order = sorted(range(len(strings)), key=lambda i: strings[i])
    for a, b in zip(order, order[1:]):
        assert (pointer[a] == pointer[b]) == (strings[a] == strings[b]) and pointer[a] <= pointer[b]
