"""Greedy leaders in rounds against the sequential rule."""

import random

import pytest

from quarrylens.operators import leaders
from quarrylens.operators.leaders import leader_clusters

from .conftest import rows


def sequential(sets, share=0.5):
    leaders, out = [], []
    for owner, items, tags in sorted(sets, key=lambda x: x[0]):
        items, tags = set(items or ()) - {None}, set(tags or ()) - {None}
        name = next((n for n, i, t in leaders if i and items and len(i & items) > share * min(len(i), len(items)) and t & tags), None)
        if name is None:
            name = owner
            leaders.append((owner, items, tags))
        out.append((owner, name))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "items", "share"), [(1, 12, 0.5), (2, 30, 0.3)])
def test_same_as_one_after_the_other(spark, seed, items, share):
    rng = random.Random(seed)
    sets = [(k, [rng.randrange(items) for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 2))]) for k in range(150)]
    df = spark.createDataFrame(sets, "owner long, items array<int>, tags array<string>")
    assert rows(leader_clusters(df, "owner", "items", share, "tags")) == sequential(sets, share)


def test_scopes_nulls_and_copies(spark):
    sets = [("b", ["x", "y", "y"], "1"), ("a", ["y", "x"], "1"), ("c", ["x", "y", "z"], "2"), ("d", None, "1"), ("e", [], "1"), ("f", [None], "1"), ("g", ["x", "y", "z"], None), ("h", ["y", "x", None], None)]
    df = spark.createDataFrame(sets, "owner string, items array<string>, scope string")
    assert rows(leader_clusters(df, "owner", "items", scope=("scope",))) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "f"), ("g", "g"), ("h", "g")]


def test_a_chain_and_an_item_that_all_share(spark):
    chain = [(k, [k, k + 1], ["t"]) for k in range(9)]  # neighbours share one of two items
    hub = [(100 + k, [-1, *range(1000 + 9 * k, 1009 + 9 * k)], ["t"]) for k in range(40)]
    df = spark.createDataFrame(chain + hub, "owner long, items array<int>, tags array<string>")
    assert rows(leader_clusters(df, "owner", "items", 0.4, "tags")) == sequential(chain + hub, 0.4)
    assert rows(leader_clusters(df.limit(0), "owner", "items")) == []


def test_blocks_change_nothing_and_pairs_are_not_all_made(spark, monkeypatch):
    rng = random.Random(5)
    sets = [(k, rng.sample(range(12), rng.randint(1, 6)), rng.sample("abc", rng.randint(1, 2))) for k in range(240)]
    df = spark.createDataFrame([*sets, (None, [1], ["a"])], "owner long, items array<int>, tags array<string>")
    made, keep = [], leaders.stored

    def counted(table, name):
        out = keep(table, name)
        made.extend([out.count()] if name == "edges" else [])
        return out

    monkeypatch.setattr(leaders, "stored", counted)
    monkeypatch.setattr(leaders, "BLOCK", 4)
    assert rows(leader_clusters(df, "owner", "items", 0.5, "tags")) == sorted([*sequential(sets, 0.5), (None, None)], key=repr)
    every = sum(len(set(a[1]) & set(b[1])) > 0.5 * min(len(a[1]), len(b[1])) and bool({*a[2]} & {*b[2]}) for a in sets for b in sets if a[0] < b[0])
    assert len(made) > 1 and sum(made) < every / 4
