import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from quarrylens.llm import near_copies

from .cases import CLASHES, awkward, table, with_clashes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """The least doc_id of each class."""
    sets = [shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if group[i] != group[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
            group = [group[i] if g == group[j] else g for g in group]
    ids = {}
    for g, (d, *_) in zip(group, rows, strict=True):
        ids[g] = min((x for x in (ids.get(g), d) if x is not None), default=None)
    return sorted(map(repr, ids.values()))


def planted():
    """Copies with words changed, some of them near and some not, of two texts, and texts that share a passage only."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(900)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    texts = []
    for size in (300, 120):
        base = words(size)
        for k in range(60):
            copy = list(base)
            for at in rng.sample(range(size), k % 12):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
    passage = words(40)
    texts += [passage + words(rng.randrange(5, 40)) for _ in range(60)]
    texts += [words(200) for _ in range(20)]
    rng.shuffle(texts)
    return [(k, " ".join(t), "en", "a", 1) for k, t in enumerate(texts)]


def test_stage_finds_planted_near_copies(spark, data):
    rows = planted()
    kept = corpus_pipeline.distinct(spark, table(spark, rows), data).collect()
    assert sorted(repr(r.doc_id) for r in kept) == kept_by_brute_force(rows)


def test_awkward_rows(spark):
    kept = near_copies.deduplicated(with_clashes(table(spark))).collect()
    assert sorted(repr(r.doc_id) for r in kept) == kept_by_brute_force(awkward())
    assert all(r["fp"] == CLASHES["fp"] for r in kept) and kept[0].asDict().keys() == {*table(spark).columns, *CLASHES}
    assert near_copies.deduplicated(table(spark, [])).collect() == []


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 9, 10, 57, 300):
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2 * n, np.uint64)
            lost = int(rng.integers(0, n // 9 + 1))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[lost:n], pool[n : n + lost]]))
            frequent = np.sort(rng.permutation(pool)[:n])
            ranks = rng.permutation(n) + 1
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert len(np.intersect1d(near_copies.prefix(a, frequent, ranks), near_copies.prefix(b, frequent, ranks)))


def test_sketches_keep_all_similar_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 64, 65, 300, 1030):
        for lost in range(0, n // 8 + 1, max(1, n // 40)):
            pool = rng.integers(0, 2**63, 2 * n, np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[lost : n + lost // 2])
            both = len(np.intersect1d(a, b))
            near = near_copies.may_reach(len(a), len(b), near_copies.sketch(a), near_copies.sketch(b))
            assert near or 5 * both < 4 * (len(a) + len(b) - both)
    far = [np.unique(rng.integers(0, 2**63, 300, np.uint64)) for _ in range(2)]
    assert not near_copies.may_reach(300, 300, *map(near_copies.sketch, far))


def test_parts_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    for n in (1, 3, 4, 5, 6, 9, 10, 57, 300, 3000):
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2 * n, np.uint64)
            less, more = int(rng.integers(0, n // 6 + 1)), int(rng.integers(0, n // 6 + 1))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[less:n], pool[n : n + more]]))
            frequent = np.sort(rng.permutation(pool)[: int(rng.integers(0, n + 1))])
            ranks = rng.permutation(len(frequent)) + 1
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                assert len(np.intersect1d(near_copies.parts_of(a, frequent, ranks), near_copies.parts_of(b, frequent, ranks)))
    assert not len(near_copies.parts_of(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2))


def test_texts_of_frequent_passages_rarely_share_a_part():
    rng = np.random.default_rng(7)
    passages = rng.integers(0, 2**63, (400, 12), np.uint64)
    sets = [np.unique(passages[rng.choice(400, 30, replace=False)]) for _ in range(200)]
    frequent = np.unique(passages)
    ranks = np.arange(len(frequent)) + 1
    parts = [set(near_copies.parts_of(x, frequent, ranks).tolist()) for x in sets]
    prefixes = [set(near_copies.prefix(x, frequent, ranks).tolist()) for x in sets]
    met, before = (sum(bool(a & b) for a, b in combinations(x, 2)) for x in (parts, prefixes))
    assert 10 * met < before


def test_large_postings_are_never_brought_together(spark):
    members = spark.range(5000).selectExpr("id % 2 key", "id node", "10 n", "id label").union(spark.createDataFrame([(2, 1, 10, 1), (3, 1, 10, 1), (3, 2, 10, 2)], "key long, node long, n int, label long"))
    posted = near_copies.postings(members.union(members))
    assert {r.key: len(r.members) for r in posted.collect()} == {0: near_copies.SMALL + 1, 1: near_copies.SMALL + 1, 3: 2}
    crowd = near_copies.crowded(members, posted)
    assert crowd.count() == 5000
    pairs = near_copies.leader_pairs(crowd).collect()
    assert len(pairs) <= 5000 * near_copies.LEADERS and {x for p in pairs for x in p} == set(range(5000))


def test_all_turns_keep_one_of_each_class(spark, monkeypatch):
    """With postings that are large from three sets on, most links come from parts."""
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    rows = planted()
    rows += [(len(rows) + k, f"{t} {t}"[:-k], "en", "a", 1) for k, (_, t, *_) in enumerate(rows[:40], 1)]
    kept = near_copies.deduplicated(table(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in kept) == kept_by_brute_force(rows)


def family(copies, seed):
    """Copies of one text of which some are near many others, and some are too far from all but have most parts in common with them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(copies):
        text = list(base)
        for at in rng.sample(range(len(base)), rng.choice([0, 1, 1, 2, 3, 4, 5])):
            text[at] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(text), "en", "a", 1))
    return rows


def test_sets_of_a_crowd_that_are_in_no_class_do_not_meet_all_others(spark, monkeypatch):
    seen, before = [], near_copies.sketched

    def counted(pairs, nodes):
        seen.append(pairs.count())
        return before(pairs, nodes)

    monkeypatch.setattr(near_copies, "sketched", counted)
    rows = family(500, 3)
    kept = near_copies.deduplicated(table(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in kept) == kept_by_brute_force(rows)
    assert len(kept) > 50 and len(seen) == 3 and seen[-1] <= len(rows)


def test_groups_lose_no_link(spark):
    """Whatever the labels, and with or without a core."""
    rng = np.random.default_rng(9)
    for start in range(6):
        sets, size = {}, (20, 60, 150)[start % 3]
        pool = rng.integers(0, 2**63, 40 * size, np.uint64)
        for k in range(60):
            base = pool[:size] if k % 3 else pool[size * (k % 9) : size * (k % 9 + 1)]
            lost = rng.choice(size, int(rng.integers(0, size // 5 + 1)), replace=False)
            gained = rng.choice(pool if k % 2 else pool[: 2 * size], int(rng.integers(0, size // 8 + 1)), replace=False)
            sets[k] = np.unique(np.concatenate([np.delete(base, lost), gained]))
        labels = {k: k if start < 3 else k % 20 for k in sets}
        members = spark.createDataFrame([(g, k, labels[k]) for g in (7, 8) for k in sets if g == 7 or k % 2], "group long, node long, label long")
        hashes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in sets.items()], "node long, hashes binary")
        found = [(r.a, r.b) for r in near_copies.group_pairs(members, hashes).collect()]

        def near(a, b, sets=sets):
            both = len(np.intersect1d(sets[a], sets[b]))
            return 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)

        def classes(pairs, labels=labels):
            group = dict(labels)
            for a, b in pairs:
                group = {k: group[a] if g == group[b] else g for k, g in group.items()}
            return {frozenset(k for k in group if group[k] == g) for g in group.values()}

        links = [x for x in combinations(sets, 2) if near(*x)]
        assert links and classes(x for x in found if near(*x)) == classes(links)
        assert all(a < b for a, b in found)
