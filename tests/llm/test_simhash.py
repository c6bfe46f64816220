import random
import re

import numpy as np
import xxhash

from quarrylens.llm import simhash

from .cases import awkward, table, with_clashes


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints):
    """The class of each fingerprint: its least doc_id."""
    values = sorted({f for _, f in prints})
    parent = {f: f for f in values}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return {f: least.get(find(f)) for f in values}


def test_fingerprints_of_awkward_rows(spark):
    got = sorted((repr(r.doc_id), r.fp & (2**64 - 1)) for r in simhash.fingerprints(with_clashes(table(spark))).collect())
    assert got == sorted((repr(d), plain(t)) for d, t, *_ in awkward())


def test_classes_of_awkward_rows(spark):
    prints = [(d, plain(t)) for d, t, *_ in awkward()]
    of = classes_of(prints)
    got = sorted((repr(r.doc_id), r.fp & (2**64 - 1), repr(r.component_id)) for r in simhash.near_duplicates(with_clashes(table(spark))).collect())
    assert got == sorted((repr(d), f, repr(of[f])) for d, f in prints)


def test_empty_tables(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []


def test_links_join_all_that_are_close(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    values = {s for s in seeds}
    for s in seeds:
        chain = s
        for _ in range(15):
            chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(chain)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    labels = {r.node & (2**64 - 1): r.label for r in simhash.components(edges).collect()}
    expected = classes_of(list(enumerate(sorted(values))))
    groups = {}
    for v in values:
        groups.setdefault(expected[v], set()).add(labels.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_full_posting_takes_no_pairs():
    entries = np.arange(1 << 12, dtype=np.int64)
    assert len(simhash.posting_links(entries, (0, 1))) == len(entries) - 1


def test_tally_counts_shared_positional_bytes():
    rng = random.Random(4)
    pairs = [(v := rng.getrandbits(64), v ^ rng.getrandbits(rng.randrange(1, 64))) for _ in range(300)]
    a, b = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    assert simhash.tally(a, b).tolist() == [sum(x >> 8 * k & 255 == y >> 8 * k & 255 for k in range(8)) for x, y in pairs]
    # the guaranteed minimum lacks no pair within two bits
    assert all(simhash.tally(a[k : k + 1], b[k : k + 1])[0] >= simhash.SHARED for k, (x, y) in enumerate(pairs) if (x ^ y).bit_count() <= 2)


def test_partners_of_a_large_posting_are_all_pairs_that_pass():
    rng = np.random.default_rng(5)
    rest = rng.choice(1 << 16, 900, replace=False)
    got = {(min(a, b), max(a, b)) for a, b in zip(*(x.tolist() for x in simhash.partners(rest)), strict=True)}
    assert got == {(i, j) for i in range(900) for j in range(i + 1, 900) if int(rest[i] ^ rest[j]).bit_count() <= 2}
