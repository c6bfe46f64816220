import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quarrylens.llm import conversation_trie as trie
from quarrylens.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def plain_nodes(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        own_saved = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own_saved
    return sorted(
        ((min(c), len(n), min(members[n[:-1]]) if n else None, len(c), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, c in members.items()),
        key=repr,
    )


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def conversations(seed, count=120, longest=9, words=2):
    rng = random.Random(seed)
    out = []
    for c in range(count):
        for t in range(rng.randint(1, longest)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("turns", [trie.SHARD, 90, 20])
def test_same_as_plain_prefixes(spark, turns):
    rows = conversations(1)
    assert found(trie.nodes(spark.createDataFrame(rows, SCHEMA), turns)) == plain_nodes(rows)


def test_a_beginning_and_whole_conversations_that_most_share(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(30)]  # copies, and no family's head but their own
    rows += [(c, t, "user", f"turn {t}" if t < 25 else f"own {c} {t}") for c in range(100_000, 104_000, 20) for t in range(28)]
    assert found(trie.nodes(spark.createDataFrame(rows, SCHEMA), 500)) == plain_nodes(rows)


def test_one_very_long_conversation(spark):
    rows = [(20, t, "user", f"x {t % 3}") for t in range(250)] + [(40, t, "user", "y") for t in range(5)]
    got = found(trie.nodes(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 1 + 250 + 5 and got == plain_nodes(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, "user", "no number"),
        (1, None, "assistant", "no number either"),
        (1, 0, None, None),
        (1, 0, "", ""),
        (1, 5, "user", "tie"),
        (1, 5, "user", "tie"),
        (None, 0, "user", "no conversation"),
        (None, None, None, None),
        (20, 0, "user", "é 日本 " + "word " * 30_000),
        (20, 1, "us", "er"),
        (21, 0, "u", "ser"),
        (22, 0, "user", ""),
        (-3, 0, "user", "negative"),
        (-20, 0, "user", "negative head"),
        (2**62, -5, "user", "large"),
        *((23 + k, 0, "user", "only turn") for k in range(16)),
    ]
    df = spark.createDataFrame([(*r, "1", "2") for r in rows], SCHEMA + ", labels string, facts string")
    # Spark's remainder has the dividend's sign
    assert found(trie.nodes(df)) == sorted((x for x in plain_nodes_truncated(rows)), key=repr)


def plain_nodes_truncated(rows):
    """The same, with the remainder of negative ids as SQL has it."""

    class Id(int):
        def __mod__(self, by):
            return int(np.fmod(int(self), by))

        def __sub__(self, by):
            return int(self) - by

    return plain_nodes([(Id(r[0]) if r[0] is not None else None, *r[1:]) for r in rows])


def test_empty_table(spark):
    assert found(trie.nodes(spark.createDataFrame([], SCHEMA))) == []


def test_bits_tell_the_tree():
    rng = random.Random(3)
    paths = sorted({tuple(rng.randrange(3) for _ in range(rng.randint(0, 6))) for _ in range(60)})
    labels = np.array([(x, x) for p in paths for x in p], np.uint64).reshape(-1, 2)
    louds = trie.Louds(labels, np.array([len(p) for p in paths]))
    nodes = sorted({p[:d] for p in paths for d in range(len(p) + 1)}, key=lambda n: (len(n), n))
    assert len(louds.bits) == 2 * len(nodes) - 1
    parents = louds.parents().tolist()
    assert [nodes[k] for k in parents[1:]] == [n[:-1] for n in nodes[1:]]
    assert louds.degrees().tolist() == [sum(m[:-1] == n and m != () for m in nodes) for n in nodes]
    assert [int(labels[k][0]) for k in louds.label_at[1:]] == [n[-1] for n in nodes[1:]]


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = plain_nodes(rows)
    assert found(queries.op11_trie(spark, data)) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.SQL['op11_trie']})").fetchall(), key=repr) == expected
