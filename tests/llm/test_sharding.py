import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import queries, sharding

from .cases import CLASHES, awkward, table, with_clashes


def check(rows, shards):
    counts = collections.Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[k] for k in range(shards)) <= 1
    for k, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))


def test_awkward_rows(spark):
    rows = sharding.shuffled(with_clashes(table(spark)), shards=4, bucket_bytes=1 << 16).collect()
    check(rows, 4)
    assert sorted((repr(r.doc_id), r.text or "") for r in rows) == sorted((repr(d), t or "") for d, t, *_ in awkward())
    assert {r["payload"] for r in rows} == {CLASHES["payload"]}


def test_order_depends_on_the_seed_alone(spark):
    rows = [(k, f"t{k}", "", "", 0) for k in range(300)]
    place = lambda df, **o: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(df, shards=5, bucket_bytes=600, **o).collect()}
    one = place(table(spark, rows).coalesce(1))
    assert one == place(table(spark, rows[::-1]).repartition(6)) != place(table(spark, rows), seed=7)
    runs = sum(one[k + 1][1] == one[k][1] + 1 for k in range(299))
    assert runs < 20  # neighbours are parted


@pytest.mark.parametrize("bucket_bytes", [1, 700, 10**6])
def test_scatter_and_shuffle_like_plain_python(spark, bucket_bytes):
    """Both passes again: rows by the cells of their hash into buckets, a Fisher-Yates shuffle of each, cuts of the whole order."""
    rows = [(k, f"t{k * k}", "", "", 0) for k in range(200)]
    df = table(spark, rows)
    total = sum(len(t) + 8 for _, t, *_ in rows)
    cells = max(sharding.CELLS, 1 << (sharding.FINE * total // bucket_bytes).bit_length())
    hashes = {r.doc_id: r.h % cells for r in df.select("doc_id", F.xxhash64(F.lit(sharding.SEED), "doc_id", "text").alias("h")).collect()}
    buckets, before = {}, 0
    for cell in sorted(set(hashes.values())):
        own = [r for r in rows if hashes[r[0]] == cell]
        buckets.setdefault(before // bucket_bytes, []).extend(own)
        before += sum(len(t) + 8 for _, t, *_ in own)
    order = []
    for number, own in sorted(buckets.items()):
        own = sorted(r[0] for r in own)
        order += [own[i] for i in np.random.default_rng([sharding.SEED, number]).permutation(np.arange(len(own)))]
    edges = [k * len(rows) // 7 for k in range(8)]
    expected = {d: (s := next(k for k in range(7) if edges[k] <= p < edges[k + 1]), p - edges[s]) for p, d in enumerate(order)}
    got = sharding.shuffled(df, shards=7, bucket_bytes=bucket_bytes).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == expected


def test_query(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op8_sharding(spark, data).collect()
    check(rows, 24)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_empty_table(spark, tmp_path):
    assert sharding.write_shards(table(spark, []), f"file://{tmp_path}/s").collect() == []
