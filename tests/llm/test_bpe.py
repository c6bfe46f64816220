import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quarrylens.llm import bpe, queries, splitting

from .cases import awkward, table, with_clashes

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(text):
    ids = ENCODING.encode_ordinary(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_ranks_are_read():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        piece, rank = file.readline().split()
    assert RANKS[base64.b64decode(piece)] == int(rank)


def test_awkward_rows_like_the_library(spark):
    coded = bpe.encode(with_clashes(table(spark)), RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((repr(d), ENCODING.encode_ordinary(t or "")) for d, t, *_ in awkward())
    assert sorted((repr(r.doc_id), r.ids) for r in coded) == expected


def test_decoding_gives_the_text_back(spark):
    coded = bpe.encode(table(spark), RANKS, public_tokenizers.PATTERN)
    got = sorted(bytes(r.data) for r in bpe.decoded(coded, RANKS).collect())
    assert got == sorted((t or "").encode() for _, t, *_ in awkward())


def test_empty_table(spark):
    assert bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, data).collect()}
    assert found == {r.doc_id: digests(r.text or "") for r in rows}


def test_ids_without_a_piece_raise():
    with pytest.raises((IndexError, TypeError)):
        bpe.decode([10**6], bpe.piece_list(RANKS))


def test_long_words_merge_as_the_fold_does(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("theingaé") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    assert folded(spark, words, RANKS) == [bpe.encoded_long(w.encode(), RANKS) for w in words]


def folded(spark, words, ranks):
    df = spark.createDataFrame([(w.encode(), [ranks[bytes([b])] for b in w.encode()]) for w in words], "word binary, ids array<bigint>")
    return [r[0] for r in df.select(bpe.encoded_word(df["word"], df["ids"], bpe.rank_literal(ranks))).collect()]


def test_words_that_merges_do_not_reach(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"xy": 256, b"abcd": 257}
    encoding = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["abcd", "abcde", "xyxy", "x", "axy"]
    assert folded(spark, words, ranks) == [encoding.encode_ordinary(w) for w in words] == [bpe.encoded_long(w.encode(), ranks) for w in words]


def test_the_hash_of_pairs_is_perfect():
    rng = random.Random(9)
    pairs = {rng.randrange(1 << 2 * bpe.ID): rng.randrange(bpe.NONE) for _ in range(3000)}
    shifts, slots = bpe.perfect_hash(pairs)
    assert all(slots[(k % len(slots) + shifts[k % len(shifts)]) % len(slots)] == k << bpe.ID | v for k, v in pairs.items())
    assert sum(x != bpe.EMPTY for x in slots) == len(pairs)


def test_splitting_like_the_pattern():
    rng = random.Random(8)
    split, find = splitting.Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    exact = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    assert find("a b") == exact("a b")
    parts = ["a", "B", "é", "1", " ", "  ", "\n", "\t", ".", ",!", "ß", "'s", "²", "\r\n", "日", "\x1c", "\x85", "\xa0", " ", " ", "​", " ", "　"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        distinct, numbers, counts = split.words([t.encode() for t in texts])
        assert [distinct[k].decode() for k in numbers] == [w for t in texts for w in exact(t)]
        assert counts.tolist() == [len(exact(t)) for t in texts]


def test_the_plan_does_not_spell_out_the_ranks(spark):
    """The driver keeps and sends a plan's description each time a stage ends."""
    coded = bpe.encode(table(spark), RANKS, public_tokenizers.PATTERN)
    assert len(coded._jdf.queryExecution().toString()) < 100_000
    word = "thethethe"
    df = spark.createDataFrame([(word.encode(), [RANKS[bytes([b])] for b in word.encode()])], "word binary, ids array<bigint>")
    by_row = df.withColumn("ranks", bpe.rank_row(spark, RANKS)).select(bpe.encoded_word(df["word"], df["ids"], F.col("ranks")))
    assert by_row.head()[0] == ENCODING.encode_ordinary(word)
