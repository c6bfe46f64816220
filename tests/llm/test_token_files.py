import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from quarrylens.llm import queries, token_files

from .cases import awkward, table, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_texts_like_the_library():
    texts = [t or "" for _, t, *_ in awkward()] + ["<|endoftext|> it's", "x  y\n\n z ", "²½ Ⅷ"]
    found = token_files.encode_texts([t.encode() for t in texts], PATH, public_tokenizers.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [ids_of(t)[:-1] for t in texts]


def test_awkward_rows(spark, tmp_path):
    files = token_files.write_tokens(with_clashes(table(spark)), PATH, public_tokenizers.PATTERN, 2, f"file://{tmp_path}/t")
    rows = token_files.read_tokens(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((d for d, *_ in awkward()), key=lambda d: -1 if d is None else d)
    assert sorted((repr(r.doc_id), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in rows) == sorted((repr(d), ids_of(t)) for d, t, *_ in awkward())
    assert [r.start for r in rows] == [sum(len(x.ids) // 4 for x in rows[:k]) for k in range(len(rows))]


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_tokens(spark, data).collect()}
    start, expected = 0, {}
    for d in docs:
        ids = ids_of(d.text)
        expected[d.doc_id] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert found == expected


def test_files_are_plain_zstandard_and_damage_is_found(spark, tmp_path):
    rows = [(k, f"text number {k}", "", "", 0) for k in range(20)]
    ((name, docs, ids),) = token_files.write_tokens(table(spark, rows).coalesce(1), PATH, public_tokenizers.PATTERN, 2, f"file://{tmp_path}/t")[:1]
    path = name.removeprefix("file://")
    raw = open(path, "rb").read()
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read(-1) for _ in range(1))
    file = token_files.TokenFile(name)
    assert docs == len(file) and len(whole) == 4 * ids and whole == b"".join(file.ids(k) for k in range(len(file)))
    hurt = bytearray(raw)
    hurt[int(file.starts[1]) + 12] ^= 0xFF
    open(f"{path}x", "wb").write(hurt)
    broken = token_files.TokenFile(f"{name}x")
    assert broken.ids(0) == file.ids(0)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.ids(1)


def test_only_documents_asked_for_are_read(spark, tmp_path):
    rows = [(k, f"text number {k}", "", "", 0) for k in range(50)]
    files = token_files.write_tokens(table(spark, rows), PATH, public_tokenizers.PATTERN, 2, f"file://{tmp_path}/t", file_bytes_limit=100)
    assert len(files) > 4
    asked = spark.createDataFrame([(3,), (41,), (41,), (99,)], "doc_id long")
    got = token_files.fetch(spark, files, asked).collect()
    assert sorted((r.doc_id, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in got) == [(k, ids_of(rows[k][1])) for k in (3, 41)]
    assert sum(len(token_files.TokenFile(name).find(7)) for name, *_ in files) == 1


def test_empty_table(spark, tmp_path):
    files = token_files.write_tokens(table(spark, []), PATH, public_tokenizers.PATTERN, 2, f"file://{tmp_path}/t")
    assert files == [] and token_files.read_tokens(spark, files).collect() == []


def test_added_tokens_like_the_library_by_default():
    plain = Tokenizer.from_file(PATH)
    texts = ["a b<|endoftext|>c", "<|endoftext|>", "x <|endoftext|> it's <|endoftext|><|endoftext|>\n", "none", "", "<|endoftext"]
    found = token_files.encode_texts([t.encode() for t in texts], PATH, public_tokenizers.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
