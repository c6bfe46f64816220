import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quarrylens.llm import queries
from quarrylens.llm import sentence_pieces as sp

from .cases import awkward, table, with_clashes

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sp.load_pieces(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER, DECODER = sp.Encoder(PIECES), sp.Decoder(PIECES)


@pytest.mark.parametrize("text", ["", " ", "   ", "a  b ", "▁x ▁", "\tx\ny\r\n", "ﬁ ½ é", "<s></s><0x41>", "\x00a", "日本語😀", " " * 500, "a" * 3000, "▁" * 37 + "a"])
def test_like_the_library(text):
    assert ENCODER.ids(text) == LIBRARY.encode(text)
    ids = [*ENCODER.ids(text), PIECES.end]
    assert DECODER(np.array(ids)).decode() == LIBRARY.decode(ids)


def test_random_texts_like_the_library():
    rng = random.Random(3)
    parts = ["the", "ing", "a", "aa", "e", "é", " ", "  ", "\n", "st", "ion", "ß", "мир", "日", "😀", ".", "▁", "0", "1999", "n't", "́", "zz", "Q", "th", "er"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert ENCODER.ids(text) == LIBRARY.encode(text), text


def test_words_without_spaces_like_the_library():
    rng = random.Random(4)
    for alphabet in ("ab", "theinsr", "aeiouy\n\t", "=-_#", "é́e", "日本語一"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))
            assert ENCODER.ids(text) == LIBRARY.encode(text), text


def test_any_ids_decode_like_the_library():
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 28705]) for _ in range(rng.randint(0, 9))]
        assert DECODER(np.array(ids, np.int64)).decode() == LIBRARY.decode(ids), ids


def test_pieces_over_spaces_and_no_bytes():
    """A vocabulary of few pieces, some unreachable by merges, against plain merging of the whole text."""
    names = ["▁", "a", "b", "c", "ab", "abc", "bc", "a▁", "a▁b", "▁▁", "cab"]
    ranks = {p: float(r) for p, r in zip(names, [0, 0, 0, 0, 3, 4, 2, 5, 5, 1, 9], strict=True)}
    pieces = sp.Pieces({p: k + 3 for k, p in enumerate(names)}, ranks, [], 0, 2, [b""] * 14, [False] * 14, [False] * 14)
    encoder, rng = sp.Encoder(pieces), random.Random(6)
    assert not encoder.cut
    for _ in range(2000):
        text = "".join(rng.choice("abc  x") for _ in range(rng.randint(1, 14)))
        whole = encoder.merged(("▁" + text).replace(" ", "▁"))
        expected = [pieces.ids.get(p, 0) for p in whole]
        assert encoder.ids(text) == [i for k, i in enumerate(expected) if i or not k or expected[k - 1]]


def test_awkward_rows(spark):
    coded = sp.encode(with_clashes(table(spark)), PIECES)
    expected = sorted((repr(d), LIBRARY.encode(t or "", add_eos=True)) for d, t, *_ in awkward())
    assert sorted((repr(r.doc_id), r.ids) for r in coded.collect()) == expected
    texts = sorted(r.text for r in sp.decoded(coded, PIECES).collect())
    assert texts == sorted(LIBRARY.decode(LIBRARY.encode(t or "")) for _, t, *_ in awkward())


def test_empty_table(spark):
    assert sp.encode(table(spark, []), PIECES).collect() == []


def test_other_normalisations_are_refused(monkeypatch):
    monkeypatch.setattr(sp.Encoder, "ids", lambda self, text: [])
    with pytest.raises(ValueError, match="leave texts as they are"):
        sp.load_pieces(PATH)


def test_query(spark, data):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_sentencepiece(spark, data).collect()}
    expected = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        expected[r.doc_id] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert found == expected


def test_merging_looks_up_each_new_neighbour_once():
    class Counted(dict):
        asked = 0

        def get(self, *of):
            self.asked += 1
            return super().get(*of)

    ranks = Counted(PIECES.ranks)
    word = "▁" + "internationalisation" * 5
    parts = sp.Encoder(PIECES._replace(ranks=ranks)).merged(word)
    assert "".join(parts) == word and len(parts) < len(word)
    assert ranks.asked <= 3 * len(word)


def test_a_worker_keeps_the_encoder_of_its_vocabulary():
    first = sp.held_encoder(PIECES)
    assert sp.held_encoder(PIECES) is first
    assert sp.held_encoder(PIECES._replace(end=9)) is not first
