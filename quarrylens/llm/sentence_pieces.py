"""SentencePiece encoding and decoding for models of merge type (BPE).

A word's ids are found by exact backtracking: an Aho-Corasick automaton gives the longest piece at each place;
two pieces may stand side by side only if merging what they hold gives these two again; where no piece fits, the
last one is taken back for a shorter one, and a bitfield keeps the places from which nothing led on. Pieces never
hold a space after another sign, so texts are cut before such spaces, and each distinct word of a block is
encoded once. A model whose pieces do hold such spaces is taken too; its texts are one word each.

Rows: null texts count as empty; an empty text has no ids but the end id; repeated rows give a row each; an empty
table gives an empty result; any further columns are kept out, only ``keep`` is carried. Signs outside the
vocabulary become their bytes, or one unknown id a run if the model has no pieces for bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import common
from .splitting import gathered

#: The sign that stands for a space, and what an unknown id decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Bytes of a block's raw texts; signs of a word that is remembered, and how many of them.
BLOCK, SHORT, REMEMBERED = 16 << 20, 64, 200_000


class Pieces(NamedTuple):
    """A model's vocabulary."""

    #: Id and rank (the least merges first) of each piece that text can have.
    ids: dict[str, int]
    ranks: dict[str, float]
    #: The id of each byte; empty if the model has none.
    bytes: list[int]
    unknown: int
    end: int
    #: What each id decodes to.
    surfaces: list[bytes]
    #: Of each id: it is a byte; it decodes to nothing wherever it stands.
    is_byte: list[bool]
    is_control: list[bool]


def load_pieces(path: str) -> Pieces:
    """The vocabulary of a model without text normalisation, with byte fallback or an unknown id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    names = [model.id_to_piece(k) for k in size]
    byte, control = [model.is_byte(k) for k in size], [model.is_control(k) for k in size]
    plain = [k for k in size if not (byte[k] or control[k] or model.is_unknown(k) or model.is_unused(k))]
    of_byte = {int(names[k][3:5], 16): k for k in size if byte[k]}
    surfaces = [bytes([int(names[k][3:5], 16)]) if byte[k] else b"" if control[k] else UNKNOWN.encode() if model.is_unknown(k) else names[k].replace(SPACE, " ").encode() for k in size]
    pieces = Pieces({names[k]: k for k in plain}, {names[k]: -model.get_score(k) for k in plain}, [of_byte[b] for b in range(256)] if len(of_byte) == 256 else [], model.unk_id(), model.eos_id(), surfaces, byte, control)
    probe = Encoder(pieces)
    for text in ("ﬁ ½  é \tA", "  two  spaces ", "日本\U0001f600"):
        if probe.ids(text) != model.encode(text):
            raise ValueError("only models that leave texts as they are, with a space put before them, are taken")
    return pieces


class Encoder:
    """Encodes words, and texts, by a vocabulary."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in pieces.ids)
        self.matches = ahocorasick.Automaton()
        for piece in pieces.ids:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        #: By the piece before (none: the empty text) and the piece: whether it may follow; and how many are remembered.
        self.fits: dict[str, dict[str, bool]] = {}
        self.count = 0
        self.shorter: dict[str, str] = {}
        self.known: dict[bytes, list[int]] = {}

    def merged(self, text: str, edge: int = 0) -> list[str]:
        """What merging leaves: of adjacent parts those of least rank are joined, the leftmost of equals first. Nothing if a place that must stay an edge is crossed."""
        rank, parts = self.pieces.ranks.get, list(text)
        ranks = [rank(a + b, np.inf) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == np.inf:
                break
            k = ranks.index(least)
            if k < edge:
                edge -= 1
                if k == edge:
                    return []
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], np.inf)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], np.inf)
        return parts

    def may_follow(self, last: str, piece: str) -> bool:
        """Whether merging leaves these pieces as they are, side by side; an empty last one stands for the word's start."""
        if self.count >= REMEMBERED:
            self.fits.clear()
            self.count = 0
        self.count += 1
        found = self.fits.setdefault(last, {})[piece] = self.merged(last + piece, len(last)) == ([last, piece] if last else [piece])
        return found

    def shortened(self, piece: str) -> str:
        """The longest piece that a piece begins with, other than itself; empty if there is none. One sign is a piece."""
        found = self.shorter.get(piece)
        if found is None:
            found = self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.pieces.ids), "")
        return found

    def split(self, word: str) -> list[str]:
        """The word's pieces."""
        # by place the longest piece that starts there, as the vocabulary's own text, whose hash is known; later matches are longer
        longest = list(word)
        for end, piece in self.matches.iter(word):
            longest[end + 1 - len(piece)] = piece
        fits, none, size = self.fits, {}, len(word)
        failed = None
        out: list[str] = []
        at, last = 0, ""
        piece = longest[0] if word else ""
        while at < size:
            follows = fits.get(last, none)
            while piece:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    found = follows.get(piece)
                    if found is None:
                        found = self.may_follow(last, piece)
                    if found:
                        break
                piece = self.shortened(piece)
            if piece:
                out.append(piece)
                at, last = end, piece
                if at < size:
                    piece = longest[at]
            else:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                piece = self.shortened(piece)
        return out

    def numbered(self, parts: list[str]) -> list[int]:
        ids, of_byte, unknown = self.pieces.ids, self.pieces.bytes, self.pieces.unknown
        try:
            return [ids[part] for part in parts]
        except KeyError:
            pass
        out: list[int] = []
        for part in parts:
            found = ids.get(part)
            if found is not None:
                out.append(found)
            elif of_byte:
                out += [of_byte[b] for b in part.encode()]
            elif not out or out[-1] != unknown:
                out.append(unknown)
        return out

    def word(self, word: bytes) -> list[int]:
        """The ids of a word of UTF-8 with its spaces."""
        found = self.known.get(word)
        if found is None:
            found = self.numbered(self.split(word.decode().replace(" ", SPACE)))
            if len(word) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def ids(self, text: str) -> list[int]:
        """A text's ids, without an end id."""
        words, numbers, _ = self.words([text.encode()])
        out = [i for k in numbers.tolist() for i in self.word(words[k])]
        return out if self.pieces.bytes else [i for k, i in enumerate(out) if i != self.pieces.unknown or not k or out[k - 1] != i]

    def words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words; the number of each word, text after text; each text's count of words. Texts get a space before them."""
        sign = SPACE.encode()
        texts = [b" " + t.replace(sign, b" ") if t else t for t in texts]
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        begins = np.append(0, ends[:-1]) if len(texts) else ends
        if self.cut:
            first = np.frombuffer(data, np.uint8) == 32
            first[1:] &= ~first[:-1]
            first[begins[begins < ends]] = True
            starts = np.flatnonzero(first)
        else:
            starts = begins[begins < ends]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(np.append(np.searchsorted(starts, begins), len(starts)))

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, each with the end id, and where each text's end."""
        words, numbers, counts = self.words(texts)
        parts = [*(self.word(w) for w in words), [self.pieces.end]]
        sizes = np.array([len(x) for x in parts], np.int64)
        flat = np.fromiter((i for x in parts for i in x), np.int32, int(sizes.sum()))
        numbers = np.insert(numbers.astype(np.int64), np.cumsum(counts), len(words))
        ends = np.append(0, np.cumsum(sizes[numbers]))[np.cumsum(counts + 1)]
        flat = gathered(flat, sizes, numbers)
        if self.pieces.bytes or not len(flat):
            return flat, ends
        kept = np.append(True, (flat[1:] != self.pieces.unknown) | (flat[:-1] != self.pieces.unknown))  # a text's last id is the end id, so runs stay in texts
        return flat[kept], np.append(0, np.cumsum(kept))[ends]


#: The encoder that this worker had last.
_held: list[Encoder] = []


def held_encoder(pieces: Pieces) -> Encoder:
    """A worker's encoder, kept for its next task, whose broadcast vocabulary is the same object; what it remembers is bounded."""
    if not _held or _held[0].pieces is not pieces:
        _held[:] = [Encoder(pieces)]
    return _held[0]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", keep: tuple[str, ...] = ("doc_id",), then: Callable[[pa.Table], pa.Table] | None = None, schema: str | StructType | None = None) -> DataFrame:
    """``keep`` and ``ids`` (array of int, the last one the end id) for every row.

    ``then``, if given, is applied to each block's table of these columns where it was made; ``schema`` is
    that of its result.
    """
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select(*keep, common.text_of(text).cast("binary").alias("__text"))
    vocabulary = spark.sparkContext.broadcast(pieces)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held_encoder(vocabulary.value)
        for table in common.pieces(batches, BLOCK):
            flat, ends = encoder.encoded(table["__text"].to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat, pa.int32()))
            out = table.drop_columns(["__text"]).append_column("ids", ids)
            yield from (then(out) if then else out).combine_chunks().to_batches()

    return rows.mapInArrow(common.lean(each), schema or StructType([*rows.drop("__text").schema.fields, StructField("ids", ArrayType(IntegerType()))]))


class Decoder:
    """Ids to text, as the library's decode."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.sizes = np.array([len(x) for x in pieces.surfaces], np.int64)
        self.flat = np.frombuffer(b"".join(pieces.surfaces), np.uint8)
        self.is_byte, self.is_control = np.array(pieces.is_byte), np.array(pieces.is_control)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the ids' text; without the space that was put before it; a byte that is part of no sign is U+FFFD."""
        said = np.flatnonzero(~self.is_control[ids])
        if not len(said):
            return b""
        data = gathered(self.flat, self.sizes, ids).tobytes()
        apart = said[-1] - said[0] >= len(said)  # bytes on both sides of a control id are no sign
        try:
            data.decode()
        except UnicodeDecodeError:
            apart = True
        if apart:
            data = self.mended(ids)
        first = int(ids[said[0]])
        return data[1:] if not self.is_byte[first] and first != self.pieces.unknown and data[:1] == b" " else data

    def mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for k in [*ids.tolist(), None]:
            if k is not None and self.is_byte[k]:
                run += self.pieces.surfaces[k]
                continue
            while run:
                size = next((n for n in range(1, 5) if _valid(run[:n])), 0)
                out.append(run[:size] if size else "�".encode())
                run = run[size or 1 :]
            if k is not None:
                out.append(self.pieces.surfaces[k])
        return b"".join(out)


def _valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def decoded(coded: DataFrame, pieces: Pieces, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and text of rows with ids; null ids have null."""
    vocabulary = coded.sparkSession.sparkContext.broadcast(pieces)
    schema = StructType([*(coded.schema[x] for x in keep), StructField("text", StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(vocabulary.value)
        for batch in batches:
            texts = pa.array([None if x is None else decode(np.array(x, np.int64)).decode() for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return coded.select(*keep, F.col("ids")).mapInArrow(common.lean(each), schema)
