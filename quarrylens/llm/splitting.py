"""Splitting texts into the words that a byte-level tokenizer encodes by themselves."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex

#: Unicode's White_Space, which the patterns' ``\s`` means; Python's has U+001C to U+001F too.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the public pattern that the short way below is for.
COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = bytes(range(128))
#: Latin letters beyond ASCII.
LETTERS = frozenset(c for c in map(chr, range(128, 0x250)) if unicodedata.category(c)[0] == "L")
#: Bytes of texts whose words' starts are found at once, unless a single text is longer.
STRETCH = 1 << 20
#: Byte classes: other signs, letters (all beyond ASCII), digits, white space.
OTHER, LETTER, DIGIT, BLANK, EDGE = range(5)
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK


class Splitter:
    """Splits the UTF-8 of texts by a pattern."""

    def __init__(self, pattern: str):
        exact = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.find = regex.compile(exact).findall
        self.common = pattern == COMMON

    def plain(self, data: bytes) -> bool:
        """Whether only letters are beyond ASCII and nothing is a contraction, so that byte classes tell the words."""
        return self.common and b"'" not in data and LETTERS.issuperset(data.translate(None, ASCII).decode())

    def words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words; the number of each word, text after text; each text's count of words."""
        plain = [k for k, t in enumerate(texts) if t and self.plain(t)]
        distinct, numbers, counts = _plain_words([texts[k] for k in plain])
        if len(plain) == len(texts):
            return distinct, numbers, counts
        place = {w: k for k, w in enumerate(distinct)}
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for k, part in zip(plain, np.split(numbers, np.cumsum(counts)[:-1]), strict=True) if plain else ():
            parts[k] = part
        for k in sorted(set(range(len(texts))) - set(plain)):
            parts[k] = np.array([place.setdefault(w.encode(), len(place)) for w in self.find(texts[k].decode())], np.int32)
        return list(place), np.concatenate(parts), np.array([len(x) for x in parts])

    def __call__(self, data: bytes) -> list[bytes]:
        distinct, numbers, _ = self.words([data])
        return [distinct[k] for k in numbers.tolist()]


def _plain_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    if not texts:
        return [], np.zeros(0, np.int32), np.zeros(0, np.int64)
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = np.append(0, ends[:-1])
    # whole texts of some STRETCH bytes at a time, as the starts take many times the memory of the texts on the way
    cuts = np.flatnonzero(np.diff(begins // STRETCH, prepend=-1)).tolist()
    found = [_word_starts(buf[begins[a] : ends[b - 1]], ends[a:b] - begins[a]) + begins[a] for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)]
    found.append(np.array([len(buf)], np.int64))
    offsets = np.concatenate(found)
    del found
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    counts = np.diff(np.append(np.searchsorted(offsets[:-1], begins), len(offsets) - 1))
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts


def _word_starts(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of texts start that end there."""
    own = CLASS[buf]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.append(0, ends[:-1])] = EDGE
    blank = own == BLANK
    # a run of one class starts a word, with the single space before it if there is one
    first = np.flatnonzero(~blank & (own != before))
    first -= (before[first] == BLANK) & (buf[first - 1] == 32)
    # a run of white space is a word but for its last sign; that goes with what follows if it is a space, else by itself
    run = np.flatnonzero(blank & (before != BLANK))
    stops = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stop = np.append(stops, len(buf))[np.searchsorted(stops, run)]
    edge = ends[np.searchsorted(ends, run, side="right")]
    last = stop >= edge
    stop = np.minimum(stop, edge)
    alone = ~last & (buf[stop - 1] != 32)
    starts = np.sort(np.concatenate([first, run[last | (stop - run > 1)], stop[alone] - 1]))
    return starts[np.append(True, starts[1:] != starts[:-1])]


def gathered(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The parts of these numbers one after the other; flat has all parts, of these sizes."""
    sizes = sizes.astype(np.int64)
    own = sizes[numbers]
    ends = np.cumsum(own)
    at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - (ends - own), own)
    at += np.arange(len(at))
    return flat[at]


def joined(parts: list[bytes], numbers: np.ndarray, counts: np.ndarray, width: int = 4) -> list[bytes]:
    """For each text, the parts of its words one after the other; a part has items of ``width`` bytes."""
    sizes = np.array([len(x) // width for x in parts], np.int64)
    data = memoryview(gathered(np.frombuffer(b"".join(parts), f"<u{width}"), sizes, numbers).tobytes())
    stops = np.append(0, np.cumsum(sizes[numbers]))[np.cumsum(np.append(0, counts))] * width
    return [bytes(data[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
