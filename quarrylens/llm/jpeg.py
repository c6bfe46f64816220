"""Progressive JPEG media columns.

Files have three components at 4:2:0. Scans come by spectral selection (DC, AC 1-5, AC 6-63) and successive
approximation (one bit later), with a restart interval of one unit, so that all units of a batch of files
decode in step: each round of numpy operations takes one symbol of every unit. Scans accumulate into
coefficient arrays; those are inverse-transformed in exact integer arithmetic, chroma is upsampled, and the
result is a full-resolution RGB tensor.

Bytes are stored without loss as quantised coefficients (byte minus 128, a block for 64 bytes, all
quantisation steps 1); a comment segment has the unpadded length.

Rows: a null text is an empty one; equal texts give equal files; repeated rows give a row each; an empty
table gives an empty result; a binary that is no such file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import common

#: Units that are coded in step at once, and payload bytes of a batch of files.
STEP, BATCH = 1 << 14, 1 << 20
BANDS = ((1, 5), (6, 63))
#: Zigzag order by rule: along anti-diagonals, turning at each.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Blocks in an MCU: four of luma, one of each chroma; and their components.
UNIT, LUMA = 6, 4


# ---- Huffman codes

#: Symbols by code length; frequent AC symbols are short. All other run and size pairs have nine bits.
DC_LENGTHS = {4: list(range(12))}
AC_LENGTHS = {4: [0, *range(1, 9)], 9: [9, 10, 0xF0, *(r << 4 | s for r in range(1, 16) for s in range(1, 11))]}


def table_segment(lengths: dict[int, list[int]], kind: int) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return bytes([kind]) + counts + bytes(s for n in sorted(lengths) for s in lengths[n])


def codes(segment: bytes) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a table's counts and symbols."""
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(segment[length - 1]):
            yield segment[at], code, length
            code, at = code + 1, at + 1
        code <<= 1


@lru_cache(maxsize=64)
def lookup(segment: bytes) -> np.ndarray:
    """For each 16 bits: symbol << 8 | length of the code they start with; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(segment):
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return out


def _code_arrays(lengths: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for symbol, c, n in codes(table_segment(lengths, 0)[1:]):
        code[symbol], size[symbol] = c, n
    return code, size


DC_CODE, DC_SIZE = _code_arrays(DC_LENGTHS)
AC_CODE, AC_SIZE = _code_arrays(AC_LENGTHS)
#: Bits in a magnitude.
MAGNITUDE = np.array([int(x).bit_length() for x in range(4096)], np.uint64)


# ---- encoding


class Bits:
    """Bit strings of many units, appended to in step."""

    def __init__(self, units: int, words: int = 44):
        self.acc, self.held = np.zeros(units, np.uint64), np.zeros(units, np.uint64)
        self.out, self.at = np.zeros((units, words), ">u4"), np.zeros(units, np.int64)

    def put(self, bits: np.ndarray, count: np.ndarray) -> None:
        """Appends ``count`` (32 at most, 0 for none) bits to each unit."""
        self.acc = (self.acc << count) | bits
        self.held = self.held + count
        full = np.flatnonzero(self.held >= 32)
        if len(full):
            left = self.held[full] - np.uint64(32)
            self.out[full, self.at[full]] = (self.acc[full] >> left) & np.uint64(0xFFFFFFFF)
            self.at[full] += 1
            self.held[full] = left
            self.acc[full] &= (np.uint64(1) << left) - np.uint64(1)

    def put_at(self, where: np.ndarray, bits: np.ndarray, count: np.ndarray) -> None:
        """The same for some units, and up to 63 bits."""
        for part in (1, 0):
            n = np.zeros(len(self.acc), np.uint64)
            b = np.zeros(len(self.acc), np.uint64)
            low = np.minimum(count, np.uint64(32))
            n[where] = count - low if part else low
            b[where] = bits >> low if part else bits & ((np.uint64(1) << low) - np.uint64(1))
            self.put(b & ((np.uint64(1) << n) - np.uint64(1)), n)

    def segments(self, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All units' bytes, filled up with ones, stuffed, and followed by the restart marker (-1: none); and each one's size."""
        fill = (np.uint64(8) - self.held % np.uint64(8)) % np.uint64(8)
        self.put((np.uint64(1) << fill) - np.uint64(1), fill)
        rest = np.flatnonzero(self.held)
        self.out[rest, self.at[rest]] = self.acc[rest] << (np.uint64(32) - self.held[rest])
        size = self.at * 4 + (self.held // np.uint64(8)).astype(np.int64)
        raw = np.zeros((len(size), int(size.max(initial=0)) + 2), np.uint8)
        data = self.out.view(np.uint8).reshape(len(size), -1)[:, : raw.shape[1]]
        raw[:, : data.shape[1]] = data
        marked = np.flatnonzero(marker >= 0)
        raw[marked, size[marked]], raw[marked, size[marked] + 1] = 0xFF, 0xD0 + marker[marked]
        column = np.arange(raw.shape[1])
        used = column < (size + 2 * (marker >= 0))[:, None]
        stuffed = (raw == 0xFF) & (column < size[:, None])
        width = (used * (1 + stuffed)).sum(axis=1)
        flat, twice = raw[used], stuffed[used]
        place = np.arange(len(flat)) + np.cumsum(twice) - twice
        out = np.zeros(len(flat) + int(twice.sum()), np.uint8)
        out[place] = flat
        return out, width


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v, v + (np.int64(1) << size.astype(np.int64)) - 1).astype(np.uint64)


def _dc_first(c: np.ndarray, al: int) -> Bits:
    """c: (units, UNIT) DC values."""
    bits, v = Bits(len(c)), c.astype(np.int64) >> al
    before = np.concatenate([np.zeros((len(c), 1), np.int64), v[:, :3], np.zeros((len(c), 2), np.int64)], axis=1)
    for k in range(UNIT):
        d = v[:, k] - before[:, k]
        size = MAGNITUDE[np.abs(d)]
        bits.put((DC_CODE[size.astype(int)] << size) | _signed_bits(d, size), DC_SIZE[size.astype(int)] + size)
    return bits


def _dc_refine(c: np.ndarray, al: int) -> Bits:
    bits, one = Bits(len(c)), np.ones(len(c), np.uint64)
    for k in range(UNIT):
        bits.put(((c[:, k].astype(np.int64) >> al) & 1).astype(np.uint64), one)
    return bits


def _zero_runs(bits: Bits, run: np.ndarray, where: np.ndarray) -> None:
    while len(long := where[run[where] > 15]):
        n = np.zeros(len(run), np.uint64)
        n[long] = AC_SIZE[0xF0]
        bits.put(np.where(n > 0, AC_CODE[0xF0], np.uint64(0)), n)
        run[long] -= 16


def _ac_first(c: np.ndarray, band: tuple[int, int], al: int) -> Bits:
    """c: (units, 64) coefficients."""
    bits, run = Bits(len(c)), np.zeros(len(c), np.int64)
    for k in range(band[0], band[1] + 1):
        own = c[:, k].astype(np.int64)
        v = np.sign(own) * (np.abs(own) >> al)
        there = v != 0
        _zero_runs(bits, run, np.flatnonzero(there & (run > 15)))
        size = MAGNITUDE[np.abs(v)]
        symbol = np.minimum(run, 15) << 4 | size.astype(np.int64)
        bits.put(np.where(there, (AC_CODE[symbol] << size) | _signed_bits(v, size), np.uint64(0)), np.where(there, AC_SIZE[symbol] + size, np.uint64(0)))
        run = np.where(there, 0, run + 1)
    bits.put(np.where(run > 0, AC_CODE[0], np.uint64(0)), np.where(run > 0, AC_SIZE[0], np.uint64(0)))
    return bits


def _ac_refine(c: np.ndarray, band: tuple[int, int], al: int) -> Bits:
    bits, run = Bits(len(c)), np.zeros(len(c), np.int64)
    later, count = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
    for k in range(band[0], band[1] + 1):
        own = c[:, k].astype(np.int64)
        v = np.abs(own) >> al
        old, new = v > 1, np.flatnonzero(v == 1)
        while len(long := np.flatnonzero((v != 0) & (run > 15))):
            bits.put_at(long, np.full(len(long), AC_CODE[0xF0]), np.full(len(long), AC_SIZE[0xF0]))
            bits.put_at(long, later[long], count[long])
            later[long], count[long] = 0, 0
            run[long] -= 16
        later = np.where(old, later << np.uint64(1) | (v & 1).astype(np.uint64), later)
        count = count + old
        if len(new):
            symbol = run[new] << 4 | 1
            bits.put_at(new, AC_CODE[symbol] << np.uint64(1) | (own[new] > 0).astype(np.uint64), AC_SIZE[symbol] + np.uint64(1))
            bits.put_at(new, later[new], count[new])
            later[new], count[new] = 0, 0
        run = np.where(v == 0, run + 1, np.where(old, run, 0))
    end = np.flatnonzero((run > 0) | (count > 0))
    bits.put_at(end, np.full(len(end), AC_CODE[0]), np.full(len(end), AC_SIZE[0]))
    bits.put_at(end, later[end], count[end])
    return bits


class Layout:
    """Where the blocks of one file are: its MCUs in raster order have UNIT blocks each."""

    def __init__(self, width: int, height: int):
        wide, high = -(-width // 16), -(-height // 16)
        self.wide, self.high, self.blocks = wide, high, wide * high * UNIT
        mcu = np.arange(wide * high).reshape(high, wide)
        two = np.arange(4).reshape(2, 2)
        luma = mcu[:, None, :, None] * UNIT + two[None, :, None, :]
        self.luma = luma.reshape(2 * high, 2 * wide)
        # a component's own scans leave out luma blocks that only fill up the last MCUs
        self.order = [self.luma[: -(-height // 8), : -(-width // 8)].reshape(-1), mcu.reshape(-1) * UNIT + LUMA, mcu.reshape(-1) * UNIT + LUMA + 1]


@lru_cache(maxsize=4096)
def layout(width: int, height: int) -> Layout:
    return Layout(width, height)


#: (components, first and last coefficient, bit above, bit) of each scan, in file order.
SCANS = [((0, 1, 2), (0, 0), 0, 1), *(((c,), band, 0, 1) for c in range(3) for band in BANDS), ((0, 1, 2), (0, 0), 1, 0), *(((c,), (1, 63), 1, 0) for c in range(3))]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = _segment(0xC4, table_segment(DC_LENGTHS, 0x00) + table_segment(AC_LENGTHS, 0x10))
RESTART = _segment(0xDD, b"\0\1")


def _scan_header(scan) -> bytes:
    comps, (first, last), ah, al = scan
    return _segment(0xDA, bytes([len(comps), *(x for c in comps for x in (c + 1, 0)), first, last, ah << 4 | al]))


def encode_batch(images: list[tuple[Layout, np.ndarray, int, int, np.ndarray, bytes]]) -> list[bytes]:
    """Files of (layout, coefficients (blocks, 64) in zigzag order, width, height, quantisation (64), comment)."""
    begins = np.cumsum([0, *(x[0].blocks for x in images)])
    c = np.concatenate([x[1] for x in images])
    files = [[b"\xff\xd8", _segment(0xFE, x[5]), _segment(0xDB, b"\0" + bytes(x[4].astype(np.uint8))), _segment(0xC2, struct.pack(">BHHB", 8, x[3], x[2], 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), TABLES, RESTART] for x in images]
    for scan in SCANS:
        comps, band, ah, al = scan
        if len(comps) > 1:
            units = [x[0].blocks // UNIT for x in images]
            rows = c[:, 0].reshape(-1, UNIT)
        else:
            units = [len(x[0].order[comps[0]]) for x in images]
            rows = c[np.concatenate([a + x[0].order[comps[0]] for a, x in zip(begins[:-1], images, strict=True)])]
        number = np.concatenate([np.append(np.arange(n - 1) % 8, -1) for n in units])
        parts, sizes = [], []
        for k in range(0, len(rows), STEP):
            part = rows[k : k + STEP]
            bits = (_dc_refine(part, al) if ah else _dc_first(part, al)) if len(comps) > 1 else (_ac_refine if ah else _ac_first)(part, band, al)
            data, size = bits.segments(number[k : k + STEP])
            parts.append(data)
            sizes.append(size)
        data = b"".join(x.tobytes() for x in parts)
        ends = np.append(0, np.cumsum(np.concatenate(sizes)))[np.cumsum([0, *units])].tolist()
        header = _scan_header(scan)
        for file, a, b in zip(files, ends[:-1], ends[1:], strict=True):
            file += [header, data[a:b]]
    return [b"".join([*x, b"\xff\xd9"]) for x in files]


# ---- decoding


class Parsed:
    """A file's segments; scans: (components, band, bit above, bit, tables, start and end of its data)."""

    def __init__(self, data: bytes, at: int):
        buf = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero(buf[:-1] == 0xFF)
        follow = buf[marks + 1]
        plain = (follow != 0) & (follow != 0xFF) & ((follow < 0xD0) | (follow > 0xD7))
        scan_ends = marks[plain].tolist()
        self.at, self.scans, self.comment, self.quant = at, [], b"", np.ones(64, np.int64)
        tables: dict[int, bytes] = {}
        p, nxt = 2, 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while p < len(data):
            marker, size = data[p + 1], int.from_bytes(data[p + 2 : p + 4])
            if marker == 0xD9:
                break
            body = data[p + 4 : p + 2 + size]
            p += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self.quant = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
            elif marker == 0xC2:
                _, self.height, self.width, _ = struct.unpack(">BHHB", body[:6])
                if body[6:] != bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]):
                    raise ValueError("only three components at 4:2:0 are read")
                self.layout = layout(self.width, self.height)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    count = sum(body[k + 1 : k + 17])
                    tables[body[k]] = body[k + 1 : k + 17 + count]
                    k += 17 + count
            elif marker == 0xDA:
                n = body[0]
                comps = tuple(body[1 + 2 * k] - 1 for k in range(n))
                first, last, bits = body[1 + 2 * n : 4 + 2 * n]
                while scan_ends[nxt] < p:
                    nxt += 1
                self.scans.append((comps, (first, last), bits >> 4, bits & 15, tables[0x10 if first else 0], p, scan_ends[nxt]))
                p = scan_ends[nxt]


class Reader:
    """Bits of many segments, read in step."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.at = words, starts * 8

    def peek(self) -> np.ndarray:
        """The next bits, first in the top of 32; 25 of them hold."""
        return (self.words[self.at >> 3] << (self.at & 7)) & 0xFFFFFFFF


def _extended(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    half = np.int64(1) << np.maximum(size - 1, 0)
    return np.where(size == 0, 0, np.where(v >= half, v, v - 2 * half + 1))


def _read_value(peek: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    return ((peek << used) & 0xFFFFFFFF) >> (32 - size)


def _read_dc_first(read: Reader, table: np.ndarray, out: np.ndarray, units: np.ndarray, al: int) -> None:
    before = np.zeros(len(units), np.int64)
    for k in range(UNIT):
        peek = read.peek()
        entry = table[peek >> 16]
        used, size = (entry & 255).astype(np.int64), (entry >> 8).astype(np.int64)
        value = (before if 0 < k < LUMA else 0) + _extended(_read_value(peek, used, size), size)
        read.at += used + size
        before = value
        out[units * UNIT + k, 0] = value << al


def _read_dc_refine(read: Reader, out: np.ndarray, units: np.ndarray, al: int) -> None:
    for k in range(UNIT):
        out[units * UNIT + k, 0] |= ((read.peek() >> 31) << al).astype(out.dtype)
        read.at += 1


def _read_ac_first(read: Reader, table: np.ndarray, out: np.ndarray, blocks: np.ndarray, band: tuple[int, int], al: int) -> None:
    flat, base = out.reshape(-1), blocks * 64
    k = np.full(len(blocks), band[0])
    words, at = read.words, read.at
    while True:
        peek = (words[at >> 3] << (at & 7)) & 0xFFFFFFFF
        entry = table[peek >> 16]
        used, symbol = (entry & 255).astype(np.int64), (entry >> 8).astype(np.int64)
        size, run = symbol & 15, symbol >> 4
        k = k + run
        value = _extended(_read_value(peek, used, size), size)
        there = np.flatnonzero(size > 0)
        flat[base[there] + k[there]] = np.sign(value[there]) * (np.abs(value[there]) << al)
        at = at + used + size
        k = np.where(symbol == 0, 64, k + 1)
        on = np.flatnonzero(k <= band[1])
        if not len(on):
            return
        if len(on) < len(k):
            k, base, at = k[on], base[on], at[on]


def _read_ac_refine(read: Reader, table: np.ndarray, out: np.ndarray, blocks: np.ndarray, band: tuple[int, int], al: int) -> None:
    """Units that end at once, having only bits of known coefficients, take a short way; the others go coefficient by coefficient."""
    bit = 1 << al
    old = out[blocks, band[0] : band[1] + 1].astype(np.int64)
    known = old != 0
    entry = table[read.peek() >> 16]
    at_once = (entry >> 8) == 0
    quick = np.flatnonzero(at_once)
    rank = np.cumsum(known[quick], axis=1) - 1
    place = (read.at[quick] + (entry[quick] & 255))[:, None] + rank
    got = (read.words[place >> 3] >> (31 - (place & 7))) & 1
    own = old[quick]
    out[blocks[quick], band[0] : band[1] + 1] = np.where(known[quick], own + np.sign(own) * got * bit, own)
    for j in np.flatnonzero(~at_once).tolist():
        _refine_one(read, table, out[blocks[j]], int(read.at[j]), band, bit)


def _refine_one(read: Reader, table: np.ndarray, c: np.ndarray, at: int, band: tuple[int, int], bit: int) -> None:
    def peek() -> int:
        return (int(read.words[at >> 3]) << (at & 7)) & 0xFFFFFFFF

    k, last = band
    while k <= last:
        entry = int(table[peek() >> 16])
        at += entry & 255
        run, size = entry >> 12, entry >> 8 & 15
        new = 0
        if size:
            new = bit if peek() >> 31 else -bit
            at += 1
        elif run < 15:
            run = 64  # the end of this block
        while k <= last:
            if c[k]:
                if peek() >> 31:
                    c[k] += bit if c[k] > 0 else -bit
                at += 1
            elif run == 0:
                c[k] = new
                k += 1
                break
            else:
                run -= 1
            k += 1


def decode_batch(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Each file and its coefficients (blocks, 64) in zigzag order."""
    at = np.cumsum([0, *map(len, files)])
    parsed = [Parsed(x, int(a)) for x, a in zip(files, at[:-1], strict=True)]
    buf = np.frombuffer(b"".join([*files, bytes(8)]), np.uint8)
    marks = np.flatnonzero(buf[:-1] == 0xFF)
    follow = buf[marks + 1]
    keep = np.ones(len(buf), bool)
    keep[marks[follow == 0] + 1] = False
    restarts = marks[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[restarts] = keep[restarts + 1] = False
    plain = np.concatenate([buf[keep], np.zeros(8, np.uint8)]).astype(np.int64)
    words = plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]
    moved = np.cumsum(keep) - keep
    begins = np.cumsum([0, *(x.layout.blocks for x in parsed)])
    out = np.zeros((int(begins[-1]), 64), np.int16)
    groups: dict[tuple, list[tuple[int, int, int]]] = {}
    for i, p in enumerate(parsed):
        for n, (comps, band, ah, al, table, a, b) in enumerate(p.scans):
            groups.setdefault((n, comps, band, ah, al, table), []).append((i, p.at + a, p.at + b))
    for (_, comps, band, ah, al, table), members in sorted(groups.items(), key=lambda x: x[0][0]):
        lows = np.searchsorted(restarts, [a for _, a, _ in members])
        highs = np.searchsorted(restarts, [b for _, _, b in members])
        starts = np.concatenate([np.append(a, restarts[x:y] + 2) for (_, a, _), x, y in zip(members, lows.tolist(), highs.tolist(), strict=True)])
        starts = moved[starts]
        if len(comps) > 1:
            units = np.concatenate([np.arange(begins[i] // UNIT, begins[i + 1] // UNIT) for i, _, _ in members])
        else:
            units = np.concatenate([begins[i] + parsed[i].layout.order[comps[0]] for i, _, _ in members])
        if len(units) != len(starts):
            raise ValueError("a restart interval other than one unit, or a damaged scan")
        for k in range(0, len(units), STEP):
            read, own, codes_ = Reader(words, starts[k : k + STEP]), units[k : k + STEP], lookup(table)
            if len(comps) > 1:
                _read_dc_refine(read, out, own, al) if ah else _read_dc_first(read, codes_, out, own, al)
            else:
                (_read_ac_refine if ah else _read_ac_first)(read, codes_, out, own, band, al)
    return [(p, out[a:b]) for p, a, b in zip(parsed, begins[:-1], begins[1:], strict=True)]


# ---- samples

#: The inverse cosine transform's basis (coefficient, sample), in units of 2^-13; sums of its products are exact in doubles.
BASIS = np.round(8192 * np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))


def samples(c: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples, 0 to 255, of (blocks, 64) coefficients in zigzag order."""
    square = np.zeros((len(c), 64))
    square[:, ZIGZAG] = c * quant
    rows = np.rint(square.reshape(-1, 8, 8)) @ BASIS
    both = np.swapaxes(np.swapaxes(rows, 1, 2).reshape(-1, 8) @ BASIS, 0, 1).T.reshape(-1, 8, 8)
    return np.clip(np.floor(np.swapaxes(both, 1, 2) / 2.0**26 + 0.5) + 128, 0, 255).astype(np.int32)


def units_rgb(c: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(MCUs, 16, 16, 3) of the coefficients of whole MCUs, chroma upsampled."""
    s = samples(c, quant).reshape(-1, UNIT, 8, 8)
    luma = s[:, :LUMA].reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, 16, 16)
    cb, cr = (np.repeat(np.repeat(s[:, LUMA + k] - 128, 2, axis=1), 2, axis=2) for k in (0, 1))
    # the JFIF conversion, in units of 2^-16
    red = luma + (91881 * cr + 32768 >> 16)
    green = luma - (22554 * cb + 46802 * cr + 32768 >> 16)
    blue = luma + (116130 * cb + 32768 >> 16)
    return np.clip(np.stack([red, green, blue], axis=-1), 0, 255).astype(np.uint8)


def rgb(parsed: Parsed, c: np.ndarray) -> np.ndarray:
    """The (height, width, 3) tensor."""
    at = parsed.layout
    units = np.empty((at.high * at.wide, 16, 16, 3), np.uint8)
    for k in range(0, len(units), 1024):
        units[k : k + 1024] = units_rgb(c[k * UNIT : (k + 1024) * UNIT], parsed.quant)
    units = units.reshape(at.high, at.wide, 16, 16, 3)
    return units.swapaxes(1, 2).reshape(at.high * 16, at.wide * 16, 3)[: parsed.height, : parsed.width]


def image_file(pixels: np.ndarray, quant: np.ndarray) -> bytes:
    """A file of a (height, width, 3) image, for lossy use."""
    height, width = pixels.shape[:2]
    at = layout(width, height)
    p = np.pad(pixels, ((0, at.high * 16 - height), (0, at.wide * 16 - width), (0, 0)), mode="edge").astype(float)
    y = p @ [0.299, 0.587, 0.114]
    planes = [y, *((p[:, :, k] - y) / d for k, d in ((2, 1.772), (0, 1.402)))]
    c = np.zeros((at.blocks, 64))
    for k, plane in enumerate(planes):
        if k:
            plane = plane.reshape(at.high * 8, 2, at.wide * 8, 2).mean(axis=(1, 3))
        else:
            plane = plane - 128
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        square = (BASIS / 8192) @ blocks @ (BASIS / 8192).T
        c[at.order[k] if k else at.luma.reshape(-1)] = square.reshape(-1, 64)[:, ZIGZAG]
    return encode_batch([(at, np.rint(c / quant).astype(np.int16), width, height, quant, b"")])[0]


# ---- payloads and columns


def payload_image(data: bytes):
    length = max(64, -(-len(data) // 64) * 64)
    blocks = length // 64
    mcus = -(-blocks // UNIT)
    wide = -(-mcus // 4095)
    at = layout(16 * wide, 16 * -(-mcus // wide))
    c = np.zeros((at.blocks, 64), np.int16)
    c[:blocks] = np.frombuffer(data + bytes(length - len(data)), np.uint8).reshape(blocks, 64).astype(np.int16) - 128
    return at, c, at.wide * 16, at.high * 16, np.ones(64, np.int64), struct.pack(">Q", len(data))


def payload_of(parsed: Parsed, c: np.ndarray) -> tuple[int, bytes]:
    """The unpadded length and the padded bytes."""
    (size,) = struct.unpack(">Q", parsed.comment)
    blocks = max(1, -(-size // 64))
    return size, (c[:blocks] + 128).astype(np.uint8).tobytes()


def grouped(values: list[bytes], limit: int = BATCH) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for v in values:
        if held and size + len(v) > limit:
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v)
    if held:
        yield held


def to_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and media: each text's bytes in a file."""
    common.tune(docs.sparkSession)
    rows = docs.select(*keep, common.text_of(text).alias("__text"))
    schema = StructType([*(rows.schema[x] for x in keep), StructField("media", BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in grouped(batch["__text"].cast(pa.large_binary()).to_pylist()):
                files = encode_batch([payload_image(x) for x in part])
                yield pa.RecordBatch.from_arrays([*(x.slice(done, len(part)) for x in batch.columns[:-1]), pa.array(files, pa.binary())], names=schema.names)
                done += len(part)

    return rows.mapInArrow(common.lean(each), schema)


def from_media(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), tensors: bool = False) -> DataFrame:
    """``keep``, n_bytes, payload (padded), tail_crc32, media_bytes, media_sha256, feature, the RGB tensor's width, height and rgb_sha256, and, if asked for, rgb itself.

    The feature has the tensor's size and the sums of its channels.
    """
    chosen = rows.select(*keep, media)
    more = [StructField("n_bytes", LongType()), StructField("payload", BinaryType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("width", LongType()), StructField("height", LongType()), StructField("rgb_sha256", StringType())]
    more += [StructField("rgb", BinaryType())] if tensors else []
    schema = StructType([*(chosen.schema[x] for x in keep), *more])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in grouped(batch.column(batch.num_columns - 1).to_pylist(), 2 * BATCH):
                out = []
                for file, (parsed, c) in zip(part, decode_batch(part), strict=True):
                    size, payload = payload_of(parsed, c)
                    tensor = rgb(parsed, c)
                    sums = tensor.sum(axis=(0, 1), dtype=np.int64).tolist()
                    feature = ":".join(map(str, (f"{parsed.width}x{parsed.height}", *sums)))
                    row = [size, payload, zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, parsed.width, parsed.height, hashlib.sha256(tensor.tobytes()).hexdigest()]
                    out.append(row + ([tensor.tobytes()] if tensors else []))
                columns = [pa.array(x, y) for x, y in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)]
                yield pa.RecordBatch.from_arrays([*(x.slice(done, len(part)) for x in batch.columns[:-1]), *columns], names=schema.names)
                done += len(part)

    return chosen.mapInArrow(common.lean(each), schema)


def store_tensors(rows: DataFrame, path: str, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Writes ``keep``, width, height and rgb (height x width x 3 bytes) of files to ``path``, and reads them back."""
    found = from_media(rows, media, keep, tensors=True).select(*keep, "width", "height", "rgb")
    found.write.parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)
