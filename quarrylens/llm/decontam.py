"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items are put into one automaton per block of at most ``MAX_WORDS`` words;
documents stream through it word by word while the length of the longest match ending at each word is
tracked. A run of at least ``window`` matched words, or a whole item of fewer, is hit. A benchmark of more
words than one automaton may hold takes one pass over the documents for each block, so what is sent to the
executors stays bounded, and so is a worker's memory: the passes run one after the other, each written with what
it has found, and a worker keeps one automaton.

Rows: a null text has no words; repeated rows give a row each; an empty benchmark hits nothing; an empty
table gives an empty result. Items without an id still mark words but are not listed; an id that several
items share is listed once. Only ``keep`` is carried of further columns.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common

WINDOW = 10
#: Words in one automaton at most, but for a single longer item: some 100 MB in a worker.
MAX_WORDS = 200_000
#: A-Z lower-cased; all that is in no word is a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


class Automaton:
    """A generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.window = [-1], [0], window
        words = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.translate(NORMAL).split()]) for name, text in items]
        for _, sequence in words:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The state of the last ``window`` words of a state's longest string.
        self.at_window = [0] * len(self.next)
        for v in order:
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[self.link[v]] < window else self.at_window[self.link[v]]
        #: Items by the state and the length of what they have there: whole windows, or short items as a whole.
        self.items_of: dict[tuple[int, int], set[str | None]] = {}
        for name, sequence in words:
            v = 0
            for k, w in enumerate(sequence):
                v = self.next[v][w]
                if k + 1 >= window:
                    self.items_of.setdefault((self.at_window[v], window), set()).add(name)
            if 0 < len(sequence) < window:
                self.items_of.setdefault((v, len(sequence)), set()).add(name)
        own: dict[int, list[tuple[int, int]]] = {}
        for v, size in self.items_of:
            if size < window:
                own.setdefault(v, []).append((v, size))
        #: Short items that end where a state's strings end, its own and its suffixes', the longest first: fewer than ``window`` lengths, however many items.
        self.short: list[list[tuple[int, int]] | None] = [None] * len(self.next)
        for v in order:
            if found := [*sorted(own.get(v, ()), key=lambda x: -x[1]), *(self.short[self.link[v]] or ())]:
                self.short[v] = found

    def _new(self, length: int, link: int, follows: dict[int, int]) -> int:
        self.next.append(follows)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest string and w, made by a split where needed."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """The longest match, the hit runs of words (end exclusive, merged), the items with occurring windows."""
        follow, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        v = matched = longest = 0
        hits: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                v = matched = 0
                continue
            t = follow[v].get(w)
            if t is not None:
                matched += 1
            else:
                while v and t is None:
                    v = link[v]
                    t = follow[v].get(w)
                if t is None:
                    matched = 0
                    continue
                matched = length[v] + 1
            v = t
            if matched > longest:
                longest = matched
            run = 0
            if matched >= window:
                run = matched
                seen.add((self.at_window[v], window))
            if short[v]:
                for part in short[v]:
                    if part[1] <= matched:
                        run = max(run, part[1])
                        seen.add(part)
            if run:
                start = i + 1 - run
                while hits and hits[-1][1] >= start:
                    start = min(start, hits.pop()[0])
                hits.append((start, i + 1))
        return longest, hits, set().union(*(self.items_of.get(part, ()) for part in seen))


_kept: dict[str, Automaton] = {}


def _automaton(name: str, items, window: int) -> Automaton:
    """Of broadcast items; a worker keeps the last one it made."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = Automaton(items.value, window)
    return _kept[name]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, max_words: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size, fetched from Spark one after the other."""
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for name, words in benchmark.select(F.col(item_id).cast("string"), common.text_of(text)).toLocalIterator():
        raw = words.encode()
        count = len(raw.translate(NORMAL).split())
        if block and size + count > max_words:
            yield block
            block, size = [], 0
        block.append((name, raw))
        size += count
    yield block


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``keep`` and, by row: n_words, n_hit, longest (words), items (ids, sorted), word_spans (runs of hit words), spans (their code points), cleaned (the text without them)."""
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    state = [StructField("longest", LongType()), StructField("items", ArrayType(StringType())), StructField("word_spans", SPANS)]
    carried = StructType([*rows.schema.fields, *state])
    found = rows.select("*", F.lit(0).cast("long").alias("longest"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("word_spans"))

    def scan(name: str, items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, items, window)
        for batch in batches:
            longest, names, spans = [], [], []
            for t, most, known, runs in zip(batch["__text"].cast(pa.large_binary()).to_pylist(), batch["longest"].to_pylist(), batch["items"].to_pylist(), batch["word_spans"].to_pylist(), strict=True):
                length, hits, new = automaton.scan((t or b"").translate(NORMAL).split())
                longest.append(max(length, most))
                names.append(sorted({*known, *(new - {None})}))
                spans.append(merged([*((x["start"], x["end"]) for x in runs), *hits]) if hits else runs)
            columns = [batch.column(k) for k in range(batch.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(longest, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, SPAN)], names=carried.names)

    blocks = item_blocks(benchmark, item_id, item_text, max_words)
    last = next(blocks)
    for block in blocks:
        items, name = spark.sparkContext.broadcast(last), uuid.uuid4().hex
        found = common.stored(found.mapInArrow(common.lean(lambda batches, name=name, items=items: scan(name, items, batches)), carried), "matches")
        items.unpersist()
        last = block
    last_items, last_name = spark.sparkContext.broadcast(last), uuid.uuid4().hex

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(last_name, last_items, batches):
            counts, hit, places, cleaned = [], [], [], []
            for t, runs in zip(batch["__text"].to_pylist(), batch["word_spans"].to_pylist(), strict=True):
                raw = (t or "").encode().translate(NORMAL)
                counts.append(len(raw.split()))
                hit.append(sum(x["end"] - x["start"] for x in runs))
                at = cut_spans(t, raw, runs) if runs else []
                places.append([{"start": a, "end": b} for a, b in at])
                edges = [0, *(x for pair in at for x in pair), len(t or "")]
                cleaned.append("".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if at else t)
            columns = [batch.column(k) for k, name in enumerate(carried.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(places, SPAN), pa.array(cleaned, pa.string())], names=final.names)

    final = StructType([*(x for x in carried.fields if x.name != "__text"), StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", SPANS), StructField("cleaned", StringType())])
    return found.mapInArrow(common.lean(finish), final)


def merged(runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [{"start": a, "end": b} for a, b in out]


def cut_spans(text: str, raw: bytes, runs: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Code points from each run's first word to its last."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(raw)]
    out, done, chars = [], 0, 0
    for run in runs:
        a, b = at[run["start"]][0], at[run["end"] - 1][1]
        chars += len(data[done:a].decode())
        start = chars
        chars += len(data[a:b].decode())
        out.append((start, chars))
        done = b
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents without the hit spans; those hit on more than ``max_coverage`` of their words go. Untouched rows stay as they are."""
    found = contamination(common.boxed(docs, "text"), benchmark, window, keep=(common.ROW,))
    kept = found.where(F.col("n_hit") <= F.col("n_words") * max_coverage)
    hit, old = F.col("n_hit") > 0, lambda c: F.col(f"{common.ROW}.{c}")
    changed = {"text": F.when(hit, F.col("cleaned")).otherwise(old("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(old("n_chars"))
    return common.unboxed(kept, docs.columns, **changed)
