"""Grouping of spelling variants: words that differ by one sign, found with forward and backward word automata.

Of two words one error apart, all signs before the error and all after it are equal. The longer word's places are cut
in two halves; whichever has no error is equal in both, so each word is dealt out by the first half and by the last half it has
with words of its own length and of one more. A bucket's words that share first halves go into a minimal acyclic
automaton, those that share last halves into one of the words read backward; each word walks half of itself
exactly and goes on with one error in the other half. The automata number their words perfectly, and the numbers
index counts and best neighbours. The place of an error is told once (of equal signs in a row the first one goes
missing), so a pair is found once from each side and nothing has to be deduplicated by a shuffle.

A half that very many words share is refined: the places of the error are halved again, and what is equal grows,
until few enough words share it or a single place is left, which signs of the alphabet bound.

Rows: a null text has no words; a null doc_id counts as the empty text where typing errors are drawn; repeated rows count as often as
they come; an empty table gives an empty result; words of equal counts tie by code points. Further columns
of the documents are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words have so many signs and occurrences at least; a form is so many times as frequent as its variant.
LEAST_SIGNS, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many (document, run) draws loses a sign.
DRAW = 199
#: Rows that a bucket takes, and that may share a half before it is refined.
BUCKET_ROWS, GROUP_ROWS = 100_000, 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_SIGNS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, run): all maximal runs of letters with enough signs, A-Z lower-cased. Shorter ones never become longer."""
    found = F.regexp_extract_all(F.translate(common.text_of(text), UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))


def mistyped(doc_id: Column, run: Column) -> Column:
    """The run, or what is left of it without the sign that its hash in this document names."""
    drawn = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (drawn % F.length(run)).cast("int")
    return F.when(drawn % DRAW == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_signs: int = LEAST_SIGNS, least_count: int = LEAST_COUNT, **columns: str) -> DataFrame:
    """(word, n): the words and how often they occur."""
    words = runs(docs, least_signs, **columns).select(mistyped(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_signs).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted distinct words, which numbers them by their order."""

    def __init__(self, words: list[str]):
        #: Of each state, its edges: the next state, and how many words go before it there.
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.sizes: list[int] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # of each state on the last word's way: whether it is final, then its edges so far
        before = ""
        for word in words:
            k = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                k += 1
            self._settle(path, before, k, known)
            path += [[False] for _ in range(len(word) - k)]
            path[-1][0] = True
            before = word
        self._settle(path, before, 0, known)
        self.root = self._state(path[0], known)

    def _settle(self, path: list[list], word: str, depth: int, known: dict[tuple, int]) -> None:
        """The states of the last word beyond a depth get no more edges."""
        while len(path) > depth + 1:
            state = self._state(path.pop(), known)
            path[-1].append((word[len(path) - 1], state))

    def _state(self, node: list, known: dict[tuple, int]) -> int:
        key = tuple(node)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.edges)
            edges, size = {}, int(node[0])
            for sign, target in node[1:]:
                edges[sign] = target, size
                size += self.sizes[target]
            self.edges.append(edges)
            self.sizes.append(size)
            self.final.append(node[0])
        return state

    def walk(self, state: int, number: int, rest: str) -> tuple[int, int]:
        """The state and number that signs lead to; the state is -1 if they lead nowhere."""
        edges = self.edges
        for sign in rest:
            edge = edges[state].get(sign)
            if edge is None:
                return -1, 0
            state = edge[0]
            number += edge[1]
        return state, number

    def near(self, word: str, low: int, high: int, backward: bool) -> tuple[list[int], list[int]]:
        """The numbers of words with another sign at one of the places, and of words with none there.

        The word must be one of the automaton's. Of equal signs in a row, the one that comes first when read forward goes missing.
        """
        other: list[int] = []
        shorter: list[int] = []
        edges, final, walk = self.edges, self.final, self.walk
        state, number = walk(self.root, 0, word[:low])
        for k in range(low, high):
            sign, rest = word[k], word[k + 1 :]
            for c, (target, more) in edges[state].items():
                if c != sign:
                    end, found = walk(target, number + more, rest)
                    if end >= 0 and final[end]:
                        other.append(found)
            beside = k + 1 if backward else k - 1
            if not 0 <= beside < len(word) or word[beside] != sign:
                end, found = walk(state, number, rest)
                if end >= 0 and final[end]:
                    shorter.append(found)
            target, more = edges[state][sign]
            state, number = target, number + more
        return other, shorter


def dealt(words: DataFrame) -> DataFrame:
    """The rows by which words meet: (word, n, size, low, high), errors being at places low to high (exclusive) of the longer word, of ``size`` signs."""
    size = F.length("word")
    of = F.explode(F.array(*(F.struct((size + more).alias("size"), F.lit(last).alias("last")) for more in (0, 1) for last in (False, True)))).alias("at")
    rows = words.select("word", "n", of).select("word", "n", "at.size", "at.last")
    half = F.floor(F.col("size") / 2).cast("int")
    return rows.select("word", "n", "size", F.when(F.col("last"), half).otherwise(0).alias("low"), F.when(F.col("last"), F.col("size")).otherwise(half).alias("high"), (~F.col("last")).alias("backward"))


def shared_part() -> Column:
    """What the words of a group have in common: the signs before and after the places of the error."""
    after = F.col("size") - F.col("high")
    return F.concat_ws(":", "size", "low", "high", F.substring(F.col("word"), F.lit(1), F.col("low")), F.when(after > 0, F.substring(F.col("word"), F.length("word") - after + 1, after)).otherwise(""))


def refined(rows: DataFrame, most: int) -> DataFrame:
    """The rows with their key ``part``; groups of more than ``most`` rows halve the places of the error until they are small or one place is left."""
    rows, done = rows.withColumn("part", shared_part()), None
    while True:
        large = rows.groupBy("part").count().filter((F.col("count") > most) & (F.split("part", ":")[2].cast("int") - F.split("part", ":")[1].cast("int") > 1))
        large = common.stored(large.select("part"), "large")
        if large.isEmpty():
            return done.unionByName(rows) if done is not None else rows
        small = rows.join(large, "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("low").alias("from"), middle.alias("to")), F.struct(middle.alias("from"), F.col("high").alias("to")))).alias("cut")
        halved = rows.join(large, "part", "left_semi").select("word", "n", "size", "backward", halves).select("word", "n", "size", F.col("cut.from").alias("low"), F.col("cut.to").alias("high"), "backward")
        rows = common.stored(halved.withColumn("part", shared_part()), "halves")


def _searched(words: list[str], counts: list[int], sizes: list[int], lows: list[int], highs: list[int], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the best one's count, the best one) of a bucket's rows of one direction, for words that have any."""
    spelled = [w[::-1] for w in words] if backward else words
    count_of = dict(zip(spelled, counts, strict=True))
    order = sorted(count_of)
    automaton = Automaton(order)
    count = [count_of[w] for w in order]
    near = np.zeros(len(order), np.int64)
    best: list[tuple[int, str] | None] = [None] * len(order)
    plain = [w[::-1] for w in order] if backward else order
    number_of = {w: k for k, w in enumerate(order)}

    def met(own: int, other: int) -> None:
        near[own] += 1
        rank = (-count[other], plain[other])
        if best[own] is None or rank < best[own]:
            best[own] = rank

    for word, size, low, high in zip(spelled, sizes, lows, highs, strict=True):
        if len(word) == size:
            own = number_of[word]
            others, shorter = automaton.near(word, size - high, size - low, True) if backward else automaton.near(word, low, high, False)
            for other in others:
                met(own, other)
            for other in shorter:
                met(own, other)
                met(other, own)
    for k in np.flatnonzero(near).tolist():
        yield plain[k], int(near[k]), -best[k][0], best[k][1]


FOUND = "word string, n_near long, best_n long, best string"


def neighbours(words: DataFrame, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct) that have near words: how many, and the most frequent one."""
    spark = words.sparkSession
    common.tune(spark)
    rows = refined(dealt(words), group_rows)
    buckets = max(common.partitions(spark), -(-4 * words.count() // bucket_rows))
    bucketed = rows.select(F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket"), "word", "n", "size", "low", "high", "backward")

    def search(_key: tuple, table: pa.Table) -> pa.Table:
        found: list[tuple[str, int, int, str]] = []
        for backward in (False, True):
            part = table.filter(pc.equal(table["backward"], backward))
            found += _searched(*(part[c].to_pylist() for c in ("word", "n", "size", "low", "high")), backward)
        return pa.table({name: pa.array([x[k] for x in found], kind) for k, (name, kind) in enumerate((("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())))})

    # the least text is first of equal counts
    first = F.min(F.struct((-F.col("best_n")).alias("best_n"), F.col("best"))).alias("first")
    found = bucketed.groupBy("bucket").applyInArrow(common.lean_group(search), FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.best_n")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each step is to a far more frequent word, so ways are short."""
    reached = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = common.stored(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS, times: int = TIMES, **columns: str) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = common.stored(vocabulary(docs, **columns), "words")
    found = words.join(neighbours(words, group_rows, bucket_rows), "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    found = common.stored(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "variants")
    ends = roots(found.filter(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
