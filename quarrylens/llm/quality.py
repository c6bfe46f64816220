"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs of a labelled-good and a labelled-bad text train one weight per text feature by logistic
loss on the pair's feature differences. A document's latent score is its weighted feature sum; the cut is
the quantile of the training scores with the fewest errors, and scores are mapped so that this quantile
has the score 0.7.

The fit takes at most ``MAX_LABELS`` labelled rows (least hashes of their doc_ids; of texts that share a doc_id
the one of the least hash) and ``MAX_PAIRS`` pairs;
everything else covers all rows. Features come from the text alone.

Rows: null and empty texts have a score too (all ratios zero); labels that are null, neither 0 nor 1, or
without a doc_id teach nothing; without any pair of a good and a bad row, all documents score the labels'
mean, or 1 if there are no labels; repeated rows and ties get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import common

MAX_LABELS, MAX_PAIRS, SEED, PASS = 20_000, 200_000, 42, 0.7
#: Byte classes: letters and bytes of other scripts, upper case, digits, white space, sentence marks, other signs.
CLASS = np.full(256, 5, np.uint8)
CLASS[[*range(97, 123), *range(128, 256)]] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[[9, 10, 11, 12, 13, 32]] = 3
CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 4


def features(data: bytes) -> list[float]:
    words, lines = data.split(), data.split(b"\n")
    counts = np.zeros(6)
    for k in range(0, len(data), 1 << 22):
        counts += np.bincount(CLASS[np.frombuffer(data[k : k + (1 << 22)], np.uint8)], minlength=6)
    lower, upper, digits, _, marks, signs = counts.tolist()
    n, m = max(1, len(data)), max(1, len(words))
    ratios = [
        upper / max(1.0, lower + upper),
        digits / n,
        marks / m,
        signs / n,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        1 - len(set(words)) / m if words else 0.0,
        1 - len(set(lines)) / len(lines),
    ]
    return [*ratios, *(float(np.log(x + 0.01)) for x in ratios), float(np.log1p(n)), len(data) / m if words else 0.0, 1 / m]


#: Features of a text.
WIDTH = len(features(b""))


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking; without weights all texts have the same score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (self.latent(x) - self.cut) + np.log(PASS / (1 - PASS))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> Ranking:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        width = x.shape[1] if x.ndim == 2 else 0
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, float(label.mean()) if len(label) else 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -4, 4)
    rng = np.random.default_rng(SEED)
    pairs = min(MAX_PAIRS, len(good) * len(bad))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method on mean log(1 + exp(-d w)) + penalty |w|^2 / 2
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ p / pairs - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ordered, one = s[order], label[order]
    # errors if the k lowest are rejected, for each k that doesn't part equal scores
    errors = np.concatenate([[0], np.cumsum(one)]) + np.concatenate([np.cumsum((1 - one)[::-1])[::-1], [0]])
    edge = np.concatenate([[True], ordered[1:] > ordered[:-1], [True]])
    best = np.flatnonzero(edge & (errors == errors[edge].min()))
    k = int(best[len(best) // 2])
    cut = float(ordered[0] - 1e-9 if k == 0 else ordered[-1] + 1e-9 if k == len(s) else (ordered[k - 1] + ordered[k]) / 2)
    spread = float(np.std(s)) + 1e-9
    return Ranking(mean, scale, w, cut, 4 / spread)


def learnable(doc_id: str) -> Column:
    """False for the rows held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2


def _with_features(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` has the columns kept and __text."""
    schema = StructType([*(rows.schema[x] for x in kept), StructField("x", ArrayType(DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t or b"") for t in batch["__text"].cast(pa.large_binary()).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in kept), x], names=[*kept, "x"])

    return rows.mapInArrow(common.lean(each), schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labels: int = MAX_LABELS) -> Ranking:
    usable = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & learnable("__id"))
    chosen = usable.distinct().orderBy(F.xxhash64("__id"), "__label").limit(max_labels)
    labelled = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(chosen), "__id")
    # a labelled id has one row, however many documents bear it
    rows = labelled.groupBy("__id", "__label").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text")).select("__label", "__text")
    found = _with_features(rows, ["__label"]).toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, WIDTH)
    order = np.lexsort([*x.T, found["__label"].to_numpy()]) if found.num_rows else np.zeros(0, int)
    return fit(x[order], found["__label"].to_numpy().astype(int)[order])


def scored(docs: DataFrame, ranking: Ranking, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score, 0 to 1."""
    common.tune(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*(rows.schema[x] for x in keep), StructField("score", DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or b"") for t in batch["__text"].cast(pa.large_binary()).to_pylist()], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ranking.score(x) if len(x) else np.zeros(0), pa.float64())], names=schema.names)

    return rows.mapInArrow(common.lean(each), schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the cut."""
    found = scored(common.boxed(docs, "text"), train(docs, labels), keep=(common.ROW,))
    return common.unboxed(found.where(F.col("score") >= PASS), docs.columns)
