import zlib

import numpy as np
import pytest

from quarrylens.llm import quality, queries

from .cases import CLASHES, awkward, table, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for k in range(200):
        words = [str(x) for x in rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "of", "the"], 40)]
        good = k % 3 > 0
        docs.append((k, " ".join(words) + "." if good else " ".join(f"{w}$$$" for w in words), "en", "s", 1))
        labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    ranking = quality.train(table(spark, docs), spark.createDataFrame(labels, LABELS))
    scores = {r.doc_id: r.score for r in quality.scored(table(spark, docs), ranking).collect()}
    held = [(scores[d], q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all((s >= quality.PASS) == bool(q) for s, q in held)


def test_query_on_given_labels(spark, data):
    rows = {r.doc_id: r for r in queries.op3_quality(spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for k, r in rows.items())
    held = [rows[x.doc_id].predicted == x.quality for x in labels if rows[x.doc_id].held_out]
    assert sum(held) / len(held) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    lies = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    one, two = (quality.train(table(spark, docs), spark.createDataFrame(x, LABELS)) for x in (labels, lies))
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut


@pytest.mark.parametrize("labels, score", [([], 1.0), ([(0, 1, 0), (7, 1, 0)], 1.0), ([(0, 0, 0)], 0.0), ([(None, 1, 0), (0, None, 0), (0, 5, 0)], 1.0)])
def test_without_preference_pairs(spark, labels, score):
    ranking = quality.train(table(spark), spark.createDataFrame(labels, LABELS))
    assert {r.score for r in quality.scored(with_clashes(table(spark)), ranking).collect()} == {score}


def test_awkward_rows_and_empty_tables(spark):
    docs, labels = labelled(spark)
    frame = spark.createDataFrame(labels, LABELS)
    ranking = quality.train(table(spark, docs), frame)
    rows = quality.scored(with_clashes(table(spark)), ranking).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(table(spark, []), ranking).collect() == []
    kept = quality.accepted(with_clashes(table(spark, docs)), frame).collect()
    assert {r.doc_id for r in kept} == {d for d, q, _ in labels if q} and kept[0].score == CLASHES["score"]


def test_labels_are_bounded(spark):
    docs, labels = labelled(spark)
    ranking = quality.train(table(spark, docs), spark.createDataFrame(labels, LABELS), max_labels=40)
    assert ranking.constant is None


def test_fitted_rows_are_bounded_where_many_documents_share_an_id(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda x, label: fitted.append(len(label)))
    docs = table(spark, [(0, f"text {k}.", "", "", 0) for k in range(500)] + [(k, "other", "", "", 0) for k in range(1, 40)])
    quality.train(docs, spark.createDataFrame([(k % 40, k % 2, 0) for k in range(400)], LABELS), max_labels=20)
    quality.train(docs, spark.createDataFrame([(0, 1, 0)] * 9, LABELS))
    assert fitted[0] <= 20 and fitted[1] == 1


def test_fit_like_plain_gradient_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4))
    label = (x @ [1.5, -1.0, 0.0, 0.5] + rng.normal(size=240) > 0).astype(int)
    ranking = quality.fit(x, label)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -4, 4)
    pick = np.random.default_rng(quality.SEED)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = min(quality.MAX_PAIRS, len(good) * len(bad))
    d = z[pick.choice(good, pairs)] - z[pick.choice(bad, pairs)]
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (-(d.T @ (1 / (1 + np.exp(d @ w)))) / pairs + 1e-3 * w)
    assert np.allclose(ranking.weights, w, atol=1e-4)
    # no other cut between two scores has fewer errors
    s = np.sort(z @ ranking.weights)
    errors = lambda cut: int(((z @ ranking.weights >= cut) != label).sum())
    assert errors(ranking.cut) == min(map(errors, [s[0] - 1, *((s[1:] + s[:-1]) / 2), s[-1] + 1]))
    assert np.isclose(ranking.score(x[:1] * 0 + x.mean(axis=0))[0], 1 / (1 + np.exp(-(ranking.slope * (0 - ranking.cut) + np.log(0.7 / 0.3)))))


def test_an_empty_table_is_accepted(spark):
    docs, labels = labelled(spark)
    assert quality.accepted(with_clashes(table(spark, [])), spark.createDataFrame(labels, LABELS)).collect() == []
