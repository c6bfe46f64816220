"""The kept verdicts against a plain fold of the log."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.streaming import verdicts

from .conftest import rows

START = datetime.datetime(2024, 1, 1)
KEEP = 50


def log(seed, count=200):
    rng = random.Random(seed)
    out = []
    at = 0
    for k in range(count):
        at += rng.randint(0, 4)
        out.append((f"f{rng.randrange(12)}", rng.choice(["x", "y", None]), rng.choice(["confirmed", "dismissed"]), "1:a" if k < count // 2 else "2:a", START + datetime.timedelta(seconds=at), k))
    return out


def folded(entries):
    state = {}
    for finding, fingerprint, verdict, version, at, _ in sorted(entries, key=lambda x: (x[4], x[5])):
        us = int((at - START).total_seconds()) * 1_000_000
        last = state.get(finding)
        if last is None or last[3] + KEEP * 1_000_000 <= us:
            state[finding] = (version, fingerprint, verdict, us, 1, 0, 0)
        else:
            state[finding] = (version, fingerprint, verdict, us, last[4] + 1, last[5] + (fingerprint is not None and last[:2] == (version, fingerprint)), last[6] + (version != last[0]))
    last = max(x[3] for x in state.values())
    return {k: v for k, v in state.items() if v[3] + KEEP * 1_000_000 > last}


def found(df):
    base = int(START.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)
    return {r.finding_id: (r.version, r.fingerprint, r.verdict, r.at - base, r.seen, r.hits, r.stale) for r in df.collect()}


@pytest.mark.parametrize("cuts", [[], [40, 100, 160]])
def test_batches_and_restarts_change_nothing(spark, tmp_path, cuts):
    entries = log(1)
    entries.insert(0, ("last of all", "z", "confirmed", "1:a", START, -1))  # ends
    parts = [entries[a:b] for a, b in zip([0, *cuts], [*cuts, len(entries)], strict=True)]
    place, checkpoint, told = (str(tmp_path / n) for n in ("log", "checkpoint", "told"))
    for part in parts:
        verdicts.append(spark.createDataFrame(part, verdicts.LOG), place)
        verdicts.advance(spark, place, checkpoint, KEEP, updates=told)  # each from the checkpoint of the one before
    state = verdicts.kept(spark, checkpoint)
    expected = folded(entries)
    assert found(verdicts.usable(state, "2:a", KEEP).drop("valid")) == expected
    assert {r.finding_id for r in verdicts.usable(state, "2:a", KEEP).where("valid").collect()} == {k for k, v in expected.items() if v[0] == "2:a"}
    assert "last of all" not in found(state)  # its timer removed it
    updates = spark.read.parquet(told)
    assert updates.agg(F.sum("n")).head()[0] == len(entries)
    assert updates.where("ended AND finding_id = 'last of all'").count() == 1
    if cuts:  # a batch tells of its own keys only
        assert updates.where("n > 0").count() == sum(len({e[0] for e in p}) for p in parts)


def test_nothing_new_changes_nothing(spark, tmp_path):
    place, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    verdicts.append(spark.createDataFrame([*log(2, 30), (None, "x", "confirmed", "1:a", START, 0), ("g", "x", None, "1:a", START, 0)], verdicts.LOG), place)
    verdicts.advance(spark, place, checkpoint, KEEP)
    before = rows(verdicts.kept(spark, checkpoint))
    verdicts.advance(spark, place, checkpoint, KEEP)
    assert rows(verdicts.kept(spark, checkpoint)) == before and all(r[0] not in (None, "g") for r in before)


def test_version_stamp(spark):
    df = spark.createDataFrame([("1", "abc", None), ("1", "abc", " \n"), ("2", "abc", "be strict")], "s string, e string, r string")
    import hashlib

    got = [r[0] for r in df.select(verdicts.version_stamp(F.col("s"), F.col("e"), F.col("r"))).collect()]
    assert got == ["1:abc", "1:abc", "2:abc:rules-" + hashlib.sha256(b"be strict").hexdigest()[:16]]


def test_a_state_keeps_one_timer_and_tells_only_if_asked():
    import pandas as pd

    class Handle:
        """Of one key; anything else that is asked of it raises."""

        timers, value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.append(at)

    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    def batch(*us):
        return iter([pd.DataFrame({"us": us, "ord": range(len(us)), "fingerprint": "x", "verdict": "confirmed", "version": "1:a"})])

    keeper, handle = verdicts.Keeper(50_000, told=False), Handle()
    keeper.init(handle)
    assert list(keeper.handleInputRows(("f",), batch(20_000, 10_000), None)) == [] and handle.timers == [71]
    assert list(keeper.handleInputRows(("f",), batch(60_000), None)) == [] and handle.timers == [71]
    assert list(keeper.handleExpiredTimer(("f",), Watermark(100), None)) == [] and handle.timers == [71, 111] and handle.value[3:6] == (60_000, 3, 2)
    keeper.told = True
    assert list(keeper.handleExpiredTimer(("f",), Watermark(120), None))[0]["ended"].tolist() == [True] and handle.value is None
