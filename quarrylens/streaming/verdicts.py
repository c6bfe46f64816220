"""Verdicts kept over audits: a log of decided findings, folded into keyed state by a stream.

Each audit appends its verdicts to the log, and ``advance`` lets the stream catch up from its checkpoint: only the
keys of new rows are touched. A key's state is its last verdict. A row finds it (a hit) if evidence
and version are the same; under another version it is stale and replaced. What was not renewed for ``keep`` has ended:
a later row finds nothing, and a timer removes the state once the watermark has passed.

Rows of one key are taken in order of time, then of ``ord``; how the log is cut into batches changes nothing, as
long as rows are not later than ``delay`` behind the log. Rows without a finding's id or a verdict are no verdicts; a null
fingerprint is never found. The rows that one key has in one batch are held together, so the stream's trigger bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "finding_id string, fingerprint string, verdict string, version string, at timestamp, ord long"
STATE = "version string, fingerprint string, verdict string, at long, seen long, hits long, stale long"
#: What a batch tells of each of its keys: how many rows it had, how many of them were hits, and what holds now.
UPDATES = "finding_id string, n long, hits long, version string, verdict string, ended boolean"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def version_stamp(schema: Column, engine: Column, rules: Column) -> Column:
    """What verdicts depend on: the evidence's schema, the engine and, if there are any, the project's own rules."""
    base = F.concat_ws(":", schema.cast("string"), engine)
    digest = F.substring(F.sha2(rules.cast("binary"), 256), 1, 16)
    return F.when(F.coalesce(rules, F.lit("")).rlike(r"\S"), F.concat(base, F.lit(":rules-"), digest)).otherwise(base)


class Keeper(StatefulProcessor):
    """The state of each finding, and its timer: a kept state has one, which is set again if it comes before the state's end."""

    def __init__(self, keep: int, told: bool = True):
        self.keep, self.told = keep, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("verdict", STATE)

    def end(self, last: tuple) -> int:
        return (last[3] + self.keep) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.state.get()
        entries, hits = [], 0
        for part in rows:
            entries += zip(*(part[c].tolist() for c in ("us", "ord", "fingerprint", "verdict", "version")), strict=True)
        entries.sort(key=lambda x: (x[0], pd.isna(x[1]), 0 if pd.isna(x[1]) else x[1]))
        for at, _, fingerprint, verdict, version in entries:
            at, fingerprint = int(at), None if pd.isna(fingerprint) else fingerprint
            if last is None or last[3] + self.keep <= at:
                last = (version, fingerprint, verdict, at, 1, 0, 0)
                continue
            hit = version == last[0] and fingerprint is not None and fingerprint == last[1]
            hits += hit
            last = (version, fingerprint, verdict, at, last[4] + 1, last[5] + hit, last[6] + (version != last[0]))
        self.state.update(last)
        if before is None:
            self.handle.registerTimer(self.end(last))
        if self.told:
            yield pd.DataFrame({"finding_id": [key[0]], "n": [len(entries)], "hits": [hits], "version": [last[0]], "verdict": [last[2]], "ended": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()
        if self.end(last) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self.end(last))
            return
        self.state.clear()
        if self.told:
            yield pd.DataFrame({"finding_id": [key[0]], "n": [0], "hits": [0], "version": [last[0]], "verdict": [last[2]], "ended": [True]})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs this store."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def append(verdicts: DataFrame, log: str) -> None:
    """Adds an audit's verdicts to the log."""
    verdicts.select(*(c.split()[0] for c in LOG.split(", "))).where("finding_id IS NOT NULL AND verdict IS NOT NULL").write.mode("append").parquet(log)


def advance(spark: SparkSession, log: str, checkpoint: str, keep_seconds: int, delay: str = "0 seconds", updates: str | None = None) -> None:
    """Folds what is new in the log into the state; with ``updates``, what each batch did is written there."""
    rows = spark.readStream.schema(LOG).parquet(log).withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    told = rows.groupBy("finding_id").transformWithStateInPandas(Keeper(keep_seconds * SECOND, told=bool(updates)), UPDATES, "append", "eventTime")
    out = told.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocks(spark):
        (out.format("parquet").option("path", updates) if updates else out.format("noop")).start().awaitTermination()


def kept(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as it stands: (finding_id, version, fingerprint, verdict, at (microseconds), seen, hits, stale)."""
    with rocks(spark):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "verdict").load()
    return rows.select(F.col("key.finding_id").alias("finding_id"), "value.*")


def usable(state: DataFrame, version: str, keep_seconds: int) -> DataFrame:
    """The kept verdicts that have not ended by the log's last time, and whether they hold under a version."""
    last = F.broadcast(state.agg(F.max("at").alias("__last")))
    return state.crossJoin(last).where(F.col("at") + keep_seconds * SECOND > F.col("__last")).drop("__last").withColumn("valid", F.col("version") == version)
