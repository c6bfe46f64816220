"""State kept over runs, as streams: an extension, since batch semantics suffice for everything else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_path


def counts(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n, last_id): additive state, so batches can be merged in any order."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def merge(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.unionByName(new).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The events table read as a stream and summed up by micro-batches: the state that is left.

    Each batch writes a new version of the state named by its number, so a batch that runs again after a
    failure starts from the version before it and gives the same one.
    """
    base = shared_path(spark, "state")
    empty = counts(spark.read.parquet(path)).limit(0)
    empty.write.parquet(f"{base}/-1")
    last = [-1]

    def add(batch: DataFrame, number: int) -> None:
        state = batch.sparkSession.read.schema(empty.schema).parquet(f"{base}/{number - 1}")
        merge(state, counts(batch)).write.mode("overwrite").parquet(f"{base}/{number}")
        last[0] = number

    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    stream.writeStream.foreachBatch(add).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{base}/{last[0]}")
