"""Intermediate results in the folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths given out and not yet removed.
_given: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of its own only where none is named and the session runs on this machine alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return named or context._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, whose size Spark knows; what was shuffled for it goes from the machines' disks."""
    path = shared_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What queries within it shuffled goes from the machines' disks when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared tables made within it when it ends; whatever reads them must have run by then."""
    before = len(_given)
    try:
        yield
    finally:
        for path in _given[before:]:
            remove(spark, path)
        del _given[before:]


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
