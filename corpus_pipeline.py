"""The corpus pipeline: each stage applies one operator to what the stage before it kept.

Rows: null texts are empty texts to every stage and come out as they came in; a null doc_id is a value like any
other; repeated rows are near copies of each other, so one stays; of rows that tie for a place in a class the least
doc_id stays, then the least hash of the text; an empty table goes through all stages; columns beyond those of
documents are carried along whatever they are called, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import bpe, decontam, near_copies, pii, quality
from quarrylens.llm.common import read, shared_path
from quarrylens.llm.queries import DIGESTS, RANKS, token_digests
from quarrylens.sources.storage import remove, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the ranking's cut."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the SimHash index on five-word shingles, completed and verified by exact similarity."""
    return near_copies.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark; those that are mostly such passages go."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind's name."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids, and digests of the ids and of what they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe.encode(rows, ranks, public_tokenizers.PATTERN, then=token_digests(ranks), schema=f"doc_id long, ids array<int>, {DIGESTS}")


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_duplicates", distinct), ("decontamination", decontaminated), ("personal_data", anonymous), ("tokens", tokens)]

#: SQL can express neither the fitted ranking nor the ranked merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages made on the way is removed."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
