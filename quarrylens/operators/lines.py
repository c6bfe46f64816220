"""Operators on the lines of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import line_array


def explode_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 1), line."""
    return df.select(*keys, F.posexplode(line_array(F.col(text))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def context_frames(df: DataFrame, keys: list[str], hit, radius: int = 2, text: str = "text", width: int | None = None) -> DataFrame:
    """keys, line_no, context of every line for which ``hit(line)`` holds: the lines around it, without a shuffle."""
    lines = line_array(F.col(text))
    found = df.withColumn("__lines", lines).select(*keys, "__lines", F.posexplode("__lines").alias("pos", "line")).where(hit(F.col("line")))
    around = F.slice("__lines", F.greatest(F.col("pos") + 1 - radius, F.lit(1)), F.least(F.col("pos"), F.lit(radius)) + 1 + radius)
    if width:
        around = F.transform(around, lambda x: F.substring(x, 1, width))
    return found.select(*keys, (F.col("pos") + 1).cast("long").alias("line_no"), F.array_join(around, "\n").alias("context"))


def numbered(text: Column) -> Column:
    """The text with right-aligned line numbers, four digits wide at least."""
    lines = line_array(text)
    width = F.greatest(F.lit(4), F.length(F.size(lines).cast("string")))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("\t"), x)), "\n")


def first_match(lines: DataFrame, keys: list[str], words: DataFrame, word: str, pattern: str = "[a-z]+") -> DataFrame:
    """keys, line_no, line of each key's first line that has one of the words."""
    tokens = lines.select(*keys, "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(pattern), F.lit(0)))).alias(word))
    hits = tokens.join(words.select(word).distinct(), word, "left_semi")
    return hits.groupBy(*keys).agg(F.min(F.struct("line_no", "line")).alias("m")).select(*keys, "m.line_no", "m.line")


def token_references(texts: DataFrame, key: str, names: DataFrame, name: str, text: str = "text", pattern: str = "[a-z]{3,}") -> DataFrame:
    """name, n: in how many keys each name stands as a token; names without any have 0."""
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))).alias(name))
    wanted = names.select(name).distinct()
    counts = tokens.join(wanted, name, "left_semi").groupBy(name).agg(F.countDistinct(key).alias("n"))
    return wanted.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exact_references(texts: DataFrame, key: str, names: list[str], text: str = "text") -> DataFrame:
    """key, line_no, name with longest-first, non-overlapping matches: a qualified name uses its tail up."""
    import re

    choice = "|".join(re.escape(x) for x in sorted(set(names), key=lambda x: (-len(x), x)))
    lines = explode_lines(texts, [key], text)
    return lines.select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(rf"(?<!\w)(?:{choice})(?!\w)"), F.lit(0)))).alias("name"))


def chunks(df: DataFrame, keys: list[str], budget: int, overlap: float = 0.05, text: str = "text") -> DataFrame:
    """keys, chunk_no, first_line, last_line, chunk: consecutive lines until the budget of code points is reached or passed.

    Each chunk starts again with the last lines of the one before, a share of all lines, one at least.
    """
    rows = df.select(*keys, F.coalesce(text, F.lit("")).alias("__text"))
    schema = StructType([*(rows.schema[k] for k in keys), StructField("chunk_no", IntegerType()), StructField("first_line", IntegerType()), StructField("last_line", IntegerType()), StructField("chunk", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_, out = [], []
            for i, t in enumerate(batch["__text"].to_pylist()):
                for k, (a, b, part) in enumerate(split_chunks(t, budget, overlap)):
                    rows_.append(i)
                    out.append((k, a, b, part))
            columns = [x.take(pa.array(rows_, pa.int64())) for x in batch.columns[:-1]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in out], kinds[k]) for k in range(4))], names=schema.names)

    return rows.mapInArrow(cut, schema)


def split_chunks(text: str, budget: int, overlap: float) -> list[tuple[int, int, str]]:
    lines = text.split("\n")
    again = max(1, int(len(lines) * overlap))
    out, start = [], 0
    while start < len(lines):
        size, end = 0, start
        while end < len(lines) and size < budget:
            size += len(lines[end]) + 1
            end += 1
        out.append((start + 1, end, "\n".join(lines[start:end])))
        if end == len(lines):
            break
        start = max(end - again, start + 1)
    return out
