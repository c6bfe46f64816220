"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly by a seeded hash into buckets that fit into memory; a count of cells of the
hash, made beforehand and as fine as the table's bytes ask for, gives each bucket's size and its place in the whole order. Pass two reads a bucket,
brings its rows into a fixed order, shuffles them with a seeded Fisher-Yates shuffle and writes them to
their shards. Shards are equal cuts of the whole order, so their row counts are at most one apart.

Rows: a null text counts no bytes; a null doc_id is hashed as such; repeated rows stay rows of their own;
an empty table gives an empty result; further columns are carried along, but for any named shard or slot.
Rows that are alike in doc_id and text have one hash and share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import common

SEED = 42
#: Cells of the hash to a bucket, and at least; the bytes of text that a bucket takes.
FINE, CELLS, BUCKET_BYTES = 16, 1 << 12, 32 << 20


def row_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 8


def shuffled(docs: DataFrame, shards: int = 24, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns, and shard and slot (gapless from 0 in each shard)."""
    common.tune(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    total_bytes = docs.agg(F.sum(row_bytes(text))).head()[0] or 0
    cells = max(CELLS, 1 << (FINE * total_bytes // bucket_bytes).bit_length())
    cell_name, bucket_name = common.unused(docs, "cell"), common.unused(docs, "bucket")
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(cells)).cast("int")
    counted = docs.select(cell.alias("cell"), row_bytes(text).alias("size")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toArrow()
    order = np.argsort(counted["cell"].to_numpy())
    rows, sizes = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    rows[counted["cell"].to_numpy()[order]] = counted["n"].to_numpy()[order]
    sizes[counted["cell"].to_numpy()[order]] = counted["size"].to_numpy()[order]
    bucket_of = ((np.cumsum(sizes) - sizes) // bucket_bytes).astype(np.int32)
    total = int(rows.sum())
    per_bucket = np.bincount(bucket_of, weights=rows).astype(np.int64)
    first = np.cumsum(per_bucket) - per_bucket
    starts = [int(x) for x in np.flatnonzero(np.append(True, np.diff(bucket_of) > 0))]
    edges = np.array([k * total // shards for k in range(shards + 1)])
    numbers = bucket_of[starts]

    def bucket(batches):
        for batch in batches:
            found = numbers[np.searchsorted(starts, batch[cell_name].to_numpy(), side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int32())], names=[*batch.schema.names[:-1], bucket_name])

    def shuffle(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        table = table.drop_columns([bucket_name])
        order = pc.sort_indices(pa.table({"id": table[doc_id], "text": table[text]}), sort_keys=[("id", "ascending"), ("text", "ascending")]).to_numpy()
        order = np.random.default_rng([seed, number]).permutation(order)
        place = first[number] + np.arange(len(order))
        shard = np.searchsorted(edges, place, side="right") - 1
        return table.take(pa.array(order)).append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(place - edges[shard], pa.int64()))

    wide = docs.withColumn(cell_name, cell)
    with_bucket = wide.mapInArrow(common.lean(bucket), StructType([*docs.schema.fields, StructField(bucket_name, IntegerType())]))
    schema = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    return with_bucket.groupBy(bucket_name).applyInArrow(common.lean_group(shuffle), schema)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shuffled rows, one folder for each shard, and reads them back."""
    rows = shuffled(docs, **options)
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
