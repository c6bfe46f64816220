"""JSON sidecars, verdict files, state tables and result bundles."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sidecars(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """A row for each JSON document below a path; unreadable ones and those without a key are skipped, of a key's several the last by file name counts."""
    fields = schema if isinstance(schema, str) else schema.simpleString()
    ddl = StructType.fromDDL(fields) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*ddl.fields, *StructType.fromDDL("_corrupt_record string").fields])).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    named = rows.withColumn("__file", F.input_file_name()).where(F.col("_corrupt_record").isNull() & (F.coalesce(key, F.lit("")) != ""))
    fixed = named.withColumn(key, F.translate(key, "\\", "/"))
    return fixed.groupBy(key).agg(F.max_by(F.struct(*[f.name for f in ddl.fields]), "__file").alias("r")).select("r.*")


def exploded(rows: DataFrame, key: str, field: str) -> DataFrame:
    """The entries of an array of structs beside their key; null entries are dropped."""
    return rows.select(key, F.explode(F.filter(field, lambda x: x.isNotNull())).alias("e")).select(key, "e.*")


def current_findings(debris: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Findings whose source_hash and impl_hash still are the files'; a null hash never is."""
    now = files.select(F.col("path").alias(key), F.col("source_hash").alias("__s"), F.col("impl_hash").alias("__i"))
    kept = debris.join(now, key).where((F.col("source_hash") == F.col("__s")) & (F.col("impl_hash") == F.col("__i")))
    return exploded(kept, key, "findings")


VERDICTS = "run_id string, variant string, repeat int, case string, finding_id string, detector string, expected string, verdict string, gray boolean, confidence double, correct boolean"


def write_verdicts(rows: DataFrame, meta: dict, path: str) -> None:
    """NDJSON: a line for each verdict in order, then one of run data, streamed over the driver."""
    names = rows.columns
    with Path(path).open("w") as out:
        for r in rows.orderBy("variant", "repeat", "case").toLocalIterator():
            out.write(json.dumps({"record": "verdict", **dict(zip(names, r, strict=True))}, sort_keys=True, ensure_ascii=False) + "\n")
        out.write(json.dumps({"record": "run_meta", **meta}, sort_keys=True, ensure_ascii=False) + "\n")


def read_verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The verdicts and the run data of a file; ValueError if that is not its last line."""
    lines = spark.read.schema(f"record string, {VERDICTS}").json(path)
    raw = spark.read.text(path).where(F.col("value").contains('"run_meta"')).head(2)
    last = Path(path.removeprefix("file://")).read_text().rstrip("\n").rpartition("\n")[2]
    if len(raw) != 1 or json.loads(last).get("record") != "run_meta":
        raise ValueError(f"{path} does not end in its run data")
    return lines.where("record = 'verdict'").drop("record"), {k: v for k, v in json.loads(last).items() if k != "record"}


def write_state(rows: DataFrame, path: str, version: str) -> None:
    """A verdict state with its version."""
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """The state, empty where it is missing, unreadable or of another version."""
    try:
        found = spark.read.parquet(path)
        return found.where(F.col("version") == version).drop("version").select(*StructType.fromDDL(schema).fieldNames())
    except Exception as problem:  # the driver reports a missing or damaged table in several ways
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER" in str(problem) or "UNRESOLVED_COLUMN" in str(problem):
            return spark.createDataFrame([], schema)
        raise


def write_bundle(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """One JSON document of small result tables, rows as objects, streamed table by table."""
    with Path(path).open("w") as out:
        out.write(json.dumps({"schema_version": version})[:-1])
        for name, df in tables.items():
            rows = ",".join(df.toJSON().toLocalIterator())
            out.write(f", {json.dumps(name)}: [{rows}]")
        out.write("}\n")
