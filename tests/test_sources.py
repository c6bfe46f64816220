"""Folders read by tasks, and tables that are replaced as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import folders, manifest, repository

from .conftest import rows

SCHEMA = "id long, verdict string"


def table(spark, version, count=100):
    return spark.range(count).select("id", F.lit(version).alias("verdict")).repartition(3)


def test_folders_are_read_by_tasks(spark, tmp_path):
    names = ["top.py", ".hidden", "a/x.py", "a/_y", "a/b/c/d/e/deep.txt", "z/.dot/f", "empty/sub/g"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "nothing").mkdir()
    for enough in (1, 3, 64):
        df = folders.read_folders(spark, str(tmp_path), enough)
        assert rows(df.select("path", F.col("content").cast("string"))) == sorted((n, n) for n in names)
    assert folders.read_folders(spark, f"file://{tmp_path}", 3).rdd.getNumPartitions() > 3
    assert {r.path for r in repository.files(spark, str(tmp_path), ignore=["*.txt"]).collect()} == set(names) - {"a/b/c/d/e/deep.txt"}
    (tmp_path / "none").mkdir()
    assert folders.read_folders(spark, str(tmp_path / "none")).count() == 0


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "m")
    assert manifest.read_manifest(spark, path, SCHEMA).count() == 0
    manifest.write_manifest(table(spark, "one"), path, "1", about="abc")
    assert manifest.read_manifest(spark, path, SCHEMA, "1").groupBy("verdict").count().collect() == [("one", 100)]
    assert manifest.read_manifest(spark, path, SCHEMA, "2").count() == 0  # of another version
    assert manifest.load(path)["about"] == "abc" and sum(p["rows"] for p in manifest.load(path)["parts"]) == 100
    older = manifest.read_manifest(spark, path, SCHEMA)
    manifest.write_manifest(older.withColumn("verdict", F.lit("two")).where("id < 10"), path, "2")  # from itself
    assert manifest.read_manifest(spark, path, SCHEMA, "2").count() == 10
    with pytest.raises(Exception, match="overwrite"):
        table(spark, "x").write.format("manifest").mode("append").option("path", path).save()


def test_a_failed_task_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "m")
    manifest.write_manifest(table(spark, "one"), path, "1")
    failing = table(spark, "two").withColumn("verdict", F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise("two"))
    with pytest.raises(Exception, match="killed"):
        manifest.write_manifest(failing, path, "2")
    assert manifest.read_manifest(spark, path, SCHEMA, "1").groupBy("verdict").count().collect() == [("one", 100)]
    (tmp_path / "m/parts/left.parquet").write_text("by a task that was killed")
    before = {p["name"] for p in manifest.load(path)["parts"]}
    manifest.write_manifest(table(spark, "three"), path, "3")
    now = {p["name"] for p in manifest.load(path)["parts"]}
    assert {p.name for p in (tmp_path / "m/parts").iterdir()} == now | before  # readers of the one before may still be at work


def test_half_written_and_foreign_manifests_are_empty(spark, tmp_path):
    path = tmp_path / "m"
    manifest.write_manifest(table(spark, "one"), str(path), "1")
    good = (path / "manifest.json").read_text()
    other = json.loads(good) | {"format": "manifest/2"}
    for text in (good[:50], "[]", json.dumps(other), json.dumps({"format": "manifest/1"})):
        (path / "manifest.json").write_text(text)
        assert manifest.read_manifest(spark, str(path), SCHEMA).count() == 0
    (path / "manifest.json").write_text(good)
    assert manifest.read_manifest(spark, str(path), SCHEMA).count() == 100
    part = next((path / "parts").iterdir())
    part.write_bytes(part.read_bytes()[:-1])
    assert manifest.read_manifest(spark, str(path), SCHEMA).count() == 0
