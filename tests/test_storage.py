import time
from types import SimpleNamespace

import pytest

from quarrylens.sources import storage


def test_scratch_tables_go_when_it_ends(spark):
    kept = storage.shared_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with storage.scratch(spark):
        path = storage.shared_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_a_cluster_must_name_the_folder():
    empty = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: empty), getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))

    before = shuffled()
    df = spark.range(200_000).selectExpr("id", "hash(id) AS x").repartition(4, "x")
    found = storage.stored(df.groupBy("x").count(), "counts")
    deadline = time.time() + 20
    while shuffled() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffled() <= before
    assert found.count() == df.select("x").distinct().count()
