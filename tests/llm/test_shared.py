from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from latentmesh.llm import shared


def session(spark, folder):
    """The session as if the folder was set otherwise, which it can't be once it runs."""
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=spark.sparkContext)


def test_folder_is_read_from_the_session(spark, tmp_path):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared.shared_dir(session(spark, str(tmp_path))) == f"file://{tmp_path}"
    assert shared.shared_dir(session(spark, "hdfs://host/x/")) == "hdfs://host/x"
    made = shared.shared_dir(session(spark, None))
    assert made == shared.shared_dir(session(spark, None)) and Path(made.removeprefix("file://")).is_dir()


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark):
    cluster = session(spark, None)
    cluster.sparkContext = SimpleNamespace(applicationId="x", master="spark://host:7077")
    with pytest.raises(ValueError, match="all executors"):
        shared.shared_dir(cluster)


def test_columns_are_found_and_named_as_before(spark):
    df = spark.range(1).select(F.lit("t").alias("Text"), F.lit(1).alias("a.b"), F.lit(2).alias("shard"), F.lit(3).alias("_0"))
    held, closed = shared.opened(df, "text")
    assert held.columns == ["text", "_1", "_2", "_3"]
    assert closed(held).columns == df.columns and closed(held).first() == df.first()
    out = closed(held.withColumn("new", F.lit(9)), Shard="new")
    assert out.columns == ["Text", "a.b", "_0", "Shard"] and tuple(out.first()) == ("t", 1, 3, 9)
    with pytest.raises(ValueError, match="doc_id"):
        shared.opened(df, "doc_id")


def test_an_id_is_a_whole_number(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,)], "i string").select(shared.whole_number("i").alias("i"))
    assert [r.i for r in df.collect()] == [7, None, None]


def test_temporary_tables_go_and_lasting_ones_stay(spark):
    with shared.temporary(spark) as lasting:
        gone, kept = shared.written(spark.range(3), "x"), lasting(spark.range(4), "y")
    path = lambda df: Path(df.inputFiles()[0].removeprefix("file://"))
    assert kept.count() == 4 and not path(gone).exists() and path(kept).exists()


def test_large_sides_are_not_broadcast(spark):
    df = shared.written(spark.range(100), "x")
    assert "broadcast" in shared.small_or_not(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.small_or_not(df, 1 << 20)._jdf.queryExecution().logical().toString().lower()
