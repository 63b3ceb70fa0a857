"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where all run in this process, as in tests, a folder can be made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
        if context.applicationId not in _made:
            _made[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="latentmesh-")
        return _made[context.applicationId]
    if "://" not in folder:  # a bare path is one of the cluster's default file system
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        folder = re.sub("^file:/+", "file:///", place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString())
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again, so that later plans start from a table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
