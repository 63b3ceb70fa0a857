"""Cohorts out of order lines: an order is a sample, a brand a gene, a return flag an effect, a priority a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, kept: bool = False) -> DataFrame:
    """``sample, gene, effect`` of every line; of those that count only if ``kept``, which the scan filters by their flag."""
    effect = F.when(F.col("l_returnflag") == "A", "missense").when(F.col("l_returnflag") == "R", "nonsense").otherwise("silent")
    lines = table(spark, sf_dir, "lineitem")
    if kept:
        lines = lines.where(F.col("l_returnflag").isin("A", "R"))
    lines = lines.select(F.col("l_orderkey").alias("sample"), "l_partkey", effect.alias("effect"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    return lines.join(parts, "l_partkey").select("sample", "gene", "effect")


def sample_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, cohort``."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("cohort"))
