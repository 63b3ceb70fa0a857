"""Networks of interactions: edges, consensus over backgrounds, groups of cohorts, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import base_gene


def unordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b), F.greatest(a, b)]


def edges(me: DataFrame, co: DataFrame) -> DataFrame:
    """``a, b, kind`` of pairs ranked by either direction; an edge in both is exclusion."""
    low, high = unordered(F.col("a"), F.col("b"))
    both = me.select(low.alias("a"), high.alias("b"), F.lit("ME").alias("kind"), F.lit(0).alias("o"), "rk").unionByName(co.select(low.alias("a"), high.alias("b"), F.lit("CO").alias("kind"), F.lit(1).alias("o"), "rk"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("o", "rk"))).where("n = 1").select("a", "b", "kind")


def consensus(ranked: DataFrame) -> DataFrame:
    """From ``cohort, bmr, direction, a, b, rk, rho, lrt``: for each pair of genes the backgrounds that support it.

    Where several features of the genes make the pair under one background, the last ranked is recorded.
    """
    low, high = unordered(base_gene(F.col("a")), base_gene(F.col("b")))
    each = ranked.groupBy("cohort", "direction", low.alias("a"), high.alias("b"), "bmr").agg(F.max_by(F.struct("rk", "rho", "lrt"), "rk").alias("record"), F.min("rk").alias("best"))
    return each.groupBy("cohort", "direction", "a", "b").agg(F.array_sort(F.collect_set("bmr")).alias("supported_by"), F.count("*").alias("n_bmr"), F.min("best").alias("best_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bmr", "record")))).alias("per_bmr"))


def grouped(edges_: DataFrame, group_of: DataFrame, drivers: DataFrame) -> DataFrame:
    """Consensus edges pooled over the cohorts of a group, with how many of the two genes are drivers."""
    pooled = edges_.join(group_of, "cohort").groupBy("group", "direction", "a", "b").agg(F.count_distinct("cohort").alias("n_cohorts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("supported_by")))).alias("supported_by"), F.min("best_rank").alias("best_rank"))
    mark = lambda s: drivers.select(F.col("gene").alias(s), F.lit(1).alias(f"d_{s}"))
    marked = pooled.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    known = F.coalesce("d_a", F.lit(0)) + F.coalesce("d_b", F.lit(0))
    return marked.select("group", "direction", "a", "b", "n_cohorts", "supported_by", "best_rank", F.element_at(F.array(F.lit("pp"), F.lit("dp"), F.lit("dd")), known + 1).alias("kind"))


def as_json(consensus_: DataFrame) -> DataFrame:
    """One record for each cohort, its edges nested by direction in order of support."""
    nested = consensus_.groupBy("cohort").agg(*[F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct((-F.col("n_bmr")).alias("order"), "best_rank", "a", "b", "supported_by", F.to_json("per_bmr").alias("per_bmr"))))).alias(d) for d in ("ME", "CO")])
    return nested.select("cohort", F.to_json(F.struct("cohort", "ME", "CO")).alias("record"))


def degrees(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("feature")).unionByName(pairs.select(F.col("b").alias("feature")))
    return ends.groupBy("feature").agg(F.count("*").alias("degree"))


def spearman(table: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    return table.select(rank(x).alias("x"), rank(y).alias("y")).agg(F.corr("x", "y").alias("spearman"), F.count("*").alias("n"))


def median_log_odds(tables: DataFrame) -> DataFrame:
    """Median over pairs of the log odds ratio with a half added to each cell."""
    h = lambda c: F.col(c) + 0.5
    return tables.agg(F.median(F.ln(h("n11") * h("n00") / (h("n10") * h("n01")))).alias("median_lor"), F.count("*").alias("pairs"))


def calibration(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed over expected totals, and their correlation over what is expected; 0 where either doesn't vary."""
    both = expected.join(observed, "key", "left").na.fill(0, ["observed"])
    flat = (F.stddev_pop("observed") == 0) | (F.stddev_pop("expected") == 0)
    return both.agg(F.sum("observed").cast("double").alias("observed"), F.sum("expected").alias("expected"), F.when(flat, 0.0).otherwise(F.corr(F.col("observed").cast("double"), F.col("expected"))).alias("correlation"))


def observed_over_expected(totals: DataFrame, expected: DataFrame, n: Column) -> DataFrame:
    joined = totals.join(expected, "feature")
    ratio = F.try_divide(F.col("total").cast("double"), F.col("expected") * n)
    return joined.select("feature", F.col("total").alias("observed"), (F.col("expected") * n).alias("expected"), ratio.alias("ratio"), F.greatest(F.lit(0.0), 1 - F.try_divide(F.lit(1.0), ratio)).alias("surplus"), F.least(ratio, F.lit(1.0)).alias("explained"))


def in_many(sets: DataFrame, least: int = 4) -> DataFrame:
    """``gene, cohorts`` of the genes in at least so many cohorts, from ``cohort, gene``."""
    return sets.groupBy("gene").agg(F.array_sort(F.collect_set("cohort")).alias("cohorts")).where(F.size("cohorts") >= least)
