"""Counts of events: long, with cells of 0 left out, and what is summed over them.

``counts`` is ``sample, feature, c`` throughout, ``c > 0``; ``n`` is the number
of samples, those without any event among them where they are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EFFECTS = ("missense", "nonsense")


def feature_name(gene: Column, effect: Column) -> Column:
    return F.concat(gene, F.lit("_"), F.upper(F.substring(effect, 1, 1)))


def base_gene(feature: Column) -> Column:
    return F.regexp_replace(feature, "_[^_]*$", "")


def kept(events: DataFrame) -> DataFrame:
    return events.where(F.col("effect").isin(*EFFECTS))


def count_features(events: DataFrame) -> DataFrame:
    """``sample, feature, c`` by gene and effect."""
    return kept(events).groupBy("sample", feature_name(F.col("gene"), F.col("effect")).alias("feature")).agg(F.count("*").alias("c"))


def count_genes(events: DataFrame) -> DataFrame:
    return kept(events).groupBy("sample", F.col("gene").alias("feature")).agg(F.count("*").alias("c"))


def wide(counts: DataFrame, features: list[str]) -> DataFrame:
    """One row for each sample, one column for each feature, zeros filled in; the features are listed so that no job has to find them."""
    return counts.groupBy("sample").pivot("feature", features).agg(F.sum("c")).na.fill(0)


def sample_count(counts: DataFrame) -> Column:
    return counts.agg(F.count_distinct("sample"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("c").alias("total"))


def ranked(sums: DataFrame, by: str = "total", ties: str = "feature") -> DataFrame:
    """``sums`` with ``rk`` from 1, the largest first; features are few, so one partition orders them."""
    return sums.withColumn("rk", F.row_number().over(Window.orderBy(F.desc(by), ties)))


def top(sums: DataFrame, k: int, by: str = "total", ties: str = "feature") -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(sums.orderBy(F.desc(by), ties).limit(k), by, ties)


def sample_sums(counts: DataFrame, top: DataFrame) -> DataFrame:
    """``sample_sum, n``: how many samples have each number of the ranked features, 0 among them."""
    known = counts.join(top.select("feature", "rk"), "feature", "left")
    return known.groupBy("sample").agg(F.count("rk").alias("sample_sum")).groupBy("sample_sum").agg(F.count("*").alias("n"))


def burden(counts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``sample, burden``; samples without an event have 0 where they are listed."""
    sums = counts.groupBy("sample").agg(F.sum("c").alias("burden"))
    return sums if samples is None else samples.select("sample").join(sums, "sample", "left").na.fill(0, ["burden"])


def hypermutators(burdens: DataFrame, times: float = 10.0) -> DataFrame:
    """``median, mean, fraction`` of samples above ``times`` the median; 0 where the median isn't positive."""
    middle = burdens.agg(F.median("burden").alias("median"), F.avg("burden").alias("mean"))
    above = F.avg((F.col("burden") > times * F.col("median")).cast("double"))
    return burdens.crossJoin(F.broadcast(middle)).groupBy("median", "mean").agg(F.when(F.col("median") > 0, above).otherwise(0.0).alias("fraction"))  # one row is broadcast


def without_top_decile(burdens: DataFrame, q: float = 0.9) -> DataFrame:
    limit = burdens.agg(F.percentile("burden", F.lit(q)).alias("edge"))
    return burdens.crossJoin(F.broadcast(limit)).where("burden < edge").drop("edge")  # one row is broadcast


def trimmed(values: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows between two quantiles of a column, both included."""
    edges = values.agg(F.percentile(column, F.lit(low)).alias("low"), F.percentile(column, F.lit(high)).alias("high"))
    return values.crossJoin(F.broadcast(edges)).where(F.col(column).between(F.col("low"), F.col("high"))).drop("low", "high")  # one row is broadcast


def variation(counts: DataFrame, by: str = "cohort") -> DataFrame:
    """Coefficient of variation over all cells of each group, zeros included, from sums alone."""
    sums = counts.groupBy(by).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), (F.count_distinct("sample") * F.count_distinct("feature")).alias("cells"))
    mean = F.col("s") / F.col("cells")
    return sums.select(by, mean.alias("mean"), (F.sqrt(F.col("q") / F.col("cells") - mean * mean) / mean).alias("cv"))


def spread(counts: DataFrame, n: Column) -> DataFrame:
    """Mean and sample standard deviation of each feature over ``n`` samples, zeros included."""
    sums = counts.groupBy("feature").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    mean = F.col("s") / n
    return sums.select("feature", mean.alias("mean"), F.sqrt((F.col("q") - n * mean * mean) / (n - 1)).alias("sd"))


def effect_totals(counts: DataFrame) -> DataFrame:
    at = lambda s: F.sum(F.when(F.col("feature").endswith(s), F.col("c")).otherwise(0))
    return counts.agg(at("_M").alias("missense"), at("_N").alias("nonsense"), F.count_distinct("sample").alias("samples"))


def large_groups(counts: DataFrame, by: str, least: int) -> DataFrame:
    return counts.groupBy(by).agg(F.count_distinct("sample").alias("samples")).where(F.col("samples") >= least)


def slug(name: Column) -> Column:
    """Letters and digits with single underscores between; UNKNOWN for what has none."""
    clean = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "UNKNOWN").otherwise(clean)


def split_by(counts: DataFrame, types: DataFrame, least: int) -> DataFrame:
    """``counts`` with the slug of each sample's type, of types with ``least`` samples; barcodes are cut to their first three parts."""
    key = F.substring_index(F.col("sample").cast("string"), "-", 3)
    joined = counts.withColumn("key", key).join(types.select(F.col("key").cast("string"), slug(F.col("type")).alias("cohort")), "key").drop("key")
    return joined.join(large_groups(joined, "cohort", least).select("cohort"), "cohort", "left_semi")


def likely_passengers(sums: DataFrame, drivers: DataFrame, k: int) -> DataFrame:
    return top(sums.join(drivers, "feature", "left_anti"), k)
