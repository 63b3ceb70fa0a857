"""Simulated counts; every draw is a hash of the seed, the simulation, the sample and the feature, so a lost task draws the same again."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1), by the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def from_pmf(pmf: Column, u: Column) -> Column:
    """The first count whose cumulative probability is above ``u``."""
    found = F.aggregate(pmf, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s")), lambda a, p: F.struct((a.k + F.when(a.s + p <= u, 1).otherwise(0)).alias("k"), (a.s + p).alias("s")), lambda a: a.k)
    return F.least(found, F.size(pmf) - 1)


def binomial_pmf(length: int, rate: float, least: float = 1e-50) -> list[float]:
    """Probabilities of 0, 1, ... until they fall below ``least``."""
    p, out, k = (1 - rate) ** length, [], 0
    while k <= length and (p >= least or k < length * rate):
        out.append(p)
        p *= (length - k) / (k + 1) * rate / (1 - rate)
        k += 1
    return out


def single(spark: SparkSession, pmf: list[float], pi: float, samples: int, sims: int, seed: int = 0) -> DataFrame:
    """``sim, sample, c``: passengers by ``pmf`` and a driver with chance ``pi``."""
    rows = spark.range(sims * samples).select(F.floor(F.col("id") / samples).cast("int").alias("sim"), (F.col("id") % samples).cast("int").alias("sample"))
    passengers = from_pmf(F.array(*map(F.lit, pmf)), uniform(seed, "sim", "sample", F.lit("p")))
    return rows.select("sim", "sample", (passengers + (uniform(seed, "sim", "sample", F.lit("d")) < pi).cast("int")).alias("c"))


def joint_drivers(tau: tuple[float, float, float, float], u: Column) -> tuple[Column, Column]:
    """Both drivers of tau = (00, 01, 10, 11) by one uniform draw: 11, then 01, then 10, then none."""
    _, t01, t10, t11 = tau
    both, only_b, only_a = u < t11, (u >= t11) & (u < t11 + t01), (u >= t11 + t01) & (u < t11 + t01 + t10)
    return (both | only_a).cast("int"), (both | only_b).cast("int")


def pair(spark: SparkSession, pmf_a: list[float], pmf_b: list[float], tau: tuple[float, float, float, float], samples: int, sims: int, driver_proportion: float = 1.0, seed: int = 0) -> DataFrame:
    """``sim, sample, ca, cb``; drivers only in the first share of the samples."""
    rows = spark.range(sims * samples).select(F.floor(F.col("id") / samples).cast("int").alias("sim"), (F.col("id") % samples).cast("int").alias("sample"))
    a, b = joint_drivers(tau, uniform(seed, "sim", "sample", F.lit("d")))
    inside = (F.col("sample") < int(samples * driver_proportion)).cast("int")
    draw = lambda pmf, k: from_pmf(F.array(*map(F.lit, pmf)), uniform(seed, "sim", "sample", F.lit(k)))
    return rows.select("sim", "sample", (draw(pmf_a, "a") + a * inside).alias("ca"), (draw(pmf_b, "b") + b * inside).alias("cb"))


def truncated_normal(low: float, high: float, u: float) -> float:
    """A draw around the middle, a sixth of the range as deviation, within the range."""
    unit = NormalDist((low + high) / 2, (high - low) / 6)
    a, b = unit.cdf(low), unit.cdf(high)
    return min(high, max(low, unit.inv_cdf(a + u * (b - a))))


def chosen_features(totals: DataFrame, drivers: DataFrame, n_drivers: int, n_passengers: int) -> tuple[list[str], list[str]]:
    """The features with the most events among the ``drivers``, and among the others; so many of each, by name where they tie."""
    known = totals.join(drivers.select("feature").distinct().withColumn("driver", F.lit(True)), "feature", "left")
    first = lambda on, k: [r.feature for r in known.where(on).orderBy(F.desc("total"), "feature").limit(k).collect()]
    found, passengers = first("driver", n_drivers), first("driver is null", n_passengers)
    if len(found) < n_drivers:
        raise ValueError(f"{n_drivers} drivers are needed and {len(found)} are there")
    return found, passengers


def matrix(pmfs: DataFrame, drivers: list[str], passengers: list[str], n_me: int, n_co: int, samples: int, tau_low: float, tau_high: float, driver_proportion: float = 1.0, seed: int = 0) -> tuple[DataFrame, dict]:
    """``sample, feature, c`` with planted exclusive and co-occurring pairs of drivers, and the truth."""
    spark, rng = pmfs.sparkSession, np.random.default_rng(seed)
    chosen = [str(x) for x in rng.permutation(sorted(drivers)[: 2 * (n_me + n_co)])]
    plan, truth = [], {"ME Pairs": [], "CO Pairs": [], "Likely Passengers": sorted(passengers), "num_samples": samples, "tau_low": tau_low, "tau_high": tau_high, "driver_proportion": driver_proportion}
    for k in range(n_me + n_co):
        a, b = chosen[2 * k : 2 * k + 2]
        x, y = (truncated_normal(tau_low, tau_high, float(rng.random())) for _ in range(2))
        t11, t01, t10 = (0.0, x, y) if k < n_me else (x, 0.0, 0.0)
        plan += [(a, k, t11, t01, t10, True), (b, k, t11, t01, t10, False)]
        truth["ME Pairs" if k < n_me else "CO Pairs"].append([a, b])
    plan += [(p, -1, 0.0, 0.0, 0.0, True) for p in sorted(passengers)]
    features = F.broadcast(spark.createDataFrame(plan, "feature string, pair int, t11 double, t01 double, t10 double, first boolean").join(pmfs, "feature"))  # as large as the listed features
    grid = spark.range(samples).select(F.col("id").cast("int").alias("sample")).crossJoin(features)
    u = uniform(seed, "sample", F.col("pair"), F.lit("d"))
    own = F.when(F.col("first"), (u >= F.col("t11") + F.col("t01")) & (u < F.col("t11") + F.col("t01") + F.col("t10"))).otherwise((u >= F.col("t11")) & (u < F.col("t11") + F.col("t01")))
    driver = ((F.col("sample") < int(samples * driver_proportion)) & ((u < F.col("t11")) | own)).cast("int")
    counts = grid.select("sample", "feature", (from_pmf(F.col("pmf"), uniform(seed, "sample", "feature", F.lit("p"))) + driver).alias("c"))
    return counts.where("c > 0"), truth
