"""Background distributions of counts.

``feature, pmf`` is shared by all samples and ``feature, sample, pmf`` has one for
each.  ``feature, class, pmf`` has one for each class of samples with equal
backgrounds, which is what fits take: their histograms then grow with the
number of classes and not of samples.  Where every sample has a background of
its own, it is its own class.

``kmax`` is the largest count that has a probability; ``largest`` finds that of
a cohort, beyond which there is nothing to look up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special

@dataclass(frozen=True)
class Background:
    counts: DataFrame | None
    pmfs: DataFrame


@runtime_checkable
class Provider(Protocol):
    """Anything that makes a background of a cohort."""

    def estimate(self, counts: DataFrame | None) -> Background: ...


def largest(counts: DataFrame) -> int:
    """The largest count, at least 1."""
    return int(counts.agg(F.greatest(F.coalesce(F.max("c"), F.lit(1)), F.lit(1))).first()[0])


def poisson(totals: DataFrame, n: Column, share: float, kmax: int) -> DataFrame:
    """Poisson with ``share`` of a feature's mean count."""
    return totals.select("feature", special.poisson_pmf(F.lit(share) * F.col("total") / n, kmax).alias("pmf"))


def negative_binomial(dig: DataFrame, n_samples: int, max_count: int | None = None, tail: float = 1e-7, limit: int = 50) -> DataFrame:
    """``feature, pmf`` from gene-wise gamma parameters: size alpha / n, chance 1 / (1 + theta pi).

    All features share a support that leaves at most ``tail`` out, of at most
    ``limit``; without a positive pi all mass is at 0.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    genes = dig.where(good("alpha") & good("theta") & (F.col("alpha") > 0) & (F.col("theta") > 0))
    both = genes.select(F.col("alpha"), F.col("theta"), F.inline(F.array(*[F.struct(F.concat("gene", F.lit(s)).alias("feature"), F.col(c).alias("pi")) for s, c in (("_M", "pi_mis"), ("_N", "pi_nons"))])))
    both = both.where("pi is not null and not isnan(pi)").withColumns({"size": F.col("alpha") / F.lit(float(n_samples)), "p": 1 / (1 + F.col("theta") * F.greatest(F.col("pi"), F.lit(0.0)))})
    raw = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.array(F.exp(F.col("size") * F.ln("p"))), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + F.col("size")) / k * (1 - F.col("p")))))
    reach = F.aggregate(raw, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a.k + F.when(a.s < 1 - tail, 1).otherwise(0)).alias("k"), (a.s + x).alias("s")), lambda a: F.least(a.k - 1, F.lit(limit)))
    top = both.where("pi > 0").agg(F.greatest(F.coalesce(F.max(reach), F.lit(1)), F.lit(max_count or 1)).alias("kmax"))
    zero = F.transform(F.sequence(F.lit(0), F.col("kmax")), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return both.crossJoin(F.broadcast(top)).select("feature", F.when(F.col("pi") > 0, special.negative_binomial_pmf(F.col("size"), F.col("p"), F.col("kmax"))).otherwise(zero).alias("pmf"))  # one row is broadcast


def _scaled(expected: DataFrame, burdens: DataFrame, key: str, kmax: int, least: float) -> DataFrame:
    mean = burdens.agg((F.sum(F.col("burden") * F.col("n")) / F.sum("n")).alias("mean"))
    scale = burdens.crossJoin(F.broadcast(mean)).select(key, (F.col("burden") / F.col("mean")).alias("scale"))  # one row is broadcast
    rates = expected.select("feature", "expected").crossJoin(scale).select("feature", key, F.greatest(F.col("expected") * F.col("scale"), F.lit(least)).alias("lambda"))
    return rates.withColumn("pmf", special.poisson_pmf(F.col("lambda"), kmax))


def by_burden(expected: DataFrame, burdens: DataFrame, kmax: int, least: float = 1e-9) -> DataFrame:
    """``feature, sample, lambda, pmf``: a feature's expectation times the sample's burden over the mean one."""
    return _scaled(expected, burdens.withColumn("n", F.lit(1)), "sample", kmax, least)


def burden_classes(burdens: DataFrame) -> DataFrame:
    """``sample, class``: samples of one burden have one background."""
    return burdens.select("sample", F.col("burden").alias("class"))


def by_burden_class(expected: DataFrame, burdens: DataFrame, kmax: int, least: float = 1e-9) -> DataFrame:
    """``feature, class, lambda, pmf``: the same for each burden instead of each sample."""
    return _scaled(expected, burdens.groupBy("burden").agg(F.count("*").alias("n")).withColumn("class", F.col("burden")), "class", kmax, least)


def own_classes(samples: DataFrame) -> DataFrame:
    """``sample, class``: every sample for itself."""
    return samples.select("sample", F.col("sample").alias("class"))


def by_rates(rates: DataFrame, samples: DataFrame, kmax: int, fallback: DataFrame | None = None, least: float = 1e-12) -> DataFrame:
    """``feature, class, lambda, pmf`` of given rates ``feature, sample, lambda``.

    A sample without a rate has the feature's mean; a feature without any has
    its shared distribution in ``fallback``, if there is one.
    """
    mean = rates.groupBy("feature").agg(F.avg("lambda").alias("mean"))
    full = mean.crossJoin(samples.select("sample")).join(rates, ["feature", "sample"], "left")
    made = full.select("feature", F.col("sample").alias("class"), F.greatest(F.coalesce("lambda", "mean"), F.lit(least)).alias("lambda")).withColumn("pmf", special.poisson_pmf(F.col("lambda"), kmax))
    if fallback is None:
        return made
    rest = fallback.select("feature", "pmf").join(mean, "feature", "left_anti").crossJoin(samples.select(F.col("sample").alias("class")))
    return made.unionByName(rest.select("feature", "class", special.pmf_mean(F.col("pmf")).alias("lambda"), "pmf"))


def exposure_rates(genes: DataFrame, factors: DataFrame, n: int) -> DataFrame:
    """``feature, sample, lambda`` from ``gene, mutrate, n_eff, nmis, nnon, nspl`` and a ``factor`` of each sample.

    A gene's rate is the mean number of its sites a sample, covered in ``n_eff``,
    times its chance of a mutation; splice sites count as nonsense.
    """
    both = genes.select("mutrate", "n_eff", F.inline(F.array(F.struct(F.concat("gene", F.lit("_M")).alias("feature"), F.col("nmis").alias("sites")), F.struct(F.concat("gene", F.lit("_N")).alias("feature"), (F.col("nnon") + F.col("nspl")).alias("sites")))))
    return both.crossJoin(factors).select("feature", "sample", (F.col("sites") / n * F.col("mutrate") * F.col("factor")).alias("lambda"))


def expected(pmfs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``feature, expected``: the mean count a sample; distributions of classes weigh as many as are in each."""
    mean = special.pmf_mean(F.col("pmf"))
    if classes is None:
        return pmfs.groupBy("feature").agg(F.avg(mean).alias("expected"))
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    return pmfs.join(sizes, "class").groupBy("feature").agg((F.sum(mean * F.col("n")) / F.sum("n")).alias("expected"))


def max_entropy(rows: np.ndarray, many_rows: np.ndarray, columns: np.ndarray, many_columns: np.ndarray, sweeps: int = 200, tol: float = 1e-6, halvings: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """a and b with p = 1 / (1 + exp(a + b)) having the given sums in expectation.

    Equal sums have equal solutions, so distinct ones are given, with how many
    have each; each side is solved in turn by bisection on [-50, 50].
    """
    a, b = np.zeros(len(rows)), np.zeros(len(columns))

    def solve(sums: np.ndarray, other: np.ndarray, many: np.ndarray) -> np.ndarray:
        low, high = np.full(len(sums), -50.0), np.full(len(sums), 50.0)
        for _ in range(halvings):
            middle = (low + high) / 2
            above = (many / (1 + np.exp(middle[:, None] + other[None]))).sum(1) > sums
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        return (low + high) / 2

    for _ in range(sweeps):
        a = solve(rows, b, many_columns)
        b = solve(columns, a, many_rows)
        fitted = (many_columns / (1 + np.exp(a[:, None] + b[None]))).sum(1)
        if np.abs(fitted - rows).max(initial=0) < tol:
            break
    return a, b


def max_entropy_background(counts: DataFrame, least: float = 1e-12) -> DataFrame:
    """``feature_sum, sample_sum, p``: the chance of an event by the margins alone; margins are few, whatever the number of cells."""
    hits = counts.where("c > 0").select("sample", "feature").distinct()
    sums = lambda by: hits.groupBy(by).agg(F.count("*").alias(f"{by}_sum")).groupBy(f"{by}_sum").agg(F.count("*").alias("n"))
    return max_entropy_of_margins(sums("feature"), sums("sample"), least)


def max_entropy_of_margins(feature_sums: DataFrame, sample_sums: DataFrame, least: float = 1e-12) -> DataFrame:
    """The same from how many features have each sum, ``feature_sum, n``, and how many samples, ``sample_sum, n``."""
    side = lambda sums, by, k: sums.select(F.col(f"{by}_sum").alias("s"), "n", F.lit(k).alias("side"))
    sides = side(feature_sums, "feature", 0).unionByName(side(sample_sums, "sample", 1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = (frame[frame["side"] == k].sort_values("s") for k in (0, 1))
        a, b = max_entropy(*(v.to_numpy(float) for x in (r, c) for v in (x["s"], x["n"])))
        p = np.clip(1 / (1 + np.exp(a[:, None] + b[None])), least, 1 - least)
        return pd.DataFrame({"feature_sum": np.repeat(r["s"].to_numpy(), len(c)), "sample_sum": np.tile(c["s"].to_numpy(), len(r)), "p": p.ravel()})

    return sides.groupBy(F.lit(0).alias("one")).applyInPandas(run, "feature_sum long, sample_sum long, p double")


@dataclass(frozen=True)
class PoissonProvider:
    share: float = 0.8
    kmax: int | None = None

    def estimate(self, counts: DataFrame | None) -> Background:
        if counts is None:
            raise ValueError("counts are needed")
        n = counts.agg(F.count_distinct("sample")).first()[0]
        return Background(counts, poisson(counts.groupBy("feature").agg(F.sum("c").alias("total")), F.lit(n), self.share, self.kmax or largest(counts)))


@dataclass(frozen=True)
class NegativeBinomialProvider:
    dig: DataFrame
    n_samples: int

    def estimate(self, counts: DataFrame | None) -> Background:
        most = None if counts is None else counts.agg(F.max("c")).first()[0]
        return Background(counts, negative_binomial(self.dig, self.n_samples, most))


@dataclass(frozen=True)
class TableProvider:
    pmfs: DataFrame

    def estimate(self, counts: DataFrame | None) -> Background:
        return Background(counts, self.pmfs)


_PROVIDERS: dict[str, Callable[..., Provider]] = {"poisson": PoissonProvider, "negative_binomial": NegativeBinomialProvider, "table": TableProvider}


def available() -> list[str]:
    return sorted(_PROVIDERS)


def provider(name: str, **options: object) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"no background provider {name!r}; there are {', '.join(available())}")
    return _PROVIDERS[name](**options)
