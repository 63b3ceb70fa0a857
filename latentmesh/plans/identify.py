"""The analyses end to end: from counts and backgrounds to tables of features and pairs, and the comparison of methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import background, baselines, calls, counts, fit
from ..sources.staging import staged


@dataclass(frozen=True)
class Cohort:
    """Counts above 0, their samples and the backgrounds; all lazy.

    ``order`` has the place of each feature, ``feature, ord``, by which features
    of equal totals are ranked; without it they are ranked by name.  ``classes``
    has the class of each sample where the backgrounds are those of classes.
    """

    counts: DataFrame
    pmfs: DataFrame | None = None
    all_samples: DataFrame | None = None
    order: DataFrame | None = None
    classes: DataFrame | None = None

    @property
    def samples(self) -> DataFrame:
        return self.counts.select("sample").distinct() if self.all_samples is None else self.all_samples

    def size(self) -> int:
        return self.samples.count()

    def top(self, k: int, known: DataFrame | None = None) -> DataFrame:
        """The ``k`` features with the most events, of those that are ``known``."""
        sums = counts.totals(self.counts)
        sums = sums if known is None else sums.join(known, "feature", "left_semi")
        return counts.top(sums, k) if self.order is None else counts.top(sums.join(self.order, "feature"), k, ties="ord").drop("ord")


@dataclass(frozen=True)
class Results:
    features: DataFrame
    pairs: DataFrame


def features(cohort: Cohort, n: int, before: DataFrame | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """Rates and statistics of every feature that has a background."""
    cells = fit.with_pmfs(fit.histogram(cohort.counts, F.lit(n), cohort.classes), cohort.pmfs)
    rates = staged(fit.resumed(cells, before, **options), "rates")
    return rates, fit.feature_statistics(cells, rates, counts.totals(cohort.counts), background.expected(cohort.pmfs, cohort.classes))


def pairs(cohort: Cohort, top: DataFrame, n: int, rates: DataFrame | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """Fits and contingency tables of all pairs of the ranked features."""
    joint = staged(fit.joint_counts(cohort.counts, top, cohort.classes), "joint")
    tables = fit.contingency(joint, cohort.counts, top, F.lit(n))
    cells = fit.pair_cells(fit.pair_histogram(joint, cohort.counts, top, F.lit(n), cohort.classes), cohort.pmfs)
    return fit.fit_pairs(cells, rates, **options), tables


def identify(cohort: Cohort, top_k: int = 100, before: DataFrame | None = None, **options: object) -> Results:
    """All features and the pairs of the ``top_k`` with the most events."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    if cohort.pmfs is None:
        raise ValueError("the cohort has no background")
    if ("class" in cohort.pmfs.columns) != (cohort.classes is not None):
        raise ValueError("backgrounds of classes need the classes of the samples, and the other way round")
    n = cohort.size()
    rates, single = features(cohort, n, before, **options)
    top = staged(cohort.top(top_k, cohort.pmfs.select("feature")), "top")
    fits, tables = pairs(cohort, top, n, rates, **options)
    return Results(single, fit.pair_statistics(fits, tables))


def compare(cohort: Cohort, top_k: int = 100) -> tuple[DataFrame, dict[str, str]]:
    """The other tests of the pairs of the ``top_k`` features, side by side."""
    n = cohort.size()
    top = staged(cohort.top(top_k), "top")
    joint = staged(fit.joint_counts(cohort.counts, top), "joint")
    tables = staged(fit.contingency(joint, cohort.counts, top, F.lit(n)), "tables")
    sums = cohort.counts.groupBy("sample").agg(F.count("*").alias("sample_sum")).groupBy("sample_sum").agg(F.count("*").alias("n"))
    return baselines.compare({
        "fisher": lambda: calls.fisher(tables),
        "overlap": lambda: baselines.overlap_by_margins(tables, staged(counts.sample_sums(cohort.counts, top), "sums")),
        "ratio": lambda: baselines.exclusivity_test(tables),
        "weighted": lambda: baselines.weighted_test(tables, sums),
    })
