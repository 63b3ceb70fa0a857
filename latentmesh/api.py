"""The verbs: estimate a background, identify interactions, compare methods, merge results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import background, calls, evaluation, fit
from .plans.identify import Cohort, Results, compare, identify
from .sources import files

TOP_K = 100


def estimate_background(counts: DataFrame | None, name: str = "poisson", **options: object) -> background.Background:
    return background.provider(name, **options).estimate(counts)


def load_cohort(spark: SparkSession, counts: str, pmfs: str) -> Cohort:
    files.require(spark, counts, pmfs)
    long, samples, order = files.read_counts(spark, counts)
    return Cohort(long, files.read_pmfs(spark, pmfs), samples, order)


def identify_interactions(spark: SparkSession, counts: str, pmfs: str, out: str | None = None, top_k: int = TOP_K, selection: str | None = None) -> Results:
    """The tables of features and pairs; written below ``out`` if it is given."""
    found = identify(load_cohort(spark, counts, pmfs), top_k)
    stats = files.read_selection(spark, selection) if selection else None
    if out:
        files.write_csv(fit.named_single(found.features, stats), f"{out}/single_gene_results")
        files.write_csv(fit.named_pairs(found.pairs), f"{out}/pairwise_interaction_results")
    return found


def compare_methods(spark: SparkSession, counts: str, out: str | None = None, top_k: int = TOP_K, gene_level: bool = False) -> DataFrame:
    long, samples, order = files.read_counts(spark, counts)
    table, wrong = compare(Cohort(long, None, samples, order), top_k)
    for name, why in wrong.items():
        print(f"{name} failed: {why[:200]}")
    if out:
        files.write_csv(table, f"{out}/{'gene_level_' if gene_level else ''}comparison_interaction_results")
    return table


def merge_results(pairs: DataFrame, comparison: DataFrame, out: str | None = None) -> DataFrame:
    both = calls.merged(pairs, comparison)
    if out:
        files.write_csv(both, f"{out}/complete_pairwise_interaction_results")
    return both


def evaluate_matrix(spark: SparkSession, results: str, direction: str, out: str | None = None, k: int = 1000) -> dict[str, DataFrame]:
    """How well each method finds the pairs planted in the runs ``R1``, ``R2``, ... below ``results``.

    A run has a table of all methods' pairs in ``complete_pairwise_interaction_results``
    and what was planted in ``truth``.  The tables given back, and written below
    ``out``: ``average_precision`` over all runs' pairs, ``pr_curve`` of those,
    ``mean_pr_curve`` over runs, and ``hits`` among the first 1..k.
    """
    planted = files.read_truths(spark, f"{results}/R*/truth")
    samples = planted.select("run", "num_samples").distinct()
    table = files.read_runs(spark, f"{results}/R*/complete_pairwise_interaction_results").join(samples, "run")
    table = table.withColumnsRenamed({"Gene A": "a", "Gene B": "b", "Tau_1X": "t1x", "Tau_X1": "tx1", "Rho": "rho", "Likelihood Ratio": "lrt", "Log Odds Ratio": "lor", "Wald Statistic": "wald"})
    numbers = [c for c in table.columns if c not in ("a", "b", "run", "num_samples")]
    table = table.withColumns({c: F.col(f"`{c}`").cast("double") for c in numbers})
    return report(evaluation.matrix_report(table, planted, direction, k), out)


def report(tables: dict[str, DataFrame], out: str | None) -> dict[str, DataFrame]:
    if out:
        for name, table in tables.items():
            files.write_csv(table, f"{out}/{name}")
    return tables
