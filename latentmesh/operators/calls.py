"""False-discovery control, significance calls, rankings and curves over tables of features and pairs.

Tables of results may hold many cohorts; ``by`` names the columns of a family.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .counts import base_gene

@dataclass(frozen=True)
class Method:
    """The column that a method ranks pairs by and in which direction, and the one that it calls them by below a cutoff."""

    column: str
    ascending: bool
    judged_by: str | None = None
    cutoff: float | None = None
    fitted: bool = False  # by joint rates: only pairs with both rates above the threshold and rho of the right sign
    above: bool = False  # called above its cutoff


#: Methods by direction; columns are those of the table of pairs joined with that of the comparison.  The cutoffs of rho
#: and of the ratio are no constants but come from pairs without interaction, see ``thresholds``.
ME_METHODS = {
    "rho": Method("rho", True, "rho", fitted=True),
    "lrt": Method("lrt", False, fitted=True),
    "lor": Method("lor", False, fitted=True),
    "wald": Method("wald", False, fitted=True),
    "overlap": Method("overlap_me_p", True, "overlap_me_q", 0.01),
    "fisher": Method("fisher_me_p", True, "fisher_me_q", 0.01),
    "ratio": Method("ratio_s", False, "ratio_p", 1e-3),
    "weighted": Method("weighted_me_p", True, "weighted_me_q", 0.01),
}
CO_METHODS = {
    "rho": Method("rho", False, fitted=True),
    "lrt": Method("lrt", False, "lrt", fitted=True, above=True),
    "lor": Method("lor", True, fitted=True),
    "wald": Method("wald", True, fitted=True),
    "overlap": Method("overlap_co_p", True, "overlap_co_q", 0.01),
    "fisher": Method("fisher_co_p", True, "fisher_co_q", 0.01),
    "weighted": Method("weighted_co_p", True, "weighted_co_q", 0.01),
}
METHODS = {"ME": ME_METHODS, "CO": CO_METHODS}


def benjamini_hochberg(df: DataFrame, p: str, q: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with the adjusted value of column ``p`` in ``q``; null p-values are in no family and stay null."""
    tested = F.when(F.col(p).isNotNull(), 1)
    family = [*by, F.col(p).isNull()]
    up = Window.partitionBy(*family).orderBy(p, *ties)
    down = Window.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumns({"_rank": F.row_number().over(up), "_tests": F.sum(tested).over(Window.partitionBy(*family))})
    least = F.min(F.col(p) * F.col("_tests") / F.col("_rank")).over(down)
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_rank", "_tests")


def fisher(tables: DataFrame) -> DataFrame:
    """Exact one-sided p-values of every pair for exclusion (fewer together) and for co-occurrence, with q-values."""
    cells = [F.col(c).cast("long") for c in ("n11", "n10", "n01", "n00")]
    tested = tables.select("a", "b", special.hypergeometric_tail(*cells, less=True).alias("me_p"), special.hypergeometric_tail(*cells, less=False).alias("co_p"))
    return benjamini_hochberg(benjamini_hochberg(tested, "me_p", "me_q", ties=["a", "b"]), "co_p", "co_q", ties=["a", "b"])


def pair_calls(pairs: DataFrame, fdr: float = 0.05, suspicious: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """``pairs`` with p, q, whether significant, the direction, and whether a gene is suspicious."""
    p = special.chi2_tail(F.col("lrt"))
    called = benjamini_hochberg(pairs.withColumn("p", p), "p", "q", by, ["a", "b"])
    return called.withColumns({"significant": F.coalesce(F.col("q") < fdr, F.lit(False)), "direction": F.when(F.col("rho") < 0, "ME").otherwise("CO"), "suspicious": base_gene(F.col("a")).isin(*suspicious) | base_gene(F.col("b")).isin(*suspicious) if suspicious else F.lit(False)})


def driver_calls(features: DataFrame, fdr: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    called = benjamini_hochberg(features.withColumn("p", special.chi2_tail(F.col("lrt"))), "p", "q", by, ["feature"])
    return called.withColumn("driver", F.coalesce(F.col("q") < fdr, F.lit(False)))


def call_summary(called: DataFrame, by: Sequence[str]) -> DataFrame:
    """By group: pairs, significant ones, their directions, and the suspicious share of them."""
    hit = F.col("significant")
    share = F.avg(F.when(hit, F.col("suspicious").cast("double")))
    count = lambda c: F.count_if(c)
    return called.groupBy(*by).agg(F.count("*").alias("pairs"), count(hit).alias("significant"), count(hit & (F.col("direction") == "ME")).alias("me"), count(hit & (F.col("direction") == "CO")).alias("co"), F.round(F.coalesce(share, F.lit(0.0)), 3).alias("suspicious"))


def both_active(pairs: DataFrame, eps: Column | float) -> DataFrame:
    """Pairs whose marginal rates are both above the threshold."""
    return pairs.where((F.col("t1x") > eps) & (F.col("tx1") > eps))


def other_genes(pairs: DataFrame) -> DataFrame:
    """Pairs of features of different genes."""
    return pairs.where(base_gene(F.col("a")) != base_gene(F.col("b")))


def rank_pairs(pairs: DataFrame, direction: str, eps: Column | float, by: Sequence[str] = (), exclude_same_gene: bool = True) -> DataFrame:
    """Active pairs of one direction with ``rk`` from 1: exclusion by rho upwards, co-occurrence by the ratio downwards."""
    found = both_active(other_genes(pairs) if exclude_same_gene else pairs, eps)
    found = found.where("rho < 0" if direction == "ME" else "rho > 0")
    order = [F.asc_nulls_last("rho")] if direction == "ME" else [F.desc_nulls_last("lrt")]
    return found.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "a", "b")))


def rank_by(table: DataFrame, direction: str, name: str, eps: Column | float, cutoff: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``table`` in the order of a method: ``a, b, method, value, significant, rk, n_significant``.

    What can't be ranked comes last.  ``cutoff`` replaces the method's own; a
    method that has none calls nothing, and its ``significant`` is null.
    ``n_significant`` counts all pairs that the method ranks, before any is cut.
    """
    m = METHODS[direction][name]
    cutoff = m.cutoff if cutoff is None else cutoff
    found = both_active(table, eps).where("rho < 0" if direction == "ME" else "rho > 0") if m.fitted else table
    if m.judged_by is None or cutoff is None:
        significant = F.lit(None).cast("boolean")
    else:
        judged = F.col(m.judged_by)
        significant = F.coalesce(judged > cutoff if m.above else judged < cutoff, F.lit(False))
    order = [F.asc_nulls_last(m.column) if m.ascending else F.desc_nulls_last(m.column), "a", "b"]
    named = found.select(*by, "a", "b", F.lit(name).alias("method"), F.col(m.column).cast("double").alias("value"), significant.alias("significant"), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rk"))
    return named.withColumn("n_significant", F.when(F.col("significant").isNotNull(), F.sum(F.col("significant").cast("int")).over(Window.partitionBy(*by))))


def method_tables(table: DataFrame, direction: str, eps: Column | float, k: int, cutoffs: Mapping[str, float] | None = None, methods: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` pairs of each method, all in one table."""
    names = [n for n in METHODS[direction] if methods is None or n in methods]
    each = [rank_by(table, direction, n, eps, (cutoffs or {}).get(n), by).where(F.col("rk") <= k) for n in names]
    return reduce(DataFrame.unionByName, each)


def thresholds(null_pairs: DataFrame) -> DataFrame:
    """Cutoffs of each cohort and of all from pairs without interaction: the 0.01 quantile of rho below 0 and the 0.99 quantile of the ratio above."""
    me, co = F.when(F.col("rho") < 0, F.col("rho")), F.when(F.col("rho") > 0, F.col("lrt"))
    return null_pairs.rollup("cohort").agg(F.percentile(me, F.lit(0.01)).alias("me_rho"), F.percentile(co, F.lit(0.99)).alias("co_lrt"), F.grouping("cohort").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("cohort")).alias("cohort"), "me_rho", "co_lrt")


def strictest(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.where("cohort <> 'TOTAL'").agg(F.min("me_rho").alias("me_rho"), F.max("co_lrt").alias("co_lrt"))


def passenger_curve(ranked: DataFrame, passengers: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Among the first 1..k pairs, the share of genes that are passengers; a shorter table goes on with its last value."""
    mark = lambda s: passengers.select(F.col("feature").alias(s), F.lit(1).alias(f"hit_{s}"))
    hits = ranked.where(F.col("rk") <= k).join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    so_far = Window.partitionBy(*by).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce("hit_a", F.lit(0)) + F.coalesce("hit_b", F.lit(0))
    curve = hits.select(*by, "rk", (F.sum(hit).over(so_far) / (2 * F.col("rk"))).alias("share"))
    last = curve.groupBy(*by).agg(F.max("rk").alias("last"), F.max_by("share", "rk").alias("final"))
    grid = last.where(F.col("last") < k).select(*by, F.explode(F.sequence(F.col("last") + 1, F.lit(k))).alias("rk"), F.col("final").alias("share"))
    return curve.unionByName(grid)


def curve_area(curve: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid rule over 1..k divided by k."""
    return curve.groupBy(*by).agg(((F.sum("share") - (F.min_by("share", "rk") + F.max_by("share", "rk")) / 2) / k).alias("auc"))


def largest_of_each(table: DataFrame, k: int, column: str, mark: str) -> DataFrame:
    """The k largest of the marked and of the unmarked rows, put together in order."""
    part = lambda on: table.where(F.col(mark) == on).orderBy(F.desc(column), "feature").limit(k)
    return part(True).unionByName(part(False)).orderBy(F.desc(column), "feature")


def merged(*tables: DataFrame) -> DataFrame:
    """Tables of different methods joined on the pair as it is oriented."""
    first, *rest = tables
    for other in rest:
        first = first.join(other, ["a", "b"])
    return first
