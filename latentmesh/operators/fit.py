"""Latent-event rates of features and of pairs of features.

The samples enter only through how many have each count (features) or each pair
of counts (pairs), so what is fitted is as large as the number of features or
pairs, not of samples; zero cells come from margins by subtraction.

Backgrounds may differ between classes of samples (``classes``, a table of
``sample, class``, and distributions by ``feature, class``); histograms are then
those of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import em, special


def _sizes(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("size"))


def histogram(counts: DataFrame, n: Column, classes: DataFrame | None = None) -> DataFrame:
    """``feature, c, n``: how many samples have each count, 0 among them; with ``classes``, ``feature, class, c, n``."""
    none = F.lit(0).cast("long").alias("c")
    if classes is None:
        cells = counts.groupBy("feature", F.col("c").cast("long").alias("c")).agg(F.count("*").alias("n"))
        zero = cells.groupBy("feature").agg((n - F.sum("n")).cast("long").alias("n")).select("feature", none, "n")
    else:
        cells = counts.join(classes, "sample").groupBy("feature", "class", F.col("c").cast("long").alias("c")).agg(F.count("*").alias("n"))
        seen = cells.groupBy("feature", "class").agg(F.sum("n").alias("s"))
        every = counts.select("feature").distinct().crossJoin(_sizes(classes))  # as many rows as features times classes
        zero = every.join(seen, ["feature", "class"], "left").select("feature", "class", none, (F.col("size") - F.coalesce("s", F.lit(0))).alias("n"))
    return cells.unionByName(zero).where("n > 0")


def with_pmfs(histograms: DataFrame, pmfs: DataFrame) -> DataFrame:
    """Cells with P(c), P(c - 1) and whether the count has support; features without a background are left out."""
    keys = ["feature", "class"] if "class" in pmfs.columns else ["feature"]
    joined = histograms.join(pmfs.select(*keys, "pmf"), keys)
    return joined.select(*keys, "c", "n", special.as_count(F.col("pmf"), F.col("c")).alias("here"), special.as_shifted(F.col("pmf"), F.col("c")).alias("below"), (special.in_support(F.col("pmf"), F.col("c")) > 0).alias("support"))


def missing_background(totals: DataFrame, pmfs: DataFrame) -> DataFrame:
    return totals.join(pmfs, "feature", "left_anti")


def fit_rates(cells: DataFrame, n_inits: int = 10, seed: int = 0, max_iter: int = 1000, tol: float = em.TOLERANCE) -> DataFrame:
    """``feature, pi, inits_used, status``; pi is null where it can't be fitted."""
    starts = special.restarts(n_inits, seed)[0]
    rows = cells.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("c", "n", "here", "below", "support"))).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, here, below, support = (em.padded([np.array([x[k] for x in r], float) for r in frame["cells"]]) for k in ("n", "here", "below", "support"))
            pi, used, failed = em.fit_pi(n, here, below, support > 0, starts, max_iter, tol)
            yield pd.DataFrame({"feature": frame["feature"], "pi": np.where(failed, None, pi), "inits_used": used, "status": np.where(failed, "failed", "ok")})

    return rows.mapInPandas(run, "feature string, pi double, inits_used int, status string")


def maximise_rates(cells: DataFrame, halvings: int = 60) -> DataFrame:
    """``feature, pi``: the rate of the greatest likelihood, which has one peak, by bisection of its slope over [0, 1)."""
    rows = cells.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("c", "n", "here", "below"))).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, here, below = (em.padded([np.array([x[k] for x in r], float) for r in frame["cells"]]) for k in ("n", "here", "below"))
            here = np.where(n > 0, here, 1.0)
            low, high = np.zeros(len(n)), np.full(len(n), 1 - 1e-9)
            for _ in range(halvings):
                p = ((low + high) / 2)[:, None]
                up = (n * (below - here) / np.maximum(here * (1 - p) + below * p, 1e-300)).sum(1) > 0
                low, high = np.where(up, p[:, 0], low), np.where(up, high, p[:, 0])
            yield pd.DataFrame({"feature": frame["feature"], "pi": (low + high) / 2})

    return rows.mapInPandas(run, "feature string, pi double")


def maximise_pairs(cells: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Joint rates of the greatest likelihood: the fit from the even start, carried on to a tight tolerance."""
    return fit_pairs(cells, rates, n_inits=1, max_iter=20_000, tol=1e-10)


def loglik(cells: DataFrame, pi: Column) -> DataFrame:
    """``feature, loglik`` for a rate that may be a column of ``cells``."""
    mixed = F.greatest(F.col("here") * (1 - pi) + F.col("below") * pi, F.lit(1e-300))
    return cells.groupBy("feature").agg(F.sum(F.col("n") * F.ln(mixed)).alias("loglik"))


def feature_statistics(cells: DataFrame, rates: DataFrame, totals: DataFrame, expected: DataFrame) -> DataFrame:
    """The table of features: rate, log odds, likelihood ratio, observed and expected counts."""
    joined = cells.join(rates.select("feature", "pi"), "feature")
    mixed = lambda p: F.ln(F.greatest(F.col("here") * (1 - p) + F.col("below") * p, F.lit(1e-300)))
    ratio = joined.groupBy("feature", "pi").agg((-2 * (F.sum(F.col("n") * mixed(F.lit(0.0))) - F.sum(F.col("n") * mixed(F.col("pi"))))).alias("lrt"))
    odds = F.when((F.col("pi") > 0) & (F.col("pi") < 1), F.ln(F.col("pi") / (1 - F.col("pi"))))
    return ratio.join(totals, "feature").join(expected, "feature").select("feature", "pi", odds.alias("lor"), "lrt", F.col("total").alias("observed"), "expected", (F.col("total") - F.col("expected")).alias("excess"))


def resumed(cells: DataFrame, before: DataFrame | None, **options: object) -> DataFrame:
    """Rates of all features, those that ``before`` has from there and only the others fitted."""
    if before is None:
        return fit_rates(cells, **options)
    known = before.where("pi is not null").select("feature", "pi", F.lit(0).alias("inits_used"), F.lit("resumed").alias("status"))
    rest = fit_rates(cells.join(known, "feature", "left_anti"), **options)
    return rest.unionByName(known.join(cells.select("feature").distinct(), "feature", "left_semi"))


def joint_counts(counts: DataFrame, top: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``a, b, ca, cb, n`` of the samples that have both features, a ranked before b: a join on the sample alone.

    With ``classes`` there is a column ``class`` too.  Until they are counted,
    features go by their ranks, which are shorter than names.
    """
    narrow = counts.join(top.select("feature", "rk"), "feature").select("sample", "rk", F.col("c").cast("long").alias("c"))
    x, y = (narrow if classes is None else narrow.join(classes, "sample")).alias("x"), narrow.alias("y")
    both = x.join(y, (F.col("x.sample") == F.col("y.sample")) & (F.col("x.rk") < F.col("y.rk")))
    by = [] if classes is None else [F.col("x.class").alias("class")]
    cells = both.groupBy(F.col("x.rk").alias("rk_a"), F.col("y.rk").alias("rk_b"), *by, F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).agg(F.count("*").alias("n"))
    for s in "ab":
        cells = cells.join(top.select(F.col("rk").alias(f"rk_{s}"), F.col("feature").alias(s)), f"rk_{s}")
    return cells.select("a", "b", *(["class"] if by else []), "ca", "cb", "n")


def pairs_of(top: DataFrame) -> DataFrame:
    """``a, b`` of all pairs of the few ranked features."""
    x, y = top.alias("x"), top.alias("y")
    return x.join(y, F.col("x.rk") < F.col("y.rk")).select(F.col("x.feature").alias("a"), F.col("y.feature").alias("b"), F.col("x.rk").alias("rk_a"), F.col("y.rk").alias("rk_b"))


def pairs_with(feature: str, ranked: DataFrame) -> DataFrame:
    """``a, b`` of one feature with each other one; a has the higher rank."""
    one = F.broadcast(ranked.where(F.col("feature") == feature).select(F.col("feature").alias("f"), F.col("rk").alias("r")))  # one row is broadcast
    other = ranked.crossJoin(one).where("feature <> f")
    return other.select(F.when(F.col("r") < F.col("rk"), F.col("f")).otherwise(F.col("feature")).alias("a"), F.when(F.col("r") < F.col("rk"), F.col("feature")).otherwise(F.col("f")).alias("b"))


def pair_histogram(joint: DataFrame, counts: DataFrame, top: DataFrame, n: Column, classes: DataFrame | None = None) -> DataFrame:
    """``a, b, ca, cb, n`` of every pair of counts, the cells with zeros from the margins; by ``class`` with ``classes``."""
    by = [] if classes is None else ["class"]
    pairs = pairs_of(top).select("a", "b")
    held = counts.join(top.select("feature"), "feature")
    single = (held if classes is None else held.join(classes, "sample")).groupBy("feature", *by, F.col("c").cast("long").alias("c")).agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")

    def only(side: str, other: str) -> DataFrame:
        seen = joint.groupBy("a", "b", *by, F.col(f"c{side}").alias("c")).agg(F.sum("n").alias("seen"))
        rest = pairs.join(single.withColumnRenamed("feature", side), side).join(seen, ["a", "b", *by, "c"], "left")
        n_rest = (F.col("m") - F.coalesce("seen", zero)).alias("n")
        return rest.select("a", "b", *by, F.col("c").alias(f"c{side}"), zero.alias(f"c{other}"), n_rest)

    some = joint.unionByName(only("a", "b")).unionByName(only("b", "a"))
    every = pairs.withColumn("size", n) if classes is None else pairs.crossJoin(_sizes(classes))  # as many rows as pairs times classes
    none = every.join(some.groupBy("a", "b", *by).agg(F.sum("n").alias("s")), ["a", "b", *by], "left").select("a", "b", *by, zero.alias("ca"), zero.alias("cb"), (F.col("size") - F.coalesce("s", zero)).cast("long").alias("n"))
    return some.unionByName(none).where("n > 0")


def contingency(joint: DataFrame, counts: DataFrame, top: DataFrame, n: Column) -> DataFrame:
    """``a, b, n11, n10, n01, n00``: samples with both, only a, only b, neither."""
    hits = counts.join(top.select("feature"), "feature").groupBy("feature").agg(F.count("*").alias("m"))
    both = joint.groupBy("a", "b").agg(F.sum("n").alias("n11"))
    whole = pairs_of(top).join(hits.select(F.col("feature").alias("a"), F.col("m").alias("ma")), "a").join(hits.select(F.col("feature").alias("b"), F.col("m").alias("mb")), "b").join(both, ["a", "b"], "left").na.fill(0, ["n11"])
    return whole.select("a", "b", "n11", (F.col("ma") - F.col("n11")).alias("n10"), (F.col("mb") - F.col("n11")).alias("n01"), (n - F.col("ma") - F.col("mb") + F.col("n11")).cast("long").alias("n00"))


def cooccurring_rows(counts: DataFrame, top: DataFrame) -> DataFrame:
    """``a, b, sample`` of the samples with both, one row each, for pairs that very many share."""
    narrow = counts.join(top.select("feature", "rk"), "feature").select("sample", "feature", "rk")
    x, y = narrow.alias("x"), narrow.alias("y")
    return x.join(y, (F.col("x.sample") == F.col("y.sample")) & (F.col("x.rk") < F.col("y.rk"))).select(F.col("x.feature").alias("a"), F.col("y.feature").alias("b"), F.col("x.sample").alias("sample"))


def cooccurring(counts: DataFrame, top: DataFrame) -> DataFrame:
    """``a, b, samples``: the samples with both, in order; a pair's samples are one row, so this is for reports."""
    return cooccurring_rows(counts, top).groupBy("a", "b").agg(F.array_sort(F.collect_list("sample")).alias("samples"))


def pair_cells(histogram: DataFrame, pmfs: DataFrame) -> DataFrame:
    """Cells of pairs with the probabilities of both counts: with the floor (a0, a1, b0, b1) and without (pa0 ...)."""
    by = ["class"] if "class" in pmfs.columns else []
    p = pmfs.select("feature", *by, "pmf")
    side = lambda x: p.withColumnsRenamed({"feature": x, "pmf": f"pmf_{x}"})
    joined = histogram.join(side("a"), ["a", *by]).join(side("b"), ["b", *by])
    out = {"n": F.col("n")}
    for s in "ab":
        pmf, c = F.col(f"pmf_{s}"), F.col(f"c{s}")
        out |= {f"{s}0": special.as_count(pmf, c), f"{s}1": special.as_shifted(pmf, c), f"p{s}0": special.in_support(pmf, c), f"p{s}1": special.in_support(pmf, c - 1)}
    return joined.select("a", "b", "ca", "cb", *[v.alias(k) for k, v in out.items()])


_CELLS = ("n", "a0", "a1", "b0", "b1", "pa0", "pa1", "pb0", "pb1")


def fit_pairs(cells: DataFrame, rates: DataFrame | None = None, n_inits: int = 10, seed: int = 0, max_iter: int = 1000, tol: float = em.TOLERANCE) -> DataFrame:
    """``a, b, t00, t01, t10, t11, ll, ll_null, inits_used, status`` of every pair.

    A pair whose fit isn't a distribution gets the product of its features'
    rates and the status ``independent``.
    """
    starts = special.restarts(n_inits, seed)[1]
    rows = cells.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("ca", "cb", *_CELLS))).alias("cells"))
    if rates is not None:
        for s in "ab":
            rows = rows.join(rates.select(F.col("feature").alias(s), F.col("pi").alias(f"pi_{s}")), s, "left")
    else:
        rows = rows.withColumns({"pi_a": F.lit(None).cast("double"), "pi_b": F.lit(None).cast("double")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, a0, a1, b0, b1, pa0, pa1, pb0, pb1 = (em.padded([np.array([x[k] for x in r], float) for r in frame["cells"]]) for k in _CELLS)
            tau, used, failed = em.fit_tau(n, (a0, a1), (b0, b1), (pa0, pa1), (pb0, pb1), starts, max_iter, tol)
            x, y = (frame[c].to_numpy(float) for c in ("pi_a", "pi_b"))
            tau[failed] = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y], axis=1)[failed]
            x, y = tau[:, 2] + tau[:, 3], tau[:, 1] + tau[:, 3]
            null = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y], axis=1)
            ll, ll_null = (em.pair_loglik(n, (a0, a1), (b0, b1), t) for t in (tau, null))
            clean = lambda v: [None if q != q else q for q in v]
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], **{f"t{k}": clean(tau[:, i]) for i, k in enumerate(("00", "01", "10", "11"))}, "ll": clean(ll), "ll_null": clean(ll_null), "inits_used": used, "status": np.where(failed, "independent", "ok")})

    return rows.mapInPandas(run, "a string, b string, t00 double, t01 double, t10 double, t11 double, ll double, ll_null double, inits_used int, status string")


def pair_name(a: Column, b: Column) -> Column:
    """A pair as one name, both features around a colon."""
    return F.concat_ws(":", a, b)


def pair_ends(name: Column) -> list[Column]:
    """Both features of a pair's name."""
    parts = F.split(name, ":")
    return [F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b")]


def marginal_rates(pairs: DataFrame, feature: str) -> DataFrame:
    """``partner, rate``: the feature's own rate, with or without the other, as each of its pairs has it."""
    mine = F.when(F.col("a") == feature, F.struct(F.col("b").alias("partner"), (F.col("t10") + F.col("t11")).alias("rate"))).when(F.col("b") == feature, F.struct(F.col("a").alias("partner"), (F.col("t01") + F.col("t11")).alias("rate")))
    return pairs.select(mine.alias("x")).where("x is not null").select("x.partner", "x.rate")


def log_odds() -> Column:
    return F.when((F.col("t01") * F.col("t10") > 0) & (F.col("t00") * F.col("t11") > 0), F.ln(F.col("t01") * F.col("t10") / (F.col("t00") * F.col("t11"))))


def wald() -> Column:
    positive = (F.col("t00") > 0) & (F.col("t01") > 0) & (F.col("t10") > 0) & (F.col("t11") > 0)
    return F.when(positive, log_odds() / F.sqrt(1 / F.col("t00") + 1 / F.col("t01") + 1 / F.col("t10") + 1 / F.col("t11")))


def rho() -> Column:
    t00, t01, t10, t11 = (F.col(f"t{k}") for k in ("00", "01", "10", "11"))
    margins = (t00 + t01) * (t10 + t11) * (t00 + t10) * (t01 + t11)
    return F.when(margins > 0, (t11 * t00 - t01 * t10) / F.sqrt(margins))


def pair_statistics(fits: DataFrame, tables: DataFrame) -> DataFrame:
    """The table of pairs: joint rates, margins, rho, log odds, likelihood ratio, Wald statistic and contingency table."""
    t1x, tx1 = F.col("t10") + F.col("t11"), F.col("t01") + F.col("t11")
    return fits.join(tables, ["a", "b"]).select("a", "b", "t00", "t10", "t01", "t11", "n11", "n10", "n01", "n00", t1x.alias("t1x"), tx1.alias("tx1"), rho().alias("rho"), log_odds().alias("lor"), (-2 * (F.col("ll_null") - F.col("ll"))).alias("lrt"), wald().alias("wald"), "status")


def named_single(stats: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """The columns of the written table of features; selection statistics, ``feature, phi, p``, must be there for all."""
    if selection is None:
        joined = stats.withColumn("p", F.lit(None).cast("double"))
    else:
        joined = stats.join(selection, "feature", "left").withColumn("p", F.when(F.col("phi").isNull() & F.col("p").isNull(), F.raise_error(F.concat(F.lit("no selection statistics for "), F.col("feature"))).cast("double")).otherwise(F.col("p")))
    names = {"feature": "Gene Name", "pi": "Pi", "lor": "Log Odds Ratio", "lrt": "Likelihood Ratio", "observed": "Observed Mutations", "expected": "Expected Mutations", "excess": "Obs. - Exp. Mutations", "phi": "CBaSE Pos. Sel. Phi", "p": "CBaSE Pos. Sel. P-Val"}
    return joined.select(*[F.col(c).alias(to) for c, to in names.items() if c in joined.columns])


def named_pairs(stats: DataFrame) -> DataFrame:
    """The columns of the written table of pairs; its ``_xy_`` columns count samples the other way round than tau does."""
    names = {"a": "Gene A", "b": "Gene B", "t00": "Tau_00", "t10": "Tau_10", "t01": "Tau_01", "t11": "Tau_11", "n11": "_00_", "n01": "_10_", "n10": "_01_", "n00": "_11_", "t1x": "Tau_1X", "tx1": "Tau_X1", "rho": "Rho", "lor": "Log Odds Ratio", "lrt": "Likelihood Ratio", "wald": "Wald Statistic"}
    return stats.select(*[F.col(c).alias(to) for c, to in names.items()])
