"""Evaluation against known interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import fit
from .calls import METHODS, method_tables


def labels(pairs: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``pairs`` with label 1 where the pair, in either orientation, is in ``truth``."""
    known = truth.select(*by, F.array_sort(F.array("a", "b")).alias("key"), F.lit(1).alias("label")).distinct()
    return pairs.withColumn("key", F.array_sort(F.array("a", "b"))).join(known, [*by, "key"], "left").drop("key").na.fill(0, ["label"])


def scores(pairs: DataFrame, direction: str, eps: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """``a, b, method, score`` with larger scores for what is more of the direction; 0 for a pair with a rate below the threshold."""
    sign = -1 if direction == "ME" else 1
    masked = (F.col("t1x") < eps) | (F.col("tx1") < eps)
    toward = F.when(F.col("rho") * sign > 0, F.col("lrt")).otherwise(0.0)
    each = {"rho": sign * F.col("rho"), "lrt": toward, "lor": -sign * F.col("lor"), "wald": -sign * F.col("wald")}
    rows = F.array(*[F.struct(F.lit(k).alias("method"), F.when(masked, 0.0).otherwise(F.coalesce(v, F.lit(0.0))).alias("score")) for k, v in each.items()])
    return pairs.select(*by, "a", "b", F.inline(rows))


def p_scores(p: Column) -> Column:
    return -F.log10(p + 1e-300)


def all_scores(table: DataFrame, direction: str, eps: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """``a, b, method, score`` of the fitted rates and of every other test that the table has columns of."""
    tests = {name: m for name, m in METHODS[direction].items() if not m.fitted and m.column in table.columns}
    others = {name: p_scores(F.col(m.column)) if m.ascending else F.col(m.column) for name, m in tests.items()}
    found = scores(table, direction, eps, by)
    if not others:
        return found
    rows = F.array(*[F.struct(F.lit(k).alias("method"), v.cast("double").alias("score")) for k, v in others.items()])
    return found.unionByName(table.select(*by, "a", "b", F.inline(rows)))


def precision_recall(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """``recall, precision`` at every threshold, from the highest score down, begun at a recall of 0 with precision 1."""
    at = scored.groupBy(*by, "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    tp, called, positives = F.sum("hits").over(down), F.sum("n").over(down), F.sum("hits").over(Window.partitionBy(*by))
    points = at.select(*by, F.try_divide(tp.cast("double"), positives.cast("double")).alias("recall"), (tp / called).alias("precision")).where("recall is not null")
    start = points.select(*by).distinct().select(*by, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return start.unionByName(points)


def hit_curve(ranked: DataFrame, truth: DataFrame, k: int, runs: int, by: Sequence[str] = ("method",)) -> DataFrame:
    """``rk, hits``: how many true pairs, on average over runs, are among the first 1..k of ``a, b, rk, run``; ``truth`` is ``run, a, b``."""
    known = truth.select("run", F.array_sort(F.array("a", "b")).alias("key"), F.lit(1).alias("hit")).distinct()
    hits = ranked.where(F.col("rk") <= k).withColumn("key", F.array_sort(F.array("a", "b"))).join(known, ["run", "key"], "left")
    each = hits.groupBy(*by, "rk").agg((F.sum(F.coalesce("hit", F.lit(0))) / runs).alias("new"))
    return each.select(*by, "rk", F.sum("new").over(Window.partitionBy(*by).orderBy("rk")).alias("hits"))


def average_precision(scored: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Sum over thresholds of the gain in recall times the precision; tied scores are one threshold."""
    at = scored.groupBy(*by, "score").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    curve = at.select(*by, "hits", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("called"), F.sum("hits").over(whole).alias("positives"))
    return curve.groupBy(*by).agg(F.coalesce(F.sum(F.try_divide(F.col("hits"), F.col("positives")) * F.col("tp") / F.col("called")), F.lit(0.0)).alias("average_precision"))


def recall_at(ranked: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """``rk, recall`` of the first 1..k rows that carry a label."""
    so_far = Window.partitionBy(*by).orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumns({"tp": F.sum("label").over(so_far), "all": F.sum("label").over(Window.partitionBy(*by))}).where(F.col("rk") <= k).select(*by, "rk", F.try_divide(F.col("tp").cast("double"), F.col("all").cast("double")).alias("recall"))


def mean_curve(curves: DataFrame, points: int = 10_001) -> DataFrame:
    """``method, recall, mean, sd`` of precision over runs, each interpolated on a common grid."""
    order = Window.partitionBy("method", "run").orderBy("recall")
    steps = curves.groupBy("method", "run", "recall").agg(F.max("precision").alias("precision")).withColumns({"to": F.lead("recall").over(order), "next": F.lead("precision").over(order)})
    n = points - 1
    grid = steps.where("`to` > recall").select("method", "run", "recall", "precision", "to", "next", F.explode(F.sequence(F.ceil(F.col("recall") * n), F.floor(F.col("to") * n))).alias("i"))
    value = F.col("precision") + (F.col("next") - F.col("precision")) * (F.col("i") / n - F.col("recall")) / (F.col("to") - F.col("recall"))
    once = grid.groupBy("method", "run", "i").agg(F.max(value).alias("precision"))
    return once.groupBy("method", (F.col("i") / n).alias("recall")).agg(F.avg("precision").alias("mean"), F.stddev_pop("precision").alias("sd"))


def matrix_report(table: DataFrame, planted: DataFrame, direction: str, k: int = 1000) -> dict[str, DataFrame]:
    """Precision and recall of every method over runs, from ``run, num_samples`` and the methods' columns, and ``run, direction, a, b``."""
    truth = planted.where(F.col("direction") == direction)
    eps = special.epsilon_column(F.col("num_samples").cast("double"))
    by_run = all_scores(table, direction, eps, ["run"])
    labelled = labels(by_run, truth.select("run", "a", "b"), ["run"])
    present = [n for n, m in METHODS[direction].items() if m.column in table.columns]
    runs = max(1, planted.select("run").distinct().count())
    ranked = method_tables(table, direction, eps, k, methods=present, by=["run"])
    return {
        "average_precision": average_precision(labelled),
        "pr_curve": precision_recall(labelled),
        "mean_pr_curve": mean_curve(precision_recall(labelled, ["method", "run"])),
        "hits": hit_curve(ranked, truth.select("run", "a", "b"), k, runs),
    }


def error_summary(fits: DataFrame, truth: Column) -> DataFrame:
    """Mean, population standard deviation and mean absolute error of fitted rates over simulations."""
    return fits.agg(F.avg("pi").alias("mean"), F.stddev_pop("pi").alias("sd"), F.avg(F.abs(F.col("pi") - truth)).alias("error"))


def simulated_features(drawn: DataFrame, pmf: list[float], samples: int) -> DataFrame:
    """``feature, pi``: the rate fitted to each simulation of ``sim, sample, c``, all in one plan."""
    counts = drawn.where("c > 0").select("sample", F.col("sim").cast("string").alias("feature"), "c")
    pmfs = drawn.select(F.col("sim").cast("string").alias("feature")).distinct().withColumn("pmf", F.array(*map(F.lit, pmf)))
    return fit.fit_rates(fit.with_pmfs(fit.histogram(counts, F.lit(samples)), pmfs))


def simulated_pairs(drawn: DataFrame, pmf_a: list[float], pmf_b: list[float]) -> DataFrame:
    """Joint rates fitted to each simulation of ``sim, sample, ca, cb``; a and b name the simulation."""
    cells = drawn.groupBy(F.concat(F.lit("a"), F.col("sim")).alias("a"), F.concat(F.lit("b"), F.col("sim")).alias("b"), F.col("ca").cast("long").alias("ca"), F.col("cb").cast("long").alias("cb")).agg(F.count("*").alias("n"))
    pmfs = cells.select(F.col("a").alias("feature"), F.array(*map(F.lit, pmf_a)).alias("pmf")).union(cells.select("b", F.array(*map(F.lit, pmf_b)))).distinct()
    return fit.fit_pairs(fit.pair_cells(cells, pmfs))


def joint_error(fits: DataFrame, tau: tuple[float, float, float, float]) -> DataFrame:
    """Mean, population standard deviation and mean absolute error of each joint rate over simulations."""
    names = ("t00", "t01", "t10", "t11")
    rows = F.array(*[F.struct(F.lit(n).alias("rate"), F.col(n).alias("fitted"), F.lit(t).alias("truth")) for n, t in zip(names, tau)])
    return fits.select(F.inline(rows)).groupBy("rate").agg(F.avg("fitted").alias("mean"), F.stddev_pop("fitted").alias("sd"), F.avg(F.abs(F.col("fitted") - F.col("truth"))).alias("error"))


def profile(cells: DataFrame, points: int = 100, top: float = 0.99) -> DataFrame:
    """``feature, pi, loglik`` over a grid of rates: cells are few, so the grid is their product with a range."""
    grid = cells.sparkSession.range(points).select((F.col("id") * F.lit(top / (points - 1))).alias("pi"))
    mixed = F.greatest(F.col("here") * (1 - F.col("pi")) + F.col("below") * F.col("pi"), F.lit(1e-300))
    return cells.crossJoin(F.broadcast(grid)).groupBy("feature", "pi").agg(F.sum(F.col("n") * F.ln(mixed)).alias("loglik"))  # the grid has `points` rows


def turns(profiles: DataFrame) -> DataFrame:
    """How often the slope of each profile changes its sign; a likelihood with one peak has at most one."""
    order = Window.partitionBy("feature").orderBy("pi")
    slopes = profiles.withColumn("slope", F.signum(F.col("loglik") - F.lag("loglik").over(order)))
    return slopes.withColumn("turn", (F.col("slope") != F.lag("slope").over(order)).cast("int")).groupBy("feature").agg(F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"))
