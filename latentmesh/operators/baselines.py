"""Other tests of pairs, from their papers: Poisson-binomial overlap, exclusivity likelihood ratio, weighted permutation, burden regression."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..sources.staging import staged
from .background import max_entropy_of_margins
from .calls import benjamini_hochberg


def _tilted(p: np.ndarray, not_p: np.ndarray, many: np.ndarray, x: int) -> float:
    """P(at least x), x above the mean, of the sum of independent events, ``many`` of each chance; ``not_p`` is 1 - p, given as it may be small.

    Every chance's odds are raised by one factor e^t until the mean is x.  The
    raised sum's probabilities, within twelve deviations of x, come from its
    characteristic function; weighing each back by e^-t(k - x) leaves the tail
    precise however small it is, as its large terms are those near x.

    At an angle the function is at most e^-v(1 - cos), v the raised variance,
    so it is only taken where that is above e^-80: at about 50 angles, or all
    where the deviation is small.  An angle's terms from x on are a geometric
    series.  So neither time nor memory grows with the number of events.
    Likely events are taken by how many don't occur, as sums over most of a
    large number would lose digits.
    """
    n = int(many.sum())
    if x > n - int(many[p <= 0].sum()):
        return 0.0
    log_odds = np.log(p) - np.log(not_p)
    low, high = 0.0, 1.0
    chance = lambda t: np.exp(-np.logaddexp(0, -log_odds - t))
    while (many * chance(high)).sum() < x and high < 700:
        low, high = high, 2 * high
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if (many * chance(t)).sum() < x else (low, t)
    t = (low + high) / 2
    likely = p >= 0.5
    beyond = x - int(many[likely].sum())
    raised = np.where(likely, np.log1p(not_p * np.expm1(-t)), np.log1p(p * np.expm1(t)) if t < 1 else np.logaddexp(0, log_odds + t) + np.log(not_p))
    scale = float((many * raised).sum()) - t * beyond
    q, not_q = chance(t), np.exp(-np.logaddexp(0, log_odds + t))
    variance = float((many * q * not_q).sum())
    reach = 12 * math.sqrt(variance) + 20
    first, last = max(0, int(x - reach)), min(n, int(x + reach))
    size = last - first + 1
    widest = math.acos(max(-1.0, 1 - 80 / variance)) if variance > 40 else math.pi
    angle = 2 * np.pi * np.arange(min(size // 2, int(widest * size / (2 * np.pi))) + 1) / size
    fall = 2 * np.sin(angle / 2) ** 2  # 1 - cos
    with np.errstate(divide="ignore"):  # at half a turn the function can be 0
        height = sum(k / 2 * np.log1p(np.maximum(-2 * c * d * fall, -1)) for c, d, k in zip(q, not_q, many))
    turned = lambda c: np.arctan2(c * np.sin(angle), 1 - c * fall)
    phase = sum(-k * turned(d) if most else k * turned(c) for c, d, k, most in zip(q, not_q, many, likely)) - beyond * angle
    step = -(t + 1j * angle)
    series = np.expm1(step * (last - x + 1)) / np.expm1(step)
    twice = np.where((angle > 0) & (2 * np.arange(len(angle)) < size), 2, 1)  # for the angles below 0
    return float(np.clip(np.exp(scale) * (twice * np.exp(height + 1j * phase) * series).real.sum() / size, 0, 1))


def poisson_binomial(p: np.ndarray, many: np.ndarray, x: int) -> tuple[float, float]:
    """P(at most x) and P(at least x) of the sum of independent events, ``many`` of each chance.

    The tail away from the mean is computed with full relative precision, the
    other one as its complement; the cost is that of the distinct chances,
    whatever the number of events.
    """
    keep = many > 0
    p, many = np.clip(p[keep], 1e-300, 1 - 1e-16), many[keep]
    n, mean = int(many.sum()), float((many * p).sum())
    if x < 0 or x > n:
        return (0.0, 1.0) if x < 0 else (1.0, 0.0)

    def least(x: int) -> float:
        return 1.0 if x <= 0 else _tilted(p, 1 - p, many, x) if x > mean else 1 - most(x - 1)

    def most(x: int) -> float:
        return 1.0 if x >= n else _tilted(1 - p, p, many, n - x) if x < mean else 1 - least(x + 1)

    return most(x), least(x)


def feature_sums(tables: DataFrame) -> DataFrame:
    """``feature_sum, n``: how many features have each number of samples, which the tables of all pairs tell."""
    ends = F.inline(F.array(*[F.struct(F.col(s).alias("feature"), (F.col("n11") + F.col(only)).alias("feature_sum")) for s, only in (("a", "n10"), ("b", "n01"))]))
    return tables.select(ends).distinct().groupBy("feature_sum").agg(F.count("*").alias("n"))


def overlap_test(tables: DataFrame, background: DataFrame, sample_sums: DataFrame) -> DataFrame:
    """``a, b, me_p, co_p`` with q-values, after Canisius et al. (2016): the overlap against chances by both margins.

    ``background`` is ``feature_sum, sample_sum, p``; ``sample_sums`` is
    ``sample_sum, n``, the number of samples of each sum.
    """
    by_sum = background.join(sample_sums, "sample_sum").groupBy("feature_sum").agg(F.array_sort(F.collect_list(F.struct("sample_sum", "p", "n"))).alias("cells"))
    side = lambda s: by_sum.select(F.col("feature_sum").alias(f"m{s}"), F.col("cells").alias(f"cells_{s}"))
    rows = tables.withColumns({"ma": F.col("n11") + F.col("n10"), "mb": F.col("n11") + F.col("n01")}).join(side("a"), "ma").join(side("b"), "mb").select("a", "b", "n11", "cells_a", "cells_b")
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "a", "b")  # else pairs, of few bytes, are all tested in one task

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x, ca, cb in zip(frame["n11"], frame["cells_a"], frame["cells_b"]):
                out.append(poisson_binomial(np.array([u["p"] * v["p"] for u, v in zip(ca, cb)]), np.array([u["n"] for u in ca]), int(x)))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "me_p": [o[0] for o in out], "co_p": [o[1] for o in out]})

    tested = rows.mapInPandas(run, "a string, b string, me_p double, co_p double")
    return benjamini_hochberg(benjamini_hochberg(tested, "me_p", "me_q", ties=["a", "b"]), "co_p", "co_q", ties=["a", "b"])


def overlap_by_margins(tables: DataFrame, sample_sums: DataFrame) -> DataFrame:
    """``overlap_test`` with the chances that the margins of all pairs' written ``tables`` and ``sample_sums`` give."""
    held = sample_sums.where("sample_sum > 0")
    return overlap_test(tables, max_entropy_of_margins(feature_sums(tables), held), held)


def exclusivity_ratio(n11: np.ndarray, n10: np.ndarray, n01: np.ndarray, n00: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Likelihood ratios of mutually exclusive pairs, after Hua et al. (2016).

    A share g of the samples has exactly one of the two events besides
    independent background events; g = 0 is the null hypothesis.
    """
    n11, n10, n01, n00 = (np.asarray(v, float) for v in (n11, n10, n01, n00))
    n = n11 + n10 + n01 + n00

    def loglik(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p11 = g * (a + b) / 2 + (1 - g) * a * b
        p10 = g * (1 - b) / 2 + (1 - g) * a * (1 - b)
        p01 = g * (1 - a) / 2 + (1 - g) * (1 - a) * b
        p00 = (1 - g) * (1 - a) * (1 - b)
        return sum(k * np.log(np.maximum(p, 1e-300)) for k, p in ((n11, p11), (n10, p10), (n01, p01), (n00, p00)))

    pa, pb = (n11 + n10) / n, (n11 + n01) / n
    null = loglik(np.zeros(len(n)), pa, pb)
    g, a, b, best = (n10 + n01) / n, pa / 2, pb / 2, null.copy()
    going = np.ones(len(n), bool)
    for _ in range(steps):  # what covers a sample - a, b or neither - is latent
        p11 = (g * b / 2, g * a / 2, (1 - g) * a * b)
        p10 = (g * (1 - b) / 2, np.zeros(len(n)), (1 - g) * a * (1 - b))
        p01 = (np.zeros(len(n)), g * (1 - a) / 2, (1 - g) * (1 - a) * b)
        share = [[k * q / np.where(sum(p) > 0, sum(p), 1.0) for q in p] for k, p in ((n11, p11), (n10, p10), (n01, p01))]
        by_a, by_b = (sum(s[i] for s in share) for i in (0, 1))
        g = np.where(going, (by_a + by_b) / n, g)
        a = np.where(going, (n11 + n10 - by_a) / np.maximum(n - by_a, 1e-9), a)
        b = np.where(going, (n11 + n01 - by_b) / np.maximum(n - by_b, 1e-9), b)
        now = loglik(g, a, b)
        going &= np.abs(now - best) >= 1e-10
        if not going.any():
            break
        best = np.where(going, now, best)
    return np.maximum(0.0, 2 * (np.maximum(best, null) - null))


def exclusivity_test(tables: DataFrame) -> DataFrame:
    """``a, b, s, p, q`` of every pair; half of chi-squared's tail, as the share is on its boundary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "s": exclusivity_ratio(*(frame[c].to_numpy() for c in ("n11", "n10", "n01", "n00")))})

    ratios = tables.select("a", "b", "n11", "n10", "n01", "n00").mapInPandas(run, "a string, b string, s double")
    return benjamini_hochberg(ratios.withColumn("p", special.chi2_tail(F.col("s")) / 2), "p", "q", ties=["a", "b"])


def weighted_draws(rng: np.random.Generator, weight: np.ndarray, many: np.ndarray, k: int, times: int) -> np.ndarray:
    """How many of each class, (times, classes), are among ``k`` drawn without replacement, one after the other by weight.

    Drawing by weight is taking those whose exponential clocks, of a rate equal
    to the weight, ring first.  So time passes in steps in which the numbers
    that ring are binomial; a step is so short that hardly ever more ring than
    are still wanted.  Where more do, the step is halved until the wanted ones
    are apart from the others.  The last few are drawn one by one.
    """
    taken = np.zeros((times, len(weight)), dtype=np.int64)
    rows = np.arange(times)
    while len(rows):
        left = many - taken[rows]
        want = k - taken[rows].sum(1)
        if want.max(initial=0) <= 0:
            break
        everything, near = left.sum(1) <= want, want <= 32
        taken[rows[everything]] += left[everything]
        few, wanted = np.flatnonzero(near & ~everything), want.copy()
        while (few := few[wanted[few] > 0]).size:
            ahead = np.cumsum(left[few] * weight, axis=1)
            c = (ahead <= rng.random(len(few))[:, None] * ahead[:, -1:]).sum(1)
            left[few, c] -= 1
            taken[rows[few], c] += 1
            wanted[few] -= 1
        near |= everything
        rows, left, want = rows[~near], left[~near], want[~near]
        if not len(rows):
            break
        goal = want - 5 * np.sqrt(want)  # in expectation
        low, high = np.zeros(len(rows)), np.full(len(rows), 1.0)
        ringing = lambda t, left=left: (left * -np.expm1(-weight * t[:, None])).sum(1)
        while (short := ringing(high) < goal).any():
            high[short] *= 2
        for _ in range(50):
            t = (low + high) / 2
            low, high = np.where(ringing(t) < goal, t, low), np.where(ringing(t) < goal, high, t)
        t = (low + high) / 2
        rung = rng.binomial(left, -np.expm1(-weight * t[:, None]))
        over = np.flatnonzero(rung.sum(1) > want)
        rung[over] = _first_of(rng, weight, rung[over], want[over], t[over])
        taken[rows] += rung
    return taken


def _first_of(rng: np.random.Generator, weight: np.ndarray, rung: np.ndarray, want: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of the clocks that rang within ``t``, by class, how many are among the first ``want``."""
    kept, rung, want, t = np.zeros_like(rung), rung.copy(), want.copy(), t.copy()
    while (open_ := np.flatnonzero((want > 0) & (rung.sum(1) > want))).size:
        t[open_] /= 2
        # in the first half of a step, given that they rang within it
        half = rng.binomial(rung[open_], 1 / (1 + np.exp(-weight * t[open_, None])))
        fits = half.sum(1) <= want[open_]
        done, later = open_[fits], open_[~fits]
        kept[done] += half[fits]
        want[done] -= half[fits].sum(1)
        rung[done] -= half[fits]
        rung[later] = half[~fits]
    last = want > 0
    kept[last] += rung[last]
    return kept


def weighted_test(tables: DataFrame, sample_sums: DataFrame, resamples: int = 100, seed: int = 0) -> DataFrame:
    """``a, b, me_p, co_p`` with q-values, after Kim et al. (2017): each feature's samples are drawn anew, weighed by their number of events.

    Samples of one sum are alike, so a draw is a number from each class of sums,
    and what two draws share in a class is hypergeometric; memory is that of the
    classes and not of the samples.
    """
    classes = sample_sums.agg(F.array_sort(F.collect_list(F.struct("sample_sum", "n"))).alias("classes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[tuple[str, int], np.ndarray] = {}  # as many as features
        for frame in frames:
            me, co = [], []
            for r in frame.itertuples():
                weight = np.array([c["sample_sum"] for c in r.classes], float)
                many = np.array([c["n"] for c in r.classes])
                for f, k in (x := (r.a, int(r.n11 + r.n10)), y := (r.b, int(r.n11 + r.n01))):
                    if (f, k) not in drawn:
                        drawn[f, k] = weighted_draws(np.random.default_rng([seed, *f.encode()]), weight, many, k, resamples)
                both = np.random.default_rng([seed, *r.a.encode(), 0, *r.b.encode()]).hypergeometric(drawn[x], many - drawn[x], drawn[y]).sum(1)
                me.append((1 + (both <= r.n11).sum()) / (resamples + 1))
                co.append((1 + (both >= r.n11).sum()) / (resamples + 1))
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "me_p": me, "co_p": co})

    rows = tables.select("a", "b", "n11", "n10", "n01", "n00").crossJoin(F.broadcast(classes))  # one row is broadcast
    tested = rows.mapInPandas(run, "a string, b string, me_p double, co_p double")
    return benjamini_hochberg(benjamini_hochberg(tested, "me_p", "me_q", ties=["a", "b"]), "co_p", "co_q", ties=["a", "b"])


def logit_p(y: np.ndarray, x: np.ndarray, weight: np.ndarray, steps: int = 50) -> float | None:
    """Wald p-value of the first column of ``x`` in a logistic regression; None where it doesn't settle."""
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z
        try:
            move = np.linalg.solve(h, z.T @ (weight * (y - p)))
        except np.linalg.LinAlgError:
            return None
        w += move
        if np.abs(move).max() < 1e-8:
            variance = np.linalg.inv(h)[0, 0]
            return math.erfc(abs(w[0]) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 and np.isfinite(w).all() and abs(w[0]) < 30 else None
    return None


def burden_conditioned(counts: DataFrame, top: DataFrame, burdens: DataFrame) -> DataFrame:
    """``a, b, p_plain, p_burden``: does a tell b, and still so beside the log of the sample's burden.

    The regression sees how many samples of each burden have a, b, both or
    neither, not the samples.
    """
    sized = counts.join(top.select("feature", "rk"), "feature").select("sample", "feature", "rk").join(burdens, "sample")
    x, y = sized.alias("x"), sized.select("sample", "feature", "rk").alias("y")
    both = x.join(y, (F.col("x.sample") == F.col("y.sample")) & (F.col("x.rk") < F.col("y.rk"))).groupBy(F.col("x.feature").alias("a"), F.col("y.feature").alias("b"), "burden").agg(F.count("*").alias("n11"))
    one = sized.groupBy("feature", "burden").agg(F.count("*").alias("m"))
    sizes = burdens.groupBy("burden").agg(F.count("*").alias("size"))
    u, v = top.alias("u"), top.alias("v")
    pairs = u.join(v, F.col("u.rk") < F.col("v.rk")).select(F.col("u.feature").alias("a"), F.col("v.feature").alias("b"))
    grid = pairs.crossJoin(sizes)
    for s in "ab":
        grid = grid.join(one.select(F.col("feature").alias(s), "burden", F.col("m").alias(f"m{s}")), [s, "burden"], "left")
    cells = grid.join(both, ["a", "b", "burden"], "left").na.fill(0, ["ma", "mb", "n11"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n11, ma, mb, size = (frame[c].to_numpy(float) for c in ("n11", "ma", "mb", "size"))
        weight = np.concatenate([n11, ma - n11, mb - n11, size - ma - mb + n11])
        k = len(frame)
        xa, yb, burden = np.repeat([1.0, 1, 0, 0], k), np.repeat([1.0, 0, 1, 0], k), np.tile(np.log1p(frame["burden"].to_numpy(float)), 4)
        return pd.DataFrame({"a": frame["a"].iloc[:1], "b": frame["b"].iloc[:1], "p_plain": [logit_p(yb, xa[:, None], weight)], "p_burden": [logit_p(yb, np.column_stack([xa, burden]), weight)]})

    return cells.groupBy("a", "b").applyInPandas(run, "a string, b string, p_plain double, p_burden double")


def burden_aware(conditioned: DataFrame, pairs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Pairs with the q-value of their burden-conditioned test; those that couldn't be tested are in no family."""
    tested = benjamini_hochberg(conditioned, "p_burden", "q_burden", ties=["a", "b"])
    return pairs.join(tested, ["a", "b"], "left").withColumn("robust", F.coalesce(F.col("q_burden") < fdr, F.lit(False)))


def explained_by_burden(conditioned: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many pairs are significant by themselves, and how many of those no longer beside the burden."""
    plain = F.col("p_plain") < alpha
    return conditioned.agg(F.count("*").alias("pairs"), F.count_if(plain).alias("marginal"), F.count_if(plain & (F.coalesce(F.col("p_burden"), F.lit(1.0)) >= alpha)).alias("explained"))


def compare(methods: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The tables of all methods joined on the pair, and what went wrong with those left out; raises if all did.

    A method's table is written here, as a lazy one would only fail later.
    """
    good, wrong = [], {}
    for name, make in methods.items():
        try:
            table = make()
            good.append(staged(table.select("a", "b", *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c not in ("a", "b")]), f"compare-{name}"))
        except Exception as e:  # one method's failure mustn't hide the others' results
            wrong[name] = str(e)
    if not good:
        raise RuntimeError(f"every method failed: {wrong}")
    first, *rest = good
    for other in rest:
        first = first.join(other, ["a", "b"])
    return first, wrong
