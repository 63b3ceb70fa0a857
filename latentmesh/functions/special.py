"""Special functions as column expressions, evaluated on the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a count beyond a distribution's support is given.
FLOOR = 1e-100
_SMALL = [math.lgamma(k + 1) for k in range(32)]


def log_factorial(n: Column) -> Column:
    """ln n!, from a table for small n and by Stirling's series, whose error is below 1e-13 there."""
    x = F.greatest(n.cast("double"), F.lit(float(len(_SMALL))))
    series = x * F.ln(x) - x + 0.5 * F.ln(x * (2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < len(_SMALL), F.element_at(F.array(*map(F.lit, _SMALL)), (F.least(n, F.lit(len(_SMALL) - 1)) + 1).cast("int"))).otherwise(series)


def hypergeometric_tail(n11: Column, n10: Column, n01: Column, n00: Column, less: bool) -> Column:
    """One-sided exact p-value of a 2 x 2 table: the probability of at most, or at least, n11.

    From the observed table outwards, on its side of the mode, probabilities
    only fall: they are summed as shares of the observed one, whose logarithm
    comes from factorials, and as far as forty deviations, beyond which nothing
    is left.  A table on the other side of the mode gets 1 less the rest.  So no
    sum can underflow before its logarithm does, and the number of terms grows
    with the root of the number of samples.
    """
    x, y, z, w = (c.cast("double") for c in (n11, n10, n01, n00))
    a, b, n = x + y, x + z, x + y + z + w
    mode = F.floor((a + 1) * (b + 1) / (n + 2))
    most = F.floor(40 * F.sqrt(a * b * (n - a) * (n - b) / F.greatest(n * n * (n - 1), F.lit(1.0)))) + 60
    margins = log_factorial(a) + log_factorial(b) + log_factorial(n - a) + log_factorial(n - b) - log_factorial(n)

    def outwards(x: Column, y: Column, z: Column, w: Column, down: bool) -> Column:
        """The tail from this table on."""
        log = margins - log_factorial(x) - log_factorial(y) - log_factorial(z) - log_factorial(w)
        steps = F.least(x, w, most) if down else F.least(y, z, most)
        ratio = (lambda j: (x - j + 1) * (w - j + 1) / ((y + j) * (z + j))) if down else (lambda j: (y - j + 1) * (z - j + 1) / ((x + j) * (w + j)))
        grow = lambda acc, j: F.struct((acc.t * ratio(j)).alias("t"), (acc.s + acc.t * ratio(j)).alias("s"))
        one = F.lit(1.0)
        shares = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, one).cast("int")), F.struct(one.alias("t"), one.alias("s")), grow, lambda acc: F.ln(acc.s))
        return F.exp(log + F.when(steps < 1, F.lit(0.0)).otherwise(shares))

    if less:
        tail = F.when(x <= mode, outwards(x, y, z, w, True)).when((y < 1) | (z < 1), F.lit(1.0)).otherwise(1 - outwards(x + 1, y - 1, z - 1, w + 1, False))
    else:
        tail = F.when(x >= mode, outwards(x, y, z, w, False)).when((x < 1) | (w < 1), F.lit(1.0)).otherwise(1 - outwards(x - 1, y + 1, z + 1, w - 1, True))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))


def erfc(z: Column) -> Column:
    """The complementary error function of numbers from 0 up: by its series below 2, by its continued fraction from there on."""
    near, far = F.least(z, F.lit(2.0)), F.greatest(z, F.lit(2.0))
    term = lambda acc, k: F.struct((acc.t * 2 * near * near / (2 * k + 1)).alias("t"), (acc.s + acc.t * 2 * near * near / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(near.alias("t"), near.alias("s")), term, lambda acc: acc.s)
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), far, lambda acc, k: far + k / 2 / acc)
    root = math.sqrt(math.pi)
    return F.when(z < 2, 1 - 2 / root * F.exp(-near * near) * series).otherwise(F.exp(-far * far) / root / fraction)


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom; negative statistics count as 0, and what isn't a number is null."""
    return F.when(x.isNotNull() & ~F.isnan(x), erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2)))


def rate_of(p: Column) -> Column:
    """The Poisson rate whose chance of any event is ``p``."""
    return -F.ln(1 - p)


def poisson_pmf(rate: Column, kmax: int) -> Column:
    """Probabilities of 0..kmax, scaled to a sum of 1."""
    step = F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), F.array(F.exp(-rate)), lambda p, k: F.concat(p, F.array(F.element_at(p, -1) * rate / k)))
    return scaled(step)


def negative_binomial_pmf(size: Column, p: Column, kmax: Column) -> Column:
    """Probabilities of 0..kmax failures before ``size`` successes of chance ``p``, scaled to a sum of 1."""
    start = F.array(F.exp(size * F.ln(p)))
    grow = lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * (k - 1 + size) / k * (1 - p)))
    return scaled(F.when(kmax < 1, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(kmax, F.lit(1))), start, grow)))


def scaled(pmf: Column) -> Column:
    """The array over its sum, or null where the sum isn't positive."""
    total = F.aggregate(pmf, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(pmf, lambda x: x / total))


def pmf_mean(pmf: Column) -> Column:
    """Sum of k times the k-th probability; an entry that is null or not finite counts as 0."""
    whole = F.transform(pmf, lambda x, k: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x * k))
    return F.aggregate(whole, F.lit(0.0), lambda s, x: s + x)


def as_count(pmf: Column, c: Column) -> Column:
    """P(c), with the floor outside the support and for gaps."""
    return F.when(c >= F.size(pmf), F.lit(FLOOR)).otherwise(F.coalesce(F.get(pmf, c.cast("int")), F.lit(FLOOR)))


def as_shifted(pmf: Column, c: Column) -> Column:
    """P(c - 1), with the floor above the support and 0 below it and for gaps."""
    return F.when(c < 1, F.lit(0.0)).when(c - 1 >= F.size(pmf), F.lit(FLOOR)).otherwise(F.coalesce(F.get(pmf, (F.greatest(c, F.lit(1)) - 1).cast("int")), F.lit(0.0)))


def in_support(pmf: Column, c: Column) -> Column:
    """P(c), or 0 outside the support and for gaps."""
    return F.when(c < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(pmf, F.greatest(c, F.lit(0)).cast("int")), F.lit(0.0)))


def epsilon(n: float, alpha: float = 0.001) -> float:
    """The smallest rate that is told from 0 in ``n`` samples: the root of e = z sqrt(e (1 - e) / n)."""
    z = NormalDist().inv_cdf(1 - alpha)
    return z * z / (n + z * z)


def epsilon_column(n: Column, alpha: float = 0.001) -> Column:
    z = NormalDist().inv_cdf(1 - alpha)
    return F.lit(z * z) / (n + F.lit(z * z))


def restarts(n_inits: int, seed: int) -> tuple[list[float], list[list[float]]]:
    """The starting points of the fits: an informed one and random ones, for single features and for pairs."""
    one, two = np.random.default_rng(seed), np.random.default_rng(seed)
    more = max(n_inits - 1, 0)
    return [0.5, *one.uniform(0.01, 0.99, more).tolist()], [[0.25] * 4, *(two.dirichlet([1, 1, 1, 1]).tolist() for _ in range(more))]
