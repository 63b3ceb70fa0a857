"""Expectation-maximisation over padded batches of count histograms.

A row is a feature or a pair; a column is a cell of its histogram, ``n`` the
samples in it.  All rows of a batch advance together and drop out as they
converge, so the cost of an iteration is a few array operations.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-3
PATIENCE = 3


def padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max([1, *map(len, rows)])))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _ascend(step, loglik, start: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's parameters when its likelihood stops growing, before the last step; and whether one was ever invalid."""
    now, active = start.copy(), np.ones(len(start), bool)
    before, bad = loglik(now), np.zeros(len(start), bool)
    bad |= np.isnan(before)
    active &= ~bad
    for _ in range(max_iter):
        if not active.any():
            break
        new = step(now)
        after = loglik(new)
        wrong = active & np.isnan(after)
        bad |= wrong
        active &= ~wrong
        active &= ~(np.abs(after - before) < tol)
        now[active], before[active] = new[active], after[active]
    return now, bad


def _best_of(fit, loglik, inits: list[np.ndarray], rows: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = np.tile(inits[0], (rows, 1))
    top, stale, used, failed = np.full(rows, -np.inf), np.zeros(rows, int), np.zeros(rows, int), np.zeros(rows, bool)
    for init in inits:
        going = (stale < PATIENCE) & ~failed
        if not going.any():
            break
        found, bad = fit(np.tile(init, (rows, 1)))
        value = loglik(found)
        failed |= going & (bad | np.isnan(value))
        going &= ~failed
        used[going] += 1
        better = going & (value > top + tol)
        best[better], top[better] = found[better], value[better]
        stale = np.where(better, 0, stale + going)
    return best, used, failed


def fit_pi(n: np.ndarray, here: np.ndarray, below: np.ndarray, support: np.ndarray, inits: list[float], max_iter: int = 1000, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rate of a latent event by feature, starts used, and whether the fit failed.

    ``here`` and ``below`` are P(c) and P(c - 1); the mean of the E-step is over
    the samples whose count has support.
    """
    weight = np.where(support, n, 0)
    size = weight.sum(1)

    def loglik(p: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            inside = (p[:, 0] >= 0) & (p[:, 0] < 1)
            terms = np.where(n > 0, n * np.log(here * (1 - p) + below * p), 0)
            return np.where(inside, terms.sum(1), np.nan)

    def step(p: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            z = p * below / (p * below + (1 - p) * here)
            return (np.where(weight > 0, weight * z, 0).sum(1) / size)[:, None]

    best, used, failed = _best_of(lambda start: _ascend(step, loglik, start, max_iter, tol), loglik, [np.array([x]) for x in inits], len(n), tol)
    failed |= size == 0
    return best[:, 0], used, failed


def pair_loglik(n: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tau: np.ndarray) -> np.ndarray:
    """Log-likelihood by pair of tau = (00, 01, 10, 11); NaN where tau isn't a distribution to within a hundredth."""
    with np.errstate(all="ignore"):
        valid = (tau >= 0).all(1) & (tau <= 1).all(1) & (np.abs(tau.sum(1) - 1) <= 1e-2 + 1e-5) & (tau[:, 3] != 1)
        t = tau[:, :, None]
        mixed = a[0] * b[0] * t[:, 0] + a[0] * b[1] * t[:, 1] + a[1] * b[0] * t[:, 2] + a[1] * b[1] * t[:, 3]
        return np.where(valid, np.where(n > 0, n * np.log(mixed), 0).sum(1), np.nan)


def fit_tau(n: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], plain_a: tuple[np.ndarray, np.ndarray], plain_b: tuple[np.ndarray, np.ndarray], inits: list[list[float]], max_iter: int = 1000, tol: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint rates (00, 01, 10, 11) by pair, starts used, and whether the fit failed.

    ``a`` and ``b`` have the floor outside the support, for the likelihood; the
    plain ones have 0 there, for the E-step, whose mean is over all samples.
    """
    joint = np.stack([plain_a[0] * plain_b[0], plain_a[0] * plain_b[1], plain_a[1] * plain_b[0], plain_a[1] * plain_b[1]], axis=1)
    size = n.sum(1)[:, None]

    def step(tau: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            z = tau[:, :, None] * joint
            z /= z.sum(1, keepdims=True)
            return (n[:, None] * np.nan_to_num(z, nan=2e-100)).sum(2) / size

    loglik = lambda tau: pair_loglik(n, a, b, tau)
    return _best_of(lambda start: _ascend(step, loglik, start, max_iter, tol), loglik, [np.array(x) for x in inits], len(n), tol)
