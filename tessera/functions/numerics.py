"""Numerical routines on numpy alone: distributions, simplex search, Newton steps, scans."""

from __future__ import annotations

import itertools
import math

import numpy as np


def normal_cdf(x):
    x = np.asarray(x, float) / math.sqrt(2)
    return 0.5 * (1 + np.array([math.erf(v) for v in x.ravel()]).reshape(x.shape))


def bisected(f, target, low: float, high: float, steps: int = 80):
    """x with f(x) = target, f rising, element by element."""
    target = np.asarray(target, float)
    a, b = np.full(target.shape, low), np.full(target.shape, high)
    for _ in range(steps):
        mid = (a + b) / 2
        under = f(mid) < target
        a, b = np.where(under, mid, a), np.where(under, b, mid)
    return (a + b) / 2


def normal_quantile(p):
    return bisected(normal_cdf, np.clip(p, 1e-15, 1 - 1e-15), -9.0, 9.0, 60)


def beta_cdf(x, a: float, b: float):
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    x = np.clip(np.asarray(x, float), 1e-300, 1 - 1e-16)
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    # p + q and the pair (p, q) are the same either way round, so the constant is one number.
    lead = np.exp(p * np.log(y) + q * np.log1p(-y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    out = d.copy()
    for m in range(1, 200):
        for numerator in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + numerator * d) < tiny, tiny, 1 + numerator * d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
    value = lead * out
    return np.where(flip, 1 - value, value)


def beta_quantile(p, a: float, b: float):
    return bisected(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0, 60)


def simplex_search(f, start, spread: float = 0.05, steps: int = 4000, x_tol: float = 1e-10, f_tol: float = 1e-8):
    """Least value of f by the downhill simplex of Nelder and Mead; returns (point, value)."""
    start = np.asarray(start, float)
    points = [start] + [start + np.eye(len(start))[k] * (spread * start[k] if start[k] else 0.00025) for k in range(len(start))]
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda r: r[:2])
    ticket = itertools.count(len(points))
    for _ in range(steps):
        best, worst = ranked[0], ranked[-1]
        if max(np.abs(p - best[2]).max() for _, _, p in ranked) <= x_tol and worst[0] - best[0] <= f_tol:
            break
        centre = np.mean([p for _, _, p in ranked[:-1]], axis=0)
        out = centre - worst[2]
        reach = lambda k: (lambda p: (f(p), next(ticket), p))(centre + k * out)  # noqa: E731, B023
        trial = reach(1.0)
        if trial[0] < best[0]:
            further = reach(2.0)
            trial = min(trial, further, key=lambda r: r[0])
        elif trial[0] >= ranked[-2][0]:
            inner = reach(0.5 if trial[0] < worst[0] else -0.5)
            if inner[0] < min(trial[0], worst[0]):
                trial = inner
            else:
                ranked = [best] + [(f(q), next(ticket), q) for q in (best[2] + 0.5 * (p - best[2]) for _, _, p in ranked[1:])]
                ranked.sort(key=lambda r: r[:2])
                continue
        ranked[-1] = trial
        ranked.sort(key=lambda r: r[:2])
    return ranked[0][2], ranked[0][0]


def linear_recursion(inputs: np.ndarray, rate: float, start: float, block: int = 64) -> np.ndarray:
    """y[0] = start, y[t] = inputs[t-1] + rate * y[t-1]: blocks at a time through a triangular matrix."""
    n = len(inputs)
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    weights = np.where(lag >= 0, float(rate) ** np.maximum(lag, 0), 0.0)
    carry_in = float(rate) ** np.arange(1, block + 1)
    out = np.empty(n + 1)
    out[0] = now = start
    for at in range(0, n, block):
        u = inputs[at : at + block]
        k = len(u)
        out[at + 1 : at + 1 + k] = weights[:k, :k] @ u + carry_in[:k] * now
        now = out[at + k]
    return out


def best_assignment(cost: np.ndarray) -> tuple[int, ...]:
    """Column for each row with the least total cost, by trying all orders (few rows)."""
    n = len(cost)
    return min(itertools.permutations(range(n)), key=lambda p: (sum(cost[i, p[i]] for i in range(n)), p))
