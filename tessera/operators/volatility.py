"""GARCH(1,1) by quasi maximum likelihood, one task per series, and its bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.numerics import linear_recursion, simplex_search

STARTS = ((0.05, 0.90), (0.10, 0.85), (0.03, 0.95))
FIT = "omega double, alpha double, beta double, persistence double, half_life double, long_run_vol double, current_vol double, loglik double"


def variances(r: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    return linear_recursion(omega + alpha * r[:-1] ** 2, beta, start)


def fit_garch(r: np.ndarray, per_year: int = 252, starts=STARTS) -> dict:
    """Parameters, persistence, half-life in steps, long-run and current volatility a year, log-likelihood."""
    r = np.asarray(r, float) - np.mean(r)
    v = r.var()

    def cost(p):
        omega, alpha, beta = p
        if not (omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 0.9999):
            return 1e10
        s2 = variances(r, omega, alpha, beta, v)
        return 0.5 * float(np.sum(np.log(2 * np.pi * s2) + r * r / s2))

    (omega, alpha, beta), least = min((simplex_search(cost, (v * (1 - a - b), a, b)) for a, b in starts), key=lambda x: x[1])
    stay = alpha + beta
    return {
        "omega": omega, "alpha": alpha, "beta": beta, "persistence": stay, "half_life": math.log(0.5) / math.log(stay) if 0 < stay < 1 else math.inf,
        "long_run_vol": math.sqrt(omega / (1 - stay) * per_year), "current_vol": math.sqrt(variances(r, omega, alpha, beta, v)[-1] * per_year), "loglik": -least,
    }


def garch_by_series(rows: DataFrame, key: str, order: str, ret: str, per_year: int = 252) -> DataFrame:
    """A fit for each series; a series is a few thousand steps and is fitted in one task."""
    kind = dict(rows.dtypes)[key]

    def run(k, pdf):
        r = pdf.sort_values(order)[ret].to_numpy(float)
        return pd.DataFrame([{key: k[0], **fit_garch(r, per_year)}]) if len(r) >= 20 and np.ptp(r) > 0 else pd.DataFrame(columns=[key, *[c.split()[0] for c in FIT.split(", ")]])

    return rows.select(key, order, ret).where(f"{ret} is not null").groupBy(key).applyInPandas(run, f"{key} {kind}, {FIT}")


def garch_bootstrap(rows: DataFrame, key: str, order: str, ret: str, n: int, seed: int = 1, per_year: int = 252) -> DataFrame:
    """(key, replica, alpha, beta, persistence, half_life, long_run_vol): refits of filtered historical simulations.

    Residuals are drawn with replacement and sent through the fitted recursion, all replicas
    of a series at once; each is a group of its own when it is refitted.
    """
    kind = dict(rows.dtypes)[key]

    def make(k, pdf):
        r = pdf.sort_values(order)[ret].to_numpy(float)
        r = r - r.mean()
        g = fit_garch(r, per_year)
        s2 = variances(r, g["omega"], g["alpha"], g["beta"], r.var())
        z = r / np.sqrt(s2)
        rng = np.random.default_rng([seed, *str(k[0]).encode()])
        drawn = z[rng.integers(0, len(z), (n, len(z)))]
        made, now = np.empty_like(drawn), np.full(n, r.var())
        for t in range(len(z)):
            made[:, t] = np.sqrt(now) * drawn[:, t]
            now = g["omega"] + g["alpha"] * made[:, t] ** 2 + g["beta"] * now
        return pd.DataFrame({key: k[0], "replica": range(n), "a0": g["alpha"], "b0": g["beta"], "series": list(made)})

    def refit(k, pdf):
        row = pdf.iloc[0]
        g = fit_garch(np.asarray(row["series"], float), per_year, ((max(row["a0"], 0.01), min(row["b0"], 0.98)),))
        return pd.DataFrame([{key: k[0], "replica": int(k[1])} | {c: g[c] for c in ("alpha", "beta", "persistence", "half_life", "long_run_vol")}])

    series = rows.select(key, order, ret).where(f"{ret} is not null").groupBy(key).applyInPandas(make, f"{key} {kind}, replica int, a0 double, b0 double, series array<double>")
    return series.groupBy(key, "replica").applyInPandas(refit, f"{key} {kind}, replica int, alpha double, beta double, persistence double, half_life double, long_run_vol double")
