"""GARCH(1,1) over many and long series: likelihoods of many parameters at once, and a search by zooming grids.

A variance is an affine function of the one before it, and such functions can be composed in any
grouping. So a range of a series is reduced to one function for each point of parameters, the
variance that enters a range follows from the functions of the ranges before it, and every range adds
its part of the likelihood of all points. A round is two shuffles of the rows, whatever the number of
points; no task holds more than a range.

The search is a grid over three bounded numbers: how alpha and beta share their sum, how far the
sum is from 1, and the long-run variance against that of the sample. Each round takes the best
point of every series as the centre of a finer grid. All series advance together, and a round's centres,
a row per series, are all that is kept.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.segments import ROWS_PER_SEGMENT, in_segments

#: Centre and half width of the first grid in each of the three numbers, and their bounds.
CENTRE, WIDTH = (0.25, 1.4, 0.0), (0.25, 1.1, 2.0)
LOWEST, HIGHEST = (0.0, 0.05, -6.0), (1.0, 4.0, 6.0)
#: Points of a grid on each side of its centre, how much finer the next one is, and rounds.
SIDE, ZOOM, ROUNDS = 3, 0.45, 13
#: Series with fewer rows aren't fitted.
LEAST_ROWS = 20


def points_around(centre: np.ndarray, width: np.ndarray) -> np.ndarray:
    """(points, 3): a grid in the three numbers, within their bounds; the centre is the first one."""
    steps = sorted(itertools.product(range(-SIDE, SIDE + 1), repeat=3), key=lambda s: any(s))
    return np.clip(centre + np.array(steps) / SIDE * width, LOWEST, HIGHEST)


def parameters(points: np.ndarray, variance: float) -> np.ndarray:
    """(points, 3): omega, alpha and beta of points, for a sample variance."""
    both = 1 - 10.0 ** -points[:, 1]
    return np.stack([variance * 2.0 ** points[:, 2] * (1 - both), both * points[:, 0], both * (1 - points[:, 0])], axis=1)


def _composed(r: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function of a variance that the squares r lead to, for each point: factor and summand."""
    summand = np.zeros(len(p))
    for x in r * r:
        summand = p[:, 0] + p[:, 1] * x + p[:, 2] * summand
    return p[:, 2] ** len(r), summand


def _costs(r: np.ndarray, p: np.ndarray, entering: np.ndarray) -> np.ndarray:
    """Minus the log-likelihood of the rows of a range, for each point."""
    now, out = entering.copy(), np.zeros(len(p))
    for x in r * r:
        out += np.log(2 * np.pi * now) + x / now
        now = p[:, 0] + p[:, 1] * x + p[:, 2] * now
    return out / 2


def likelihoods(placed: DataFrame, points: DataFrame, series: list[str], order: list[str], value: str, grid: Callable[[np.ndarray, float], np.ndarray] = lambda p, _: p) -> DataFrame:
    """(series, cost): minus the log-likelihoods of every series' points, as an array in their order.

    ``placed`` are centred rows in their segments, ``points`` has for each series the array ``omega, alpha,
    beta`` of each point (``points``) and the variance that its first row has (``variance``); ``grid`` makes
    those points of something smaller in the tasks, from what stands in their place and the variance.
    """

    def of(pdf: pd.DataFrame) -> np.ndarray:
        return grid(np.stack(pdf["points"].iloc[0]).astype(float), float(pdf["variance"].iloc[0]))

    types = dict(placed.dtypes)
    names = ", ".join(f"`{k}` {types[k]}" for k in series)
    both = placed.select(*series, "_segment", *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("_r"))
    safe = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    ready = both.alias("r").join(points.alias("p"), safe("r", "p", series)).select("r.*", "p.points", "p.variance")
    orders = [f"_order{i}" for i in range(len(order))]

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(orders)
        factor, summand = _composed(pdf["_r"].to_numpy(), of(pdf))
        return pdf[[*series, "_segment", "variance"]].iloc[:1].assign(_factor=[factor.tolist()], _summand=[summand.tolist()])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_segment")
        now, entering = None, []
        for factor, summand, variance in zip(pdf["_factor"], pdf["_summand"], pdf["variance"], strict=True):
            now = np.full(len(factor), variance) if now is None else now
            entering.append(now.tolist())
            now = np.asarray(factor) * now + np.asarray(summand)
        return pdf[[*series, "_segment"]].assign(_entering=entering)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(orders)
        cost = _costs(pdf["_r"].to_numpy(), of(pdf), np.asarray(pdf["_entering"].iloc[0], float))
        return pdf[series].iloc[:1].assign(_cost=[cost.tolist()])

    reduced = ready.groupBy(*series, "_segment").applyInPandas(reduce, f"{names}, _segment int, variance double, _factor array<double>, _summand array<double>")
    entering = reduced.groupBy(*series).applyInPandas(carry, f"{names}, _segment int, _entering array<double>")
    keys = [*series, "_segment"]
    entered = ready.alias("r").join(entering.alias("e"), safe("r", "e", keys)).select("r.*", "e._entering")
    parts = entered.groupBy(*keys).applyInPandas(add_up, f"{names}, _cost array<double>")
    summed = parts.select(*series, F.posexplode("_cost").alias("_at", "_c")).groupBy(*series, "_at").agg(F.sum("_c").alias("_c"))
    return summed.groupBy(*series).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda c: c["_c"]).alias("cost"))


def centred(rows: DataFrame, series: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The rows less the mean of their series, of the series that can be fitted, and (series, variance)."""
    known = rows.where(F.col(value).isNotNull())
    facts = known.groupBy(*series).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("variance"), F.count(F.lit(1)).alias("_n"))
    facts = cut(facts.where((F.col("_n") >= LEAST_ROWS) & (F.col("variance") > 0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in series]
    made = known.alias("r").join(facts.alias("f"), same).select("r.*", "f._mean").withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")
    return made, facts.select(*series, "variance")


def fit_garch(rows: DataFrame, series: list[str], order: list[str], value: str, per_year: int = 252, rounds: int = ROUNDS, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """(series, omega, alpha, beta, persistence, half_life, long_run_vol, loglik) of every series.

    Null values don't count; series of fewer than LEAST_ROWS rows, or without variance, are left out.
    """
    moved, facts = centred(rows, series, value)
    placed = cut(in_segments(moved, series, order[0], rows_per_segment))
    kinds = dict(rows.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in series)
    best = facts.withColumns({"points": F.array(F.array(*map(F.lit, CENTRE))), "cost": F.lit(0.0)})

    def chosen(width: np.ndarray):
        def pick(batches):
            for pdf in batches:
                grids = [points_around(np.asarray(c[0], float), width) for c in pdf["points"]]
                # The least cost; of equal ones the first point, the centre before all.
                at = [int(np.argmin(np.where(np.isfinite(c), c, np.inf))) for c in pdf["costs"]]
                yield pdf[[*series, "variance"]].assign(points=[[g[k].tolist()] for g, k in zip(grids, at, strict=True)], cost=[float(c[k]) for c, k in zip(pdf["costs"], at, strict=True)])

        return pick

    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in series]
    for k in range(rounds):
        width = np.array(WIDTH) * ZOOM**k
        costs = likelihoods(placed, best, series, order, value, lambda c, v, width=width: parameters(points_around(c[0], width), v))
        both = best.alias("b").join(costs.withColumnRenamed("cost", "costs").alias("c"), same).select(*[f"b.{c}" for c in series], "b.variance", "b.points", "c.costs")
        best = cut(both.mapInPandas(chosen(width), f"{names}, variance double, points array<array<double>>, cost double"))

    def named(batches):
        for pdf in batches:
            yield pdf[[*series, "cost"]].assign(_p=[parameters(np.stack(c).astype(float), v)[0].tolist() for c, v in zip(pdf["points"], pdf["variance"], strict=True)])

    best = best.mapInPandas(named, f"{names}, cost double, _p array<double>")
    omega, alpha, beta = (F.col("_p")[k] for k in range(3))
    stay = alpha + beta
    half_life = F.when((stay > 0) & (stay < 1), math.log(0.5) / F.ln(stay)).otherwise(F.lit(float("inf")))
    return best.select(*series, omega.alias("omega"), alpha.alias("alpha"), beta.alias("beta"), stay.alias("persistence"), half_life.alias("half_life"), F.sqrt(omega / (1 - stay) * per_year).alias("long_run_vol"), (-F.col("cost")).alias("loglik"))
