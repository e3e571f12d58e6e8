"""Hidden Markov chains over long series, as associative scans, and their fit by summed statistics.

A step of the forward pass multiplies by a matrix: transitions times emission densities. Products
of such matrices can be taken in any grouping, so each range of a series is reduced to
its product, the vectors that enter a range from both sides follow from the few products of its
series, and inside a range both passes run from there. No task holds more than a range, and a
series of any length takes two shuffles of its rows.

A fit repeats that: every range hands on sums of what the M-step needs, an aggregation adds
them up by fit, and the new parameters are a row per fit. Fits from several starts, of
several numbers of regimes and of several series run side by side; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.segments import ROWS_PER_SEGMENT, in_segments

#: Ridge of a variance, and the least weight of a regime, in the M-step.
RIDGE, LEAST = 1e-12, 1e-12


def _scaled_products(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All products steps[0] ... steps[t], each scaled to a sum of 1, and the logs of the scales, by doubling."""
    out = steps.copy()
    scale = out.sum(axis=(1, 2))
    out /= scale[:, None, None]
    logs = np.log(scale)
    width = 1
    while width < len(out):
        both = out[:-width] @ out[width:]
        scale = both.sum(axis=(1, 2))
        out[width:] = both / scale[:, None, None]
        logs[width:] = logs[:-width] + logs[width:] + np.log(scale)
        width *= 2
    return out, logs


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values([c for c in rows.columns if c.startswith("_order")])


def _cells(column: pd.Series, k: int) -> np.ndarray:
    """An array column of k x k cells, row by row."""
    return np.stack(column.to_numpy()).astype(float).reshape(len(column), k, k)


def _steps(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(densities, transitions into each row, their products) of rows in order."""
    dense = np.stack(rows["_dense"].to_numpy()).astype(float)
    moves = _cells(rows["_moves"], dense.shape[1])
    return dense, moves, moves * dense[:, None, :]


def _products(series: list[str]):
    """A range's transitions into its first row, and the product from that row's densities on."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows)
        dense, moves, steps = _steps(rows)
        steps[0] = np.diag(dense[0])
        products, logs = _scaled_products(steps)
        head = rows.iloc[:1]
        return head[[*series, "_segment"]].assign(_entry=[moves[0].ravel().tolist()], _product=[products[-1].ravel().tolist()], _log=logs[-1], _start=[head["_start"].iloc[0]])

    return reduce


def _carried(series: list[str]):
    """What enters each range of a series: the chances at the row before and at its first row, what follows its last one, and the log-likelihood before."""

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_segment").reset_index(drop=True)
        start = np.asarray(rows["_start"].iloc[0], float)
        k = len(start)
        entry, product = _cells(rows["_entry"], k), _cells(rows["_product"], k)
        last, ahead, logs, at, total = [], [], [], start, 0.0
        for s in range(len(rows)):
            into = at if s == 0 else at @ entry[s]
            last.append(at)
            ahead.append(into)
            logs.append(total)
            at = into @ product[s]
            total += np.log(at.sum()) + rows["_log"].iloc[s]
            at = at / at.sum()
        behind, at = [], np.ones(k)
        for s in range(len(rows) - 1, -1, -1):
            behind.append(at / at.sum())
            at = entry[s] @ (product[s] @ behind[-1])
        return rows[[*series, "_segment"]].assign(_leading=[s == 0 for s in range(len(rows))], _last=[a.tolist() for a in last], _ahead=[a.tolist() for a in ahead], _behind=[b.tolist() for b in behind[::-1]], _before=logs, _loglik=total)

    return carry


def _inside(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(chances given the past, chances given all, joint chances of each step, log-likelihoods up to each row) of a range in order."""
    dense, moves, steps = _steps(rows)
    ahead, behind = (np.asarray(rows[c].iloc[0], float) for c in ("_ahead", "_behind"))
    first = np.diag(dense[0])
    forward, logs = _scaled_products(np.concatenate([first[None], steps[1:]]))
    alpha = np.einsum("i,tij->tj", ahead, forward)
    scale = alpha.sum(axis=1)
    loglik = logs + np.log(scale) + rows["_before"].iloc[0]
    alpha /= scale[:, None]
    # Backward: from each row the product of all later steps, as products of the transposed steps read from the end.
    beta = np.empty_like(alpha)
    beta[-1] = behind
    if len(rows) > 1:
        back, _ = _scaled_products(np.swapaxes(steps[1:], 1, 2)[::-1])
        beta[:-1] = np.einsum("i,tij->tj", behind, back)[::-1]
        beta[:-1] /= beta[:-1].sum(axis=1, keepdims=True)
    given_all = alpha * beta
    given_all /= given_all.sum(axis=1, keepdims=True)
    # Joint chances of the states before and at each row; those of the first one need the row before it.
    pair = alpha[:-1, :, None] * steps[1:] * beta[1:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return alpha, given_all, pair, loglik


def _entering_pair(rows: pd.DataFrame, given_all: np.ndarray) -> np.ndarray:
    """Joint chances of the states before the range and at its first row; zeros in a series' first range."""
    k = given_all.shape[1]
    if rows["_leading"].iloc[0]:
        return np.zeros((k, k))
    reached = np.asarray(rows["_last"].iloc[0], float)[:, None] * _cells(rows["_moves"].iloc[:1], k)[0]
    return reached * (given_all[0] / np.maximum(reached.sum(axis=0), 1e-300))


def _prepared(placed: DataFrame, series: list[str], order: list[str], densities: Column, moves: Column, start: Column) -> DataFrame:
    """Rows in their segments with what enters their ranges, and the log-likelihood of their series."""
    ordered = [F.col(c).alias(f"_order{k}") for k, c in enumerate(order)]
    placed = placed.select("*", *ordered, densities.alias("_dense"), F.flatten(moves).alias("_moves"), start.alias("_start"))
    types = dict(placed.dtypes)
    names = ", ".join(f"`{k}` {types[k]}" for k in series)
    of_range = placed.select(*series, "_segment", *[f"_order{k}" for k in range(len(order))], "_dense", "_moves", "_start").groupBy(*series, "_segment")
    products = of_range.applyInPandas(_products(series), f"{names}, _segment int, _entry array<double>, _product array<double>, _log double, _start array<double>")
    carried = products.groupBy(*series).applyInPandas(_carried(series), f"{names}, _segment int, _leading boolean, _last array<double>, _ahead array<double>, _behind array<double>, _before double, _loglik double")
    safe = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*series, "_segment"]]
    return placed.alias("r").join(carried.alias("c"), safe).select("r.*", "c._leading", "c._last", "c._ahead", "c._behind", "c._before", "c._loglik")


def smoothed(rows: DataFrame, series: list[str], order: list[str], densities: Column, start: list[float], moves: list[list[float]] | Column, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Adds ``filtered`` and ``posterior`` (arrays over states) and ``loglik`` (up to the row) to each row of each series.

    ``densities`` is an array over states for each row, ``moves`` one matrix for all steps or a column
    of matrices, those of the step into each row. The rows of a series are told apart by ``order``, which
    has no nulls; densities are positive in one state at least.
    """
    matrix = moves if isinstance(moves, Column) else F.array(*[F.array(*[F.lit(float(p)) for p in row]) for row in moves])
    begin = F.array(*[F.lit(float(p)) for p in start])
    ready = _prepared(in_segments(rows, series, order[0], rows_per_segment), series, order, densities, matrix, begin)

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        alpha, given_all, _, loglik = _inside(pdf)
        return pdf[kept].assign(filtered=alpha.tolist(), posterior=given_all.tolist(), loglik=loglik)

    kept = rows.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", filtered array<double>, posterior array<double>, loglik double"
    return ready.groupBy(*series, "_segment").applyInPandas(both, schema)


def normal_density(x: Column, mean: Column, variance: Column) -> Column:
    return F.exp(-0.5 * (x - mean) * (x - mean) / variance) / F.sqrt(2 * F.pi() * variance)


def em_step(placed: DataFrame, parameters: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """One step of EM for normal regimes: (fit, series, start, moves, mean, variance, loglik), the log-likelihood being that before the step.

    ``placed`` are rows in their segments; ``parameters`` has a row for each fit and series, of any number
    of regimes, and every one is fitted to all rows of its series. A range hands on sums of
    chances, of values and of squares, and of joint chances; the sums of all ranges are the whole M-step.
    """
    keys = ["fit", *series]
    both = placed.select(*series, *order, "_segment", F.col(value).cast("double").alias("_x")).join(parameters, series)
    dense = F.transform(F.arrays_zip("mean", "variance"), lambda p: normal_density(F.col("_x"), p["mean"], p["variance"]))
    ready = _prepared(both.select(*keys, *order, "_segment", "_x", "start", "moves", "mean", "variance"), keys, order, dense, F.col("moves"), F.col("start"))
    types = dict(both.dtypes)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        _, given_all, pair, _ = _inside(pdf)
        old = np.asarray(pdf["mean"].iloc[0], float)
        gap = pdf["_x"].to_numpy()[:, None] - old
        joint = pair.sum(axis=0) + _entering_pair(pdf, given_all)
        made = {"_n": given_all.sum(axis=0), "_gap": (given_all * gap).sum(axis=0), "_square": (given_all * gap * gap).sum(axis=0), "_begin": given_all[0] * pdf["_leading"].iloc[0], "_old": old, "_joint": joint.ravel()}
        return pdf[[*keys, "_loglik"]].iloc[:1].assign(**{n: [v.tolist()] for n, v in made.items()})

    names = ", ".join(f"`{k}` {types[k]}" for k in keys)
    cell = ["_n", "_gap", "_square", "_begin", "_old", "_joint"]
    parts = ready.groupBy(*keys, "_segment").applyInPandas(sums, f"{names}, _loglik double, " + ", ".join(f"{c} array<double>" for c in cell))
    cells = parts.select(*keys, "_loglik", F.posexplode(F.arrays_zip(*cell)).alias("_at", "_c"))
    added = [F.sum(F.col(f"_c.{c}")).alias(c) if c != "_old" else F.max("_c._old").alias("_old") for c in cell]
    totals = cells.groupBy(*keys, "_at").agg(F.max("_loglik").alias("_loglik"), *added)
    gathered = totals.groupBy(*keys).agg(F.max("_loglik").alias("loglik"), F.array_sort(F.collect_list(F.struct("_at", *cell))).alias("_c"))
    return gathered.select(*keys, *_maximised(), "loglik")


def fit_regimes(rows: DataFrame, parameters: DataFrame, series: list[str], order: list[str], value: str, steps: int, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """``steps`` steps of EM from the given parameters (fit, series, start, moves, mean, variance), all fits side by side.

    Each step's parameters, a row per fit and series, are cut off from the last by a checkpoint.
    """
    placed = cut(in_segments(rows, series, order[0], rows_per_segment))
    for _ in range(steps):
        parameters = cut(em_step(placed, parameters.select("fit", *series, "start", "moves", "mean", "variance"), series, order, value))
    return parameters


def _maximised() -> list[Column]:
    """The parameters that make the sums ``_c`` most likely, the new means as shifts of the old ones."""
    states = F.filter("_c", lambda c: c["_n"].isNotNull())
    k = F.size(states)
    weight = lambda c: F.greatest(c["_n"], F.lit(LEAST))
    shift = lambda c: c["_gap"] / weight(c)
    mean = F.transform(states, lambda c: c["_old"] + shift(c))
    variance = F.transform(states, lambda c: c["_square"] / weight(c) - shift(c) * shift(c) + RIDGE)
    begin = F.transform(states, lambda c: c["_begin"])
    row = lambda i: F.slice(F.transform("_c", lambda c: c["_joint"]), i * k + 1, k)
    normed = lambda r: F.transform(r, lambda x: x / F.greatest(F.aggregate(r, F.lit(0.0), lambda s, y: s + y), F.lit(LEAST)))
    moves = F.transform(F.sequence(F.lit(0), k - 1), lambda i: normed(row(i)))
    return [begin.alias("start"), moves.alias("moves"), mean.alias("mean"), variance.alias("variance")]
