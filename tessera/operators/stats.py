"""Distribution summaries: percentiles, tails, quintiles, histograms, certainty equivalents.

Percentiles are exact and interpolate linearly. Groups of simulated paths or of panel rows
are small and use Spark's aggregate, one pass that holds a group's distinct values in a
task. Groups of table rows have no bound; for them there is ``exact_percentiles``, which
operators use where ``large`` is set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

LEVELS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def percentile_columns(value: str, levels: dict[str, float] = LEVELS) -> list[Column]:
    return [F.percentile(value, F.lit(p)).alias(name) for name, p in levels.items()]


def summary(rows: DataFrame, keys: list[str], value: str, goal: float | None = None, large: bool = False) -> DataFrame:
    """Percentiles, mean, count, mean of the lowest 5 % (values up to p5), share that reaches the goal."""
    mean = [F.avg(value).alias("mean"), F.count(value).alias("n")]
    if large:
        pairs = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        base = exact_percentiles(rows, keys, value, LEVELS).drop("n").alias("a").join(rows.groupBy(*keys).agg(*mean).alias("b"), pairs).select("a.*", "mean", "n")
    else:
        base = rows.groupBy(*keys).agg(*percentile_columns(value), *mean)
    cut = base.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("p5").alias("_cut"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    tail = rows.join(cut, same).where(F.col(value) <= F.col("_cut")).groupBy(*keys).agg(F.avg(value).alias("cvar5"))
    joined = base.alias("a").join(tail.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", "cvar5")
    if goal is None:
        return joined
    reach = rows.groupBy(*keys).agg(F.avg((F.col(value) >= goal).cast("double")).alias("reach"))
    return joined.alias("a").join(reach.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", "reach")


def quintiles(rows: DataFrame, keys: list[str], value: str, large: bool = False, of: DataFrame | None = None) -> DataFrame:
    """Adds quintile 1..5 within the keys: edges are interpolated quantiles, closed on the right.

    ``of`` are the rows that make the edges, if it isn't the rows themselves: of copies, one each.
    The edges, a row for each group, are broadcast: sizes estimated from files may hold the rows to be less.
    """
    cuts, of = {f"_e{k}": k / 5 for k in range(1, 5)}, rows if of is None else of
    found = exact_percentiles(of, keys, value, cuts) if large else of.groupBy(*keys).agg(*percentile_columns(value, cuts))
    edges = found.select(*keys, F.array(*cuts).alias("_edges"))
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(F.col(value) <= F.col("_edges")[k - 1], k).otherwise(out)
    return rows.join(F.broadcast(edges), keys).withColumn("quintile", out.cast("int")).drop("_edges")


def percentile_curve(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, percent, value) for 1..99, of groups of any size."""
    found = _ranked_percentiles(rows, keys, value, [k / 100 for k in range(1, 100)], 10_000)
    return found.select(*keys, (F.col("_level") + 1).alias("percent"), F.col("_p").alias("value"))


def melted_percentiles(rows: DataFrame, keys: list[str], metrics: list[str], levels: dict[str, float], large: bool = False) -> DataFrame:
    """(keys, metric, levels...) of every metric column."""
    long = rows.unpivot(keys, metrics, "metric", "value")
    if large:
        return exact_percentiles(long, [*keys, "metric"], "value", levels).drop("n")
    return long.groupBy(*keys, "metric").agg(*percentile_columns("value", levels))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n) of equal bins, closed on the left; the last one on both sides; others are left out."""
    scaled = (F.col(value) - low) * (bins / (high - low))
    at = F.when(F.col(value) == high, bins - 1).otherwise(F.floor(scaled)).cast("int")
    inside = rows.where((F.col(value) >= low) & (F.col(value) <= high)).withColumn("bin", F.least(at, F.lit(bins - 1)))
    return inside.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def certainty_equivalent(value: Column, gamma: float) -> Column:
    """Aggregate: the sure amount as good as the lottery, for constant relative risk aversion."""
    x = F.greatest(value, F.lit(1e-9))
    if gamma == 1:
        return F.exp(F.avg(F.ln(x)))
    return F.pow(F.avg(F.pow(x, F.lit(1.0 - gamma))), F.lit(1 / (1 - gamma)))


def nearest_to_median(rows: DataFrame, keys: list[str], value: str, tie: str, columns: list[str]) -> DataFrame:
    """The row of each group closest to its median, so that parts of it add up; ties (to nine decimals) by ``tie``."""
    median = exact_percentiles(rows, keys, value, {"median": 0.5}).select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    joined = rows.join(median, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) if keys else rows.crossJoin(median)
    picked = F.min_by(F.struct(tie, value, *columns), F.struct(F.round(F.abs(F.col(value) - F.col("median")), 9), F.col(tie)))
    return joined.groupBy(*keys).agg(F.first("median").alias("median"), picked.alias("_row")).select(*keys, "median", "_row.*")


def covariance_matrix(rows: DataFrame, vector: str, weight: str) -> DataFrame:
    """(a, b, cov, wcov) of all pairs a <= b of the places (from 1) of a vector: sample covariance, and the weighted one.

    Each batch becomes one matrix of products; what is shuffled is as many numbers a batch as there are pairs.
    """

    def sums(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, w = np.stack(pdf["x"].to_numpy()).astype(float), pdf["w"].to_numpy(float)
            one = np.column_stack([x, np.ones(len(x))])
            plain, weighted = one.T @ one, (one * w[:, None]).T @ one
            i, j = np.triu_indices(x.shape[1])
            yield pd.DataFrame({
                "a": i + 1, "b": j + 1, "n": len(x), "xy": plain[i, j], "x": plain[i, -1], "y": plain[j, -1],
                "w": w.sum(), "wxy": weighted[i, j], "wx": weighted[i, -1], "wy": weighted[j, -1],
            })

    parts = rows.select(F.col(vector).cast("array<double>").alias("x"), F.col(weight).cast("double").alias("w"))
    parts = parts.mapInPandas(sums, "a int, b int, n long, xy double, x double, y double, w double, wxy double, wx double, wy double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "w", "wxy", "wx", "wy")])
    plain = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)
    weighted = F.col("wxy") / F.col("w") - F.col("wx") / F.col("w") * F.col("wy") / F.col("w")
    return total.select("a", "b", plain.alias("cov"), weighted.alias("wcov"))


def covariances(rows: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """(a, b, cov) of each pair: sample covariance, or the weighted one by sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    if weight is None:
        stats = [F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]
    else:
        w = F.col(weight)
        mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
        stats = [(F.sum(w * F.col(a) * F.col(b)) / F.sum(w) - mean(a) * mean(b)).alias(f"{a}|{b}") for a, b in pairs]
    long = rows.agg(*stats).unpivot([], [f"{a}|{b}" for a, b in pairs], "_pair", "cov")
    cut = F.split("_pair", r"\|")
    return long.select(cut[0].alias("a"), cut[1].alias("b"), "cov")


def rolling_correlation(x: Column, y: Column, window: WindowSpec) -> Column:
    """Correlation of the pairs in a window, NaN where one of both doesn't vary: Spark's own function divides by zero there."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x).over(window) * F.stddev_pop(y).over(window)
    return F.when(spread == 0, float("nan")).otherwise(F.try_divide(F.covar_pop(x, y).over(window), spread))


def fisher_interval(r: Column, n: Column, z: float = 1.645) -> tuple[Column, Column]:
    """Interval of a correlation of n independent pairs."""
    at, half = F.atanh(r), F.lit(z) / F.sqrt(n - 3)
    return F.tanh(at - half), F.tanh(at + half)


def diebold_mariano(rows: DataFrame, order: str, diff: str, lags: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, mean, variance, t): test of a mean difference of scores with Newey-West variance.

    Each series is one model comparison over time, ordered in one partition.
    """
    inside = Window.partitionBy(*keys)
    centred = rows.withColumn("_mean", F.avg(diff).over(inside)).withColumn("_d", F.col(diff) - F.col("_mean"))
    w = inside.orderBy(order)
    lagged = centred.select(*keys, "_d", "_mean", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    products = [F.sum(F.col("_d") * F.col("_d")).alias("_s0")] + [F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, lags + 1)]
    sums = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_mean").alias("mean"), *products)
    total = F.col("_s0")
    for k in range(1, lags + 1):
        total = total + F.col(f"_s{k}") * (2 * (1 - k / (lags + 1)))
    return sums.select(*keys, "n", "mean", (total / F.col("n")).alias("variance")).withColumn("t", F.col("mean") / F.sqrt(F.col("variance") / F.col("n")))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(keys, n, level names...): exact interpolated percentiles of groups of any size. Null values don't count; keys may be null."""
    found = _ranked_percentiles(rows, keys, value, list(levels.values()), accuracy)
    return found.groupBy(*keys, F.col("_n").alias("n")).agg(*[F.max(F.when(F.col("_level") == i, F.col("_p"))).alias(n) for i, n in enumerate(levels)])


def _ranked_percentiles(rows: DataFrame, keys: list[str], value: str, wanted: list[float], accuracy: int) -> DataFrame:
    """(keys, _n, _level, _p): exact percentiles, without a group in one task.

    The aggregate function keeps all distinct values of a group in one task. Here a sketch
    first brackets every level. Then a row counts either for its value, if that is inside a bracket, or
    for the gap between brackets that it is in; so a group becomes about 4 / accuracy of its
    distinct values for each level, and a gap for each level, which are ranked.
    """
    slack = 2.0 / accuracy
    ends = lambda side: F.expr("array(" + ", ".join(f"{min(1.0, max(0.0, p + side * slack))!r}D" for p in wanted) + ")")
    flags = lambda test: F.expr("array(" + ", ".join(str(bool(test(p))).lower() for p in wanted) + ")")
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends(-1), accuracy).alias("_low"), F.percentile_approx("_v", ends(1), accuracy).alias("_high"))
    # A bracket must hold the ranks on both sides of its level: it is open at the ends, and for groups
    # so small that its slack is less than some rows, which are ranked whole.
    small = F.col("_n") <= 4 * accuracy
    low = F.zip_with("_low", flags(lambda p: p - slack <= 0), lambda x, opened: F.when(small | opened, F.lit(float("-inf"))).otherwise(x))
    high = F.zip_with("_high", flags(lambda p: p + slack >= 1), lambda x, opened: F.when(small | opened, F.lit(float("inf"))).otherwise(x))
    sketch = sketch.withColumn("_low", low).withColumn("_brackets", F.zip_with("_low", high, lambda a, b: F.struct(a.alias("low"), b.alias("high")))).drop("_high")
    renamed = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n", "_low", "_brackets")
    same = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = one if same is None else same & one
    # Every row has its group's sketch. The join is an outer one because Spark then can't broadcast the
    # rows: their size is estimated from the files, however often they were exploded or compressed.
    joined = known.join(renamed, same, "left") if keys else known.crossJoin(F.broadcast(renamed))
    inside = F.exists("_brackets", lambda b: (F.col("_v") >= b["low"]) & (F.col("_v") <= b["high"]))
    placed = joined.select(*keys, "_n", "_v", F.size(F.filter("_low", lambda x: x <= F.col("_v"))).alias("_gap"), F.when(inside, F.col("_v")).alias("_x"))
    cells = placed.groupBy(*keys, "_n", "_gap", "_x").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"))
    upto = Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_to", F.sum("_c").over(upto))
    # A level lies between two ranks; each is held by one cell.
    levels = F.expr("array(" + ", ".join(f"struct({i} AS level, {p!r}D AS p)" for i, p in enumerate(wanted)) + ")")
    at = lambda x: x["p"] * (F.col("_n") - 1)
    here = lambda k: (k >= F.col("_to") - F.col("_c")) & (k < F.col("_to"))
    held = F.filter(levels, lambda x: here(F.floor(at(x))) | here(F.ceil(at(x))))
    sides = ranked.select(*keys, "_n", "_x", "_c", "_to", F.explode(held).alias("_l"))
    rank = F.col("_l.p") * (F.col("_n") - 1)
    side = lambda k: F.max(F.when(here(k), F.col("_x")))
    both = sides.groupBy(*keys, "_n", F.col("_l.level").alias("_level"), F.col("_l.p").alias("_share")).agg(side(F.floor(rank)).alias("_a"), side(F.ceil(rank)).alias("_b"))
    part = F.col("_share") * (F.col("_n") - 1) - F.floor(F.col("_share") * (F.col("_n") - 1))
    return both.select(*keys, "_n", "_level", (F.col("_a") + part * (F.col("_b") - F.col("_a"))).alias("_p"))
