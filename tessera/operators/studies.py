"""Studies that run the pension engine many times: cases, markets, replicas, grids, break-evens."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import GRID, MARKETS, ROBUSTNESS, Career, Glidepath, Reactive, Reform
from tessera.functions.folds import let, literal
from tessera.functions.lineage import cut
from tessera.functions.random import uniform
from tessera.operators import pension, population
from tessera.operators.regimes import Regimes, aligned, fit, replicas
from tessera.operators.scenarios import pooled_history, recentred, regime_paths, returns_of
from tessera.operators.stats import certainty_equivalent, exact_percentiles


def comparison(made: DataFrame, keys: list[str]) -> DataFrame:
    """Lifecycle and reactive member against the default: medians, lowest percentiles, wins path by path."""
    wide = made.groupBy(*keys, "path_id").agg(
        *[F.max(F.when(F.col("strategy") == s, F.col("pension"))).alias(n) for s, n in ((pension.DEFAULT, "d"), (pension.LIFECYCLE, "l"), (pension.REACTIVE, "r"))],
        F.max("switches").alias("switches"),
    )
    q = lambda c, p: F.percentile(c, F.lit(p))
    share = lambda t: F.avg(t.cast("double"))
    return wide.groupBy(*keys).agg(
        (q("l", 0.5) / q("d", 0.5) - 1).alias("lifecycle_median"), (q("l", 0.05) / q("d", 0.05) - 1).alias("lifecycle_p5"), share(F.col("l") > F.col("d")).alias("lifecycle_wins"),
        (q("r", 0.5) / q("d", 0.5) - 1).alias("reactive_median"), (q("r", 0.05) / q("d", 0.05) - 1).alias("reactive_p5"), share(F.col("r") < F.col("d")).alias("reactive_loses"),
        q("d", 0.5).alias("default_median"), q("switches", 0.5).alias("switches"),
    )


def robustness(spark: SparkSession, history: DataFrame, moves: list[list[float]], start: int, factor_of, n: int, cases=ROBUSTNESS, months: int = 480) -> DataFrame:
    """(case, ...): the comparison under each change of an assumption, on the same draws.

    Scenarios are made once for each different change of theirs and are cached by Spark
    while the cases that share them run. A case that starts in a regime the model lacks is left out.
    """
    pooled = pooled_history(history, len(moves))
    walks: dict[int, DataFrame] = {}
    out = None
    for name, career_, scenario, rule, path, sex in cases:
        at = scenario.get("start", start)
        if at >= len(moves):
            continue
        if at not in walks:
            walks[at] = regime_paths(spark, pooled, n, months, moves, at).persist()
        career = replace(Career(), **career_)
        made = pension.pensions(returns_of(walks[at], haircut=scenario.get("haircut", 0.0)), sex, factor_of(sex, None), career, replace(Reactive(), **rule), replace(Glidepath(), **path))
        made = made.withColumn("case", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return comparison(out, ["case"])


def market_scenarios(spark: SparkSession, history: DataFrame, moves: list[list[float]], start: int, factor_of, n: int, months: int = 480, markets=MARKETS) -> DataFrame:
    """(market, sex, ...): the comparison where each fund's mean is that of a market view."""
    walked = regime_paths(spark, pooled_history(history, len(moves)), n, months, moves, start)
    out = None
    for name, market in markets.items():
        paths = returns_of(walked) if market is None else recentred(walked, pension.target_returns(market))
        for sex in ("H", "M"):
            made = pension.pensions(paths, sex, factor_of(sex, None)).withColumns({"market": F.lit(name), "sex": F.lit(sex)})
            out = made if out is None else out.unionByName(made)
    return comparison(out, ["market", "sex"])


def pension_bootstrap(spark: SparkSession, x: np.ndarray, model: Regimes, n: int, scenarios: int, factor: float, months: int = 480, mean_block: float = 12.0, seed: int = 1, career: Career = Career(), sex: str = "H") -> DataFrame:
    """(replica, premium, ...): the comparison on resampled histories, the model fitted anew to each.

    A replica's history and model become one row; its scenarios start in the regime in
    which the original history ends. Replicas whose fit fails are left out.
    """
    first = int(model.posterior[-1].argmax())
    shared = spark.sparkContext.broadcast((x, model))

    def run(replica):
        x, base = shared.value
        rng = np.random.default_rng([seed, replica])
        t = len(x)
        new, at = rng.random(t) < 1 / mean_block, rng.integers(0, t, t)
        new[0] = True
        block = np.maximum.accumulate(np.where(new, np.arange(t), 0))
        drawn = x[(at[block] + np.arange(t) - block) % t]
        try:
            made = aligned(fit(drawn, base.k, 2, int(rng.integers(2**31)), base), base)
        except np.linalg.LinAlgError:
            return []
        label = made.posterior.argmax(1)
        pools = [np.flatnonzero(label == k).tolist() or np.flatnonzero(label == label[np.argmin(np.abs(label - k))]).tolist() for k in range(base.k)]
        year = np.exp(np.log1p(drawn).mean(0) * 12) - 1
        return [{"rows": drawn.tolist(), "pools": pools, "sums": np.cumsum(made.moves, 1).tolist(), "premium": float(year[0] - year[-1])}]

    made = replicas(spark, n, run, "rows array<array<double>>, pools array<array<int>>, sums array<array<double>>, premium double").persist()
    paths = made.withColumn("path_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(scenarios - 1).cast("bigint"))))
    paths = paths.withColumn("picks", _walk(first, months, model.k)).withColumn("path_id", F.struct("replica", "path_id"))
    pays = pension.pensions(returns_of(paths), sex, factor, career).select(F.col("path_id.replica").alias("replica"), F.col("path_id.path_id").alias("path_id"), "strategy", "pension", "switches")
    return comparison(pays, ["replica"]).join(made.select("replica", "premium"), "replica")


def _walk(first: int, months: int, k: int) -> Column:
    """History rows drawn month by month with the row's own pools and transitions."""

    def month(s, t):
        pool = F.get(F.col("pools"), s["now"])
        pick = F.get(pool, F.floor(uniform("boot-row", F.col("replica"), F.col("path_id"), t) * F.size(pool)).cast("int"))
        after = let(uniform("boot-move", F.col("replica"), F.col("path_id"), t), lambda v: F.least(F.aggregate(F.get(F.col("sums"), s["now"]), F.lit(0), lambda c, x: c + (v > x).cast("int")), F.lit(k - 1)))
        return F.struct(after.alias("now"), F.concat(s["picks"], F.array(pick)).alias("picks"))

    zero = F.struct(F.lit(first).alias("now"), F.array().cast("array<int>").alias("picks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(months - 1)), zero, month, lambda s: s["picks"])


def grid_points(grid: dict = GRID) -> list[tuple[float, float, float]]:
    return [(g0, a1, g1) for g0 in grid["g0"] for a1 in grid["a1"] for g1 in grid["g1"] if g1 <= g0]


def grid_pensions(paths: DataFrame, weights: list[list[list[float]]], paid: list[float]) -> DataFrame:
    """(path_id, point, balance) for many mixes: a block of paths and all mixes move on together, month by month."""
    shared = paths.sparkSession.sparkContext.broadcast((np.array(weights, float), np.array(paid, float)))

    def run(batches):
        w, a = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 250):
                part = pdf.iloc[at : at + 250]
                cube = np.array([[list(m) for m in p[: len(a)]] for p in part["path"]], float)
                total = np.zeros((len(part), len(w)))
                for t in range(len(a)):
                    total = (total + a[t]) * (1 + cube[:, t] @ w[:, t].T)
                yield pd.DataFrame({"path_id": np.repeat(part["path_id"].to_numpy(), len(w)), "point": np.tile(np.arange(len(w)), len(part)), "balance": total.ravel()})

    return paths.select("path_id", "path").mapInPandas(run, "path_id long, point int, balance double")


def glidepath_search(train: DataFrame, test: DataFrame, sex: str, factor: float, gamma: float = 3.0, career: Career = Career(), reform: Reform = Reform(), grid: dict = GRID, with_reform: bool = True):
    """(grid table, comparison): certainty equivalents of a family of glidepaths on training paths; the best
    point against the official path, the law and fixed funds on test paths. Candidates always extrapolate."""
    spark = train.sparkSession
    months = pension.ages(career, sex)
    retire_at = career.start_age + len(months) // 12
    own, employer, bond, last = pension.layer_contributions(career, sex, reform)
    paid = [a + b * with_reform for a, b in zip(own, employer, strict=True)]
    fixed = bond / factor * with_reform
    points = grid_points(grid)
    mix = lambda p: [pension.replicated(Glidepath(), pension.family_share(a, *p, retire_at)) for a in months]

    def paidout(paths, mixes):
        rows = grid_pensions(paths, mixes, paid).withColumn("base", F.col("balance") / factor + fixed)
        return rows.withColumn("pension", F.col("base") + (pension.flat_benefit(F.col("base"), reform) if with_reform else F.lit(0.0)))

    q = lambda p: F.percentile("pension", F.lit(p))
    measure = [certainty_equivalent(F.col("pension"), gamma).alias("ce"), q(0.5).alias("median"), q(0.05).alias("p5")]
    named = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point int, g0 double, a1 double, g1 double")
    table = paidout(train, [mix(p) for p in points]).groupBy("point").agg(*measure).join(F.broadcast(named), "point")
    best = table.agg(F.max_by(F.struct("g0", "a1", "g1"), F.struct("ce", F.negative("g0"), F.negative("a1"), F.negative("g1"))).alias("b")).first()["b"]
    mixes = pension.strategies(months, sex)
    chosen = {"best of family": mix(tuple(best)), "official": mixes[pension.LIFECYCLE], "by law": mixes[pension.DEFAULT], **{f"fund {f}": mixes[f"fund {f}"] for f in "ACE"}}
    names = spark.createDataFrame(list(enumerate(chosen)), "point int, strategy string")
    compared = paidout(test, list(chosen.values())).groupBy("point").agg(*measure).join(F.broadcast(names), "point")
    official = compared.where(F.col("strategy") == "official").select(F.col("ce").alias("_o"))
    compared = compared.crossJoin(F.broadcast(official)).select("strategy", "ce", "median", "p5", (F.col("median") / last).alias("replacement"), (F.col("ce") / F.col("_o") - 1).alias("over_official"))
    return table.drop("point"), compared.withColumns({"g0": F.lit(best["g0"]), "a1": F.lit(best["a1"]), "g1": F.lit(best["g1"])})


#: Candidates of a round of the search for a rate; two rounds come to 1 / SECTIONS^2 of the range.
SECTIONS = 175


def break_even(paths: DataFrame, surcharges: list[float], career: Career = Career(), sex: str = "H", high: float = 0.03, sections: int = SECTIONS) -> DataFrame:
    """(surcharge, break_even): the extra yearly return that makes a contribution worth that of a larger one.

    Two rounds in one plan: the medians of all candidates from 0 to ``high`` say between which two the
    goal of each surcharge lies, and those of as many candidates in between say where. A candidate
    x lifts the growth of t months by (1 + x)^(t / 12), so that all candidates of a block of paths
    are one product of matrices; their medians are ranked exactly. A goal beyond ``high`` gives ``high``.
    """
    months = pension.ages(career, sex)
    paid = np.array(pension.contributions(career, pension.salaries(career, months)))
    left = np.arange(len(months), 0, -1) / 12
    grown = population.growths(paths, {pension.DEFAULT: pension.strategies(months, sex)[pension.DEFAULT]})

    def lifted(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            weighed = np.stack(pdf["growth"].to_numpy()).astype(float) * paid
            for _, own in pdf.assign(_at=np.arange(len(pdf))).groupby("surcharge", dropna=False):
                low, step = float(own["low"].iloc[0]), float(own["step"].iloc[0])
                x = low + step * np.arange(sections + 1)
                made = weighed[own["_at"].to_numpy()] @ (1 + x[None, :]) ** left[:, None]
                yield pd.DataFrame({"surcharge": np.repeat(own["surcharge"].to_numpy(), len(x)), "x": np.tile(x, len(own)), "balance": made.ravel()})

    def medians(ranges: DataFrame) -> DataFrame:
        candidates = grown.select("growth").crossJoin(F.broadcast(ranges)).mapInPandas(lifted, "surcharge double, x double, balance double")
        return exact_percentiles(candidates, ["surcharge", "x"], "balance", {"median": 0.5})

    spark = paths.sparkSession
    first = cut(medians(spark.createDataFrame([(0.0, 0.0, high / sections)], "surcharge double, low double, step double")).select("x", "median"))
    wanted = spark.createDataFrame([(float(s),) for s in surcharges], "surcharge double")
    base = first.where("x = 0").select(F.col("median").alias("base"))
    goals = wanted.crossJoin(F.broadcast(base)).select("surcharge", (F.col("base") * (1 + F.col("surcharge") / career.contribution)).alias("goal"))

    def below(found: DataFrame) -> DataFrame:
        """The last candidate under each goal; the first one if none is."""
        return found.groupBy("surcharge", "goal").agg(F.coalesce(F.max(F.when(F.col("median") < F.col("goal"), F.col("x"))), F.min("x")).alias("low"))

    narrow = below(F.broadcast(goals).crossJoin(first)).select("surcharge", "goal", F.least("low", F.lit(high * (1 - 1 / sections))).alias("low"))
    second = medians(narrow.select("surcharge", "low", F.lit(high / sections / sections).alias("step")))
    last = below(second.join(F.broadcast(goals), "surcharge"))
    return last.select("surcharge", F.least(F.col("low") + high / sections / sections / 2, F.lit(high)).alias("break_even"))
