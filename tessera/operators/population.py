"""Micro-simulation of a cohort: incomes, densities, spells of work, pensions by person and scenario.

A balance is linear in the contributions: with G the growth from each month to retirement
(scenarios x months), all balances of people with contributions A are A G'. Both are cut into blocks
of rows; every block of people meets every block of scenarios in a task of its own, which
holds two blocks and their product. Neither side is collected or broadcast, so the numbers
of both are free.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Career, Population, Reform, month_no
from tessera.functions.numerics import beta_quantile, normal_cdf, normal_quantile
from tessera.functions.random import uniform
from tessera.operators import pension
from tessera.operators.scenarios import formal_months
from tessera.operators.stats import exact_percentiles, quintiles

#: Cells of a block of contributions (people x months) or of growths (scenarios x months), about.
BLOCK_CELLS = 500_000


def people(spark: SparkSession, n: int, c: Population = Population(), sex: str | None = None, stream: str = "person") -> DataFrame:
    """(person, sex, income, density): log-normal incomes, beta densities, tied by a normal copula."""
    ids = spark.range(n).withColumnRenamed("id", "person")
    named = ids.select("person", (F.lit(sex) if sex else F.when(uniform(f"{stream}-sex", F.col("person")) < c.women, "M").otherwise("H")).alias("sex"))
    return drawn(named, F.col("sex"), F.col("sex"), c, stream)


def drawn(named: DataFrame, income_of: Column, density_of: Column, c: Population = Population(), stream: str = "person") -> DataFrame:
    """Adds income and density to (person, ...), each from the distribution of the sex that its column says; the same person draws the same ranks."""
    ranks = [uniform(f"{stream}-{k}", F.col("person")).alias(f"_u{k}") for k in (1, 2)]
    kept = named.columns

    def draw(batches):
        for pdf in batches:
            z1, z2 = (normal_quantile(pdf[f"_u{k}"].to_numpy() + 2.0**-33) for k in (1, 2))
            tied = normal_cdf(c.correlation * z1 + math.sqrt(1 - c.correlation**2) * z2)
            income, density = np.empty(len(pdf)), np.empty(len(pdf))
            for s in ("H", "M"):
                of = (pdf["_income_of"] == s).to_numpy()
                median, mean = (v / c.unit for v in c.income[s])
                income[of] = median * np.exp(math.sqrt(2 * math.log(mean / median)) * z1[of])
                of = (pdf["_density_of"] == s).to_numpy()
                density[of] = beta_quantile(tied[of], c.density[s] * c.concentration, (1 - c.density[s]) * c.concentration)
            yield pdf[kept].assign(income=np.clip(income, c.income_floor, c.income_cap), density=np.clip(density, 0.01, 0.99))

    kinds = ", ".join(f"`{k}` {t}" for k, t in named.dtypes)
    return named.select("*", *ranks, income_of.alias("_income_of"), density_of.alias("_density_of")).mapInPandas(draw, f"{kinds}, income double, density double")


def growths(paths: DataFrame, mixes: dict[str, list[list[float]]]) -> DataFrame:
    """(scenario, strategy, growth): growth from each month to the end, under each mix's weights by month; scenarios are path ids."""
    by_mix = [F.struct(F.lit(n).alias("strategy"), pension.portfolio(F.col("path"), w).alias("r")) for n, w in mixes.items()]

    def grow(batches):
        for pdf in batches:
            grown = [np.cumprod(1 + np.asarray(r, float)[::-1])[::-1] for r in pdf["r"]]
            yield pdf[["scenario", "strategy"]].assign(growth=grown)

    returns = paths.select(F.col("path_id").cast("int").alias("scenario"), F.inline(F.array(*by_mix)))
    return returns.mapInPandas(grow, "scenario int, strategy string, growth array<double>")


def career_growths(paths: DataFrame, sex: str, career: Career = Career(), retire_at: int | None = None, names: tuple[str, ...] = (pension.DEFAULT, pension.LIFECYCLE)) -> DataFrame:
    """The growths of a career under some strategies; a table that several cohorts may share."""
    mixes = pension.strategies(pension.ages(career, sex, retire_at), sex)
    return growths(paths, {n: mixes[n] for n in names})


def balances(rows: DataFrame, keys: list[str], contributions: dict[str, str], grown: DataFrame, months: int, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(keys, scenario, strategy, name...): for each array column of contributions its balance under each growth.

    ``contributions`` maps output names to array columns of as many months as the growths have. Blocks of
    either side have about ``block_cells`` cells; a block is copied once for each block of the other side.
    """
    names = list(contributions)
    per_block = max(1, block_cells // max(1, months))
    n_rows, n_grown = (-(-df.count() // per_block) or 1 for df in (rows.select(*keys), grown.select("scenario")))
    kinds = dict(rows.dtypes)
    # Both sides must name blocks by the same type: equal numbers of other types are hashed to other partitions.
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_by = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    left = rows.select(*keys, *[F.col(c).alias(n) for n, c in contributions.items()], dealt_by(keys, n_rows).alias("_rows"))
    right = grown.select("scenario", "strategy", "growth", dealt_by(["scenario", "strategy"], n_grown).alias("_grown"))
    out = [*keys, "scenario", "strategy", *names]

    def product(a: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(g):
            return pd.DataFrame(columns=out)
        growth = np.stack(g["growth"].to_numpy()).astype(float)
        made = {n: (np.stack(a[n].to_numpy()).astype(float) @ growth.T).ravel() for n in names}
        tiled = {c: np.tile(g[c].to_numpy(), len(a)) for c in ("scenario", "strategy")}
        return pd.DataFrame({k: np.repeat(a[k].to_numpy(), len(g)) for k in keys} | tiled | made)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "scenario int, strategy string", *(f"`{n}` double" for n in names)])
    dealt = left.withColumn("_grown", every(n_grown)).groupBy("_rows", "_grown")
    return dealt.cogroup(right.withColumn("_rows", every(n_rows)).groupBy("_rows", "_grown")).applyInPandas(product, schema)


def _with_careers(cohort: DataFrame, sex: str, career: Career, reform: Reform, c: Population, retire_at: int | None, employer: bool):
    """Adds months of work, contributions of each kind by month, the bond's value and the last salary."""
    unit = replace(career, salary=1.0)
    months = pension.ages(unit, sex, retire_at)
    paid = pension.salaries(unit, months)
    at = max(0, min((c.income_age - career.start_age) * 12, len(months) - 1))
    shape = pension.literal([p / paid[at] for p in paid])
    start, n = month_no(career.start_year, 1), len(months)
    rates = [pension.rate_at(reform.employer, start + t) * employer for t in range(n)]
    bonds = [pension.rate_at(reform.bond, start + t) * employer * (1 + reform.bond_rate) ** ((n - t) / 12) for t in range(n)]
    rows = cohort.withColumn("salaries", F.transform(shape, lambda s: F.least(F.col("income") * s, F.lit(c.income_cap))))
    rows = rows.withColumn("works", formal_months(F.col("density"), F.col("person"), n, c.spell))
    rows = rows.withColumn("base", F.zip_with("salaries", "works", lambda s, w: s * w))
    by = lambda v: F.zip_with("base", pension.literal(v), lambda s, r: s * r)
    worked = F.aggregate("works", F.lit(0), lambda s, x: s + x) / n
    rows = rows.select(
        *cohort.columns, worked.alias("worked"), F.element_at("salaries", -1).alias("last_salary"), F.transform("base", lambda s: s * career.contribution).alias("own_paid"),
        by(rates).alias("employer_paid"), F.aggregate(by(bonds), F.lit(0.0), lambda s, x: s + x).alias("bond_value"),
    )
    return rows


def cohort_balances(cohort: DataFrame, paths: DataFrame, sex: str, career: Career = Career(), reform: Reform = Reform(), c: Population = Population(), retire_at: int | None = None, employer: bool = True, grown: DataFrame | None = None) -> DataFrame:
    """(cohort..., worked, last_salary, scenario, strategy, own, employer, bond): what people of one sex have saved at retirement."""
    rows = _with_careers(cohort, sex, career, reform, c, retire_at, employer)
    grown = career_growths(paths, sex, career, retire_at) if grown is None else grown
    facts = [*cohort.columns, "worked", "last_salary", "bond_value"]
    made = balances(rows, facts, {"own": "own_paid", "employer": "employer_paid"}, grown, len(pension.ages(career, sex, retire_at)))
    return made.withColumnRenamed("bond_value", "bond")


def priced(saved: DataFrame, factor: Column, reform: Reform = Reform(), flat_up_to: Column | None = None) -> DataFrame:
    """Balances as pensions by the price of an annuity, with the flat benefit and the total."""
    made = saved.withColumns({n: F.col(n) / factor for n in ("own", "employer", "bond")})
    base = F.col("own") + F.col("employer") + F.col("bond")
    eligible = F.lit(True) if flat_up_to is None else F.col("income") <= flat_up_to
    made = made.withColumn("flat", F.when(eligible, pension.flat_benefit(base, reform)).otherwise(0.0))
    return made.withColumn("total", base + F.col("flat"))


def cohort_pensions(cohort: DataFrame, paths: DataFrame, sex: str, factor: float, career: Career = Career(), reform: Reform = Reform(), c: Population = Population(), retire_at: int | None = None, employer: bool = True, flat_up_to: Column | None = None, grown: DataFrame | None = None) -> DataFrame:
    """(person, scenario, strategy, own, employer, bond, flat, total, last_salary, income, worked) of one sex.

    ``grown`` are the growths of these paths, sex, career and age if they are known already.
    """
    saved = cohort_balances(cohort, paths, sex, career, reform, c, retire_at, employer, grown)
    return priced(saved, F.lit(float(factor)), reform, flat_up_to).drop("density")


def cohort_summary(made: DataFrame, goal: float, by_quintile: bool) -> DataFrame:
    """Medians and shares by sex, and by quintile of income within it if asked; persons by their median scenario.

    All medians of groups of people come from one exact ranking of (metric, value); only a
    person's own scenarios are held together. A person's sex and income are the same in all rows.
    """
    keys = ["sex", "quintile"] if by_quintile else ["sex"]
    if by_quintile:
        made = quintiles(made, ["sex"], "income", large=True, of=made.select("person", "sex", "income").distinct())
    last = F.greatest(F.col("last_salary"), F.lit(1e-9))
    default = made.where(F.col("strategy") == pension.DEFAULT).select(*keys, "person", "own", "total", "flat", (F.col("own") / last).alias("own_rate"), (F.col("total") / last).alias("total_rate"))
    plain = default.groupBy(*keys).agg(
        F.count_distinct("person").alias("people"), F.avg((F.col("total_rate") >= goal).cast("double")).alias("reach"), F.avg((F.col("flat") > 0.5 * F.col("total")).cast("double")).alias("mostly_flat"),
    )
    wide = made.groupBy("person", "scenario", *keys).agg(*[F.max(F.when(F.col("strategy") == s, F.col("total"))).alias(n) for s, n in ((pension.DEFAULT, "d"), (pension.LIFECYCLE, "l"))])
    person = wide.groupBy("person", *keys).agg(F.min("d").alias("least"), F.percentile(F.try_divide(F.col("l"), F.col("d")), F.lit(0.5)).alias("ratio"))
    person = person.withColumn("lifecycle_gain", F.when(F.col("least") > 0, F.col("ratio") - 1))
    gains = person.groupBy(*keys).agg(F.avg((F.col("lifecycle_gain") > 0).cast("double")).alias("gainers"), F.avg((F.col("least") <= 0).cast("double")).alias("without"))
    metrics = ["own", "total", "own_rate", "total_rate", "flat"]
    long = default.unpivot(keys, metrics, "metric", "value").unionByName(person.unpivot(keys, ["lifecycle_gain"], "metric", "value"))
    middle = exact_percentiles(long, [*keys, "metric"], "value", {"p50": 0.5})
    medians = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == m, F.col("p50"))).alias(m) for m in [*metrics, "lifecycle_gain"]])
    return plain.join(medians, keys).join(gains, keys)


def _effects(factors: list[str]) -> Column:
    """(factor, weight) of the value of a coalition ``mask`` in every factor's mean marginal effect over all orders."""
    n = len(factors)
    orders = {k: math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) for k in range(n)}

    def weight(others: Column) -> Column:
        return F.coalesce(*[F.when(others == k, w) for k, w in orders.items()])

    size = F.bit_count("mask")
    inside = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    return F.array(*[F.struct(F.lit(f).alias("factor"), F.when(inside(k), weight(size - 1)).otherwise(-weight(size)).alias("weight")) for k, f in enumerate(factors)])


def shapley(values: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, share): each factor's mean marginal effect over all orders, from (mask, value) of every coalition.

    Bit k of the mask stands for factors[k]. An effect is a weighted sum of the values of all coalitions: one aggregation.
    """
    return values.select("value", F.inline(_effects(factors))).groupBy("factor").agg(F.sum(F.col("weight") * F.col("value")).alias("share"))


GAP_FACTORS = ["density", "income", "retirement", "mortality"]
#: The mask under which men stand beside the coalitions of women.
MEN = -1


def gap_parts(rows: DataFrame, factors: list[str], value: str = "total") -> DataFrame:
    """(factor, share, of_men): parts of the gap between the medians of men and of women, and what they don't explain.

    ``rows`` are pensions by ``mask``: women's in every coalition of factors, in which those of the
    mask are men's, and men's under MEN. All medians are ranked exactly in one plan, and
    the parts are weighted sums of them.
    """
    values = exact_percentiles(rows, ["mask"], value, {"value": 0.5})
    every = (1 << len(factors)) - 1
    rest = F.array(F.struct(F.lit("not explained").alias("factor"), F.when(F.col("mask") == MEN, 1.0).when(F.col("mask") == every, -1.0).otherwise(0.0).alias("weight")))
    none = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(0.0).alias("weight")) for f in factors])
    parts = F.concat(F.when(F.col("mask") == MEN, none).otherwise(_effects(factors)), rest)
    made = values.select("mask", "value", F.inline(parts)).groupBy("factor").agg(F.sum(F.col("weight") * F.col("value")).alias("share"), F.max(F.when(F.col("mask") == MEN, F.col("value"))).alias("men"))
    return made.select("factor", "share", (F.col("share") / F.col("men")).alias("of_men"))


def gap_rows(spark: SparkSession, paths: DataFrame, factor_of, n: int, career: Career = Career(), c: Population = Population()) -> DataFrame:
    """(person, scenario, mask, total) of women in every coalition of GAP_FACTORS, and of men.

    A person draws the same ranks and spells in every case. Careers are made once for each
    density, income and age of retirement, and both tables of mortality price the same balances.
    """
    ids = spark.range(n).withColumnRenamed("id", "person")
    bit = lambda k: F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
    sex_of = lambda k: F.when(bit(k), "H").otherwise("M")
    women = ids.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in range(4)])))
    women = drawn(women, sex_of(1), sex_of(0), c).withColumn("sex", F.lit("M"))
    out = None
    for late, age in enumerate((60, 65)):
        saved = cohort_balances(women, paths, "M", career, c=c, retire_at=age, grown=career_growths(paths, "M", career, age, (pension.DEFAULT,)))
        mortality = F.explode(F.array(*[F.struct(F.lit(k).alias("men"), F.lit(float(factor_of("MH"[k], age))).alias("factor")) for k in (0, 1)]))
        both = saved.withColumn("_priced", mortality)
        made = priced(both, F.col("_priced.factor")).withColumn("mask", F.col("mask") + 4 * late + 8 * F.col("_priced.men"))
        made = made.select("person", "scenario", "mask", "total")
        out = made if out is None else out.unionByName(made)
    men = cohort_balances(people(spark, n, c, "H"), paths, "H", career, c=c, grown=career_growths(paths, "H", career, None, (pension.DEFAULT,)))
    return out.unionByName(priced(men, F.lit(float(factor_of("H", 65)))).select("person", "scenario", F.lit(MEN).alias("mask"), "total"))


def gender_gap(spark: SparkSession, paths: DataFrame, factor_of, n: int, career: Career = Career(), c: Population = Population()) -> DataFrame:
    """Shapley parts of the gap in the median total pension of women against men, and what they don't explain.

    ``factor_of(sex of the table, age)`` prices the annuity.
    """
    return gap_parts(gap_rows(spark, paths, factor_of, n, career, c), GAP_FACTORS)
