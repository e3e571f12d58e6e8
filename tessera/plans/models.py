"""Queries of the fitted models and large studies. Most have no SQL; those that do are fixed sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FUNDS, Career
from tessera.operators import macro_regimes, pension, population, regimes, scenarios, stats, studies, volatility
from tessera.plans import tables as t
from tessera.plans.relational import rounded
from tessera.plans.simulation import _DENSITY, _HISTORY, MOVES, _u, _walk, history, paths

QUERIES, SQL = {}, {}
_FACTOR = {"H": 150.0, "M": 190.0}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _factor(sex, age):
    return _FACTOR[sex] + (5 * (65 - age) if age else 0)


def _fitted(spark, sf_dir, k: int = 2):
    x = regimes.matrix(history(spark, sf_dir))
    return x, regimes.unpacked(regimes.select_regimes(spark, x, (k,), 10).first())


@query()
def hmm_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = regimes.matrix(history(spark, sf_dir))
    made = regimes.select_regimes(spark, x, starts=10)
    least = made.agg(F.min("bic").alias("_b"))
    return made.crossJoin(F.broadcast(least)).select("k", "loglik", "bic", (F.col("bic") == F.col("_b")).alias("chosen"))


@query()
def regime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _fitted(spark, sf_dir)
    return spark.createDataFrame(regimes.regime_rows(model, list(FUNDS)), "regime int, fund string, annual_return double, annual_vol double, months double, share double")


@query()
def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.garch_by_series(t.fund_months(spark, sf_dir), "fund", "month", "r", 12)


@query()
def garch_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.garch_bootstrap(t.fund_months(spark, sf_dir), "fund", "month", "r", 4, per_year=12)


@query()
def hmm_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, model = _fitted(spark, sf_dir)
    return regimes.bootstrap(spark, x, model, list(FUNDS), 8)


@query()
def tvtp_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of refits every 12 months from month 48, driven by last month's mean return and its size."""
    import numpy as np

    x = regimes.matrix(history(spark, sf_dir))
    mean = np.r_[0.0, x.mean(1)[:-1]]
    return macro_regimes.walk_forward(spark, x, np.column_stack([mean, np.abs(mean)]), 48, k=2, starts=3)


@query()
def pension_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, model = _fitted(spark, sf_dir)
    return studies.pension_bootstrap(spark, x, model, 4, 50, _FACTOR["H"], 180, career=Career(start_age=50))


@query()
def robustness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.config import ROBUSTNESS

    cases = tuple((n, {"start_age": 45, **c}, s, r, g, x) for n, c, s, r, g, x in ROBUSTNESS)
    return studies.robustness(spark, history(spark, sf_dir), MOVES, 0, _factor, 40, cases, 240)


@query()
def market_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.market_scenarios(spark, history(spark, sf_dir), MOVES, 0, _factor, 20)


@query()
def predictive_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of what varying transitions gain in log score over constant ones."""
    from pyspark.sql import Window

    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return tvtp_walk_forward(spark, sf_dir).select("t", F.sum(F.col("macro") - F.col("constant")).over(upto).alias("advantage"))


@query()
def glidepath_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [scenarios.returns_of(scenarios.regime_paths(spark, scenarios.pooled_history(history(spark, sf_dir), len(MOVES)), 60, 180, MOVES, 0, s)) for s in ("train", "test")]
    grid = {"g0": (0.6, 0.8, 1.0), "a1": (50, 55, 60), "g1": (0.08, 0.3, 0.6)}
    return studies.glidepath_search(*sets, "H", _FACTOR["H"], career=Career(start_age=50), grid=grid)[1]


_N, _HIGH, _SURCHARGES = studies.SECTIONS, 0.03, [0.001, 0.005, 0.0099]
_BELOW = "coalesce(max(x) FILTER (WHERE median < goal), min(x))"


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(60, 180)},
port AS (SELECT p, t, CASE WHEN 50 + t // 12 <= 55 THEN ret[3] ELSE ret[4] END AS r FROM drawn),
grown AS (SELECT p, t, pow(1.015::DOUBLE, least(50 + t // 12, 50) - 50) * exp(sum(ln(1 + r)) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port),
tried AS (SELECT k, {_HIGH / _N!r}::DOUBLE * k AS x FROM (SELECT unnest(range({_N + 1})) AS k)),
first_ AS (SELECT k, x, median(b) AS median FROM (SELECT p, k, x, sum(g * pow(1 + x, (180 - t) / 12.0::DOUBLE)) AS b FROM grown, tried GROUP BY p, k, x) GROUP BY k, x),
goals AS (SELECT s AS surcharge, (SELECT median FROM first_ WHERE k = 0) * (1 + s / 0.10::DOUBLE) AS goal FROM (SELECT unnest({_SURCHARGES}::DOUBLE[]) AS s)),
narrow AS (SELECT surcharge, goal, least({_BELOW}, {_HIGH * (1 - 1 / _N)!r}::DOUBLE) AS low FROM goals, first_ GROUP BY surcharge, goal),
second_ AS (
  SELECT surcharge, goal, x, median(b) AS median FROM (
    SELECT surcharge, goal, p, low + {_HIGH / _N / _N!r}::DOUBLE * k AS x, sum(g * pow(1 + low + {_HIGH / _N / _N!r}::DOUBLE * k, (180 - t) / 12.0::DOUBLE)) AS b
    FROM grown, tried, narrow GROUP BY surcharge, goal, p, low, k) GROUP BY surcharge, goal, x)
SELECT surcharge, round(least({_BELOW} + {_HIGH / _N / _N / 2!r}::DOUBLE, {_HIGH}), 8) AS break_even FROM second_ GROUP BY surcharge, goal""")
def fee_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = studies.break_even(scenarios.returns_of(paths(spark, sf_dir, 60, 180)), _SURCHARGES, Career(start_age=50), high=_HIGH)
    return rounded(found, 8, "break_even")


@query()
def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.returns_of(paths(spark, sf_dir, 20, 240)).persist()
    career, out = Career(start_age=45), None
    cohort = population.people(spark, 200).persist()
    top = stats.exact_percentiles(cohort, [], "income", {"top": 0.9}).first()["top"]
    for sex in "HM":
        one = population.cohort_pensions(cohort.where(F.col("sex") == sex), made, sex, _FACTOR[sex], career, flat_up_to=F.lit(top))
        out = one if out is None else out.unionByName(one)
    return population.cohort_summary(out.persist(), 0.4, by_quintile=True)


@query("""WITH people AS (SELECT c_custkey AS person, CASE WHEN c_nationkey % 2 = 0 THEN 'H' ELSE 'M' END AS sex, greatest(CAST(c_acctbal AS DOUBLE), 0.0::DOUBLE) AS income FROM customer),
edges AS (SELECT sex, quantile_cont(income, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS e FROM people GROUP BY sex),
cut AS (SELECT person, sex, income, CASE WHEN income <= e[1] THEN 1 WHEN income <= e[2] THEN 2 WHEN income <= e[3] THEN 3 WHEN income <= e[4] THEN 4 ELSE 5 END AS quintile FROM people JOIN edges USING (sex)),
made AS (
  SELECT person, sex, quintile, k, s, income * (1 + 0.05::DOUBLE * k + 0.02::DOUBLE * s * ((person + k * k) % 5 - 2)) AS own,
         CASE WHEN person % 3 = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 2000 - 0.5::DOUBLE * income) END AS flat, 100 + income / 2 AS last
  FROM cut, (SELECT unnest(range(5)) AS k) ks, (SELECT unnest(range(2)) AS s) ss),
plain AS (
  SELECT sex, quintile, count(DISTINCT person) AS people, median(own) AS own, median(own + flat) AS total, median(own / last) AS own_rate, median((own + flat) / last) AS total_rate,
         avg(CAST((own + flat) / last >= 2.1::DOUBLE AS INT)) AS reach, avg(CAST(flat > 0.5::DOUBLE * (own + flat) AS INT)) AS mostly_flat, median(flat) AS flat
  FROM made WHERE s = 0 GROUP BY sex, quintile),
wide AS (SELECT person, sex, quintile, k, max(own + flat) FILTER (WHERE s = 0) AS d, max(own + flat) FILTER (WHERE s = 1) AS l FROM made GROUP BY person, sex, quintile, k),
person AS (SELECT sex, quintile, min(d) AS least, median(CASE WHEN d <> 0 THEN l / d END) AS ratio FROM wide GROUP BY person, sex, quintile),
gain AS (SELECT sex, quintile, least, CASE WHEN least > 0 THEN ratio - 1 END AS gain FROM person),
gains AS (SELECT sex, quintile, median(gain) AS lifecycle_gain, avg(CAST(gain > 0 AS INT)) AS gainers, avg(CAST(least <= 0 AS INT)) AS without FROM gain GROUP BY sex, quintile)
SELECT sex, quintile, people, round(own, 6) AS own, round(total, 6) AS total, round(own_rate, 6) AS own_rate, round(total_rate, 6) AS total_rate, round(reach, 6) AS reach, round(mostly_flat, 6) AS mostly_flat,
       round(flat, 6) AS flat, round(lifecycle_gain, 6) AS lifecycle_gain, round(gainers, 6) AS gainers, round(without, 6) AS without
FROM plain JOIN gains USING (sex, quintile)""")
def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a cohort by quintile, over all customers with pensions by formula in five scenarios."""
    person, k, s, income = F.col("person"), F.col("scenario"), F.col("s"), F.col("income")
    rows = t.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person"), F.when(F.col("c_nationkey") % 2 == 0, "H").otherwise("M").alias("sex"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("income"),
        F.explode(F.array(*map(F.lit, range(5)))).alias("scenario"),
    )
    rows = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("strategy", F.when(s == 0, pension.DEFAULT).otherwise(pension.LIFECYCLE))
    rows = rows.withColumn("own", income * (1 + 0.05 * k + 0.02 * s * ((person + k * k) % 5 - 2))).withColumn("flat", F.when(person % 3 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 2000 - 0.5 * income)))
    made = population.cohort_summary(rows.withColumn("total", F.col("own") + F.col("flat")).withColumn("last_salary", 100 + income / 2), 2.1, by_quintile=True)
    return rounded(made, 6, *[c for c in made.columns if c not in ("sex", "quintile", "people")])


@query()
def gender_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.returns_of(paths(spark, sf_dir, 10, 120)).persist()
    return population.gender_gap(spark, made, _factor, 60, Career(start_age=55))


# A pension by formula: the balance of a customer, with each factor's part of the men's case.
_LATTICE = "(1000 + c_acctbal / 10) * (1 + 0.2 * (mask & 1)) * (1 + 0.1 * ((mask >> 1) & 1) * (c_custkey % 5)) * (480 + 60 * ((mask >> 2) & 1)) / (190 - 40 * ((mask >> 3) & 1) - 25 * ((mask >> 2) & 1))"


@query(f"""WITH rows AS (
  SELECT mask, {_LATTICE} AS total FROM customer, (SELECT unnest(range(16)) AS mask)
  UNION ALL SELECT -1, {_LATTICE.replace("mask", "15")} * 1.07 + c_custkey % 3 FROM customer),
v AS (SELECT mask, median(total) AS value FROM rows GROUP BY mask),
f AS (SELECT * FROM (VALUES ('density', 1), ('income', 2), ('retirement', 4), ('mortality', 8)) AS f(factor, bit)),
w AS (SELECT factor, bit_count(a.mask) AS k, b.value - a.value AS gain FROM v a JOIN f ON a.mask >= 0 AND a.mask & bit = 0 JOIN v b ON b.mask = a.mask | bit),
men AS (SELECT value AS men FROM v WHERE mask = -1),
parts AS (
  SELECT factor, sum(gain * CASE k WHEN 0 THEN 1 / 4.0::DOUBLE WHEN 3 THEN 1 / 4.0::DOUBLE ELSE 1 / 12.0::DOUBLE END) AS share FROM w GROUP BY factor
  UNION ALL SELECT 'not explained', men - (SELECT value FROM v WHERE mask = 15) FROM men)
SELECT factor, round(share, 6) AS share, round(share / men, 8) AS of_men FROM parts, men""")
def gap_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a gap in medians over all customers in all 16 coalitions of factors, from pensions by formula."""
    bit = lambda k: F.shiftright("mask", k).bitwiseAND(1)
    customers = t.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")

    def total():
        return (1000 + F.col("c_acctbal") / 10) * (1 + 0.2 * bit(0)) * (1 + 0.1 * bit(1) * (F.col("c_custkey") % 5)) * (480 + 60 * bit(2)) / (190 - 40 * bit(3) - 25 * bit(2))

    women = customers.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("mask", total().alias("total"))
    men = customers.withColumn("mask", F.lit(15)).select(F.lit(population.MEN).alias("mask"), (total() * 1.07 + F.col("c_custkey") % 3).alias("total"))
    return rounded(population.gap_parts(women.unionByName(men), population.GAP_FACTORS), 6, "share").withColumn("of_men", F.round("of_men", 8))


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(10, 60)},
grown AS (SELECT p, t, exp(sum(ln(1 + ret[2])) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM drawn),
works AS (
  SELECT c_custkey, {_DENSITY} AS d, 0 AS t, CAST({_u("spell-first", "c_custkey")} < {_DENSITY} AS INT) AS s FROM customer
  UNION ALL SELECT c_custkey, d, t + 1, CASE WHEN s = 1 THEN CAST({_u("spell", "c_custkey", "t")} >= 1 / 36.0::DOUBLE AS INT) ELSE CAST({_u("spell", "c_custkey", "t")} < least(1.0::DOUBLE, d / (1 - d) * (1 / 36.0::DOUBLE)) AS INT) END
  FROM works WHERE t < 59)
SELECT c_custkey, CAST(p AS INT) AS scenario, round(sum(s * g), 6) AS balance FROM works JOIN grown ON works.t = grown.t GROUP BY c_custkey, p""")
def population_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of every customer under every scenario, as products of blocks."""
    made = scenarios.returns_of(paths(spark, sf_dir, 10, 60))
    growth = population.growths(made, {"fund B": [[0.0, 1.0, 0.0, 0.0, 0.0]] * 60})
    density = F.lit(0.2) + (F.col("c_custkey") % 7) / F.lit(10.0)
    rows = t.table(spark, sf_dir, "customer").select("c_custkey", scenarios.formal_months(density, F.col("c_custkey"), 60, 36.0).alias("paid"))
    return rounded(population.balances(rows, ["c_custkey"], {"balance": "paid"}, growth, 60).drop("strategy"), 6, "balance")


_MASKED = """masked AS (
  SELECT mask, o_totalprice * (1 + (mask & 1) * 0.1) * (1 - ((mask >> 1) & 1) * 0.05 * (1 + (mask & 1))) + ((mask >> 2) & 1) * 1000 AS x FROM orders, (SELECT unnest(range(8)) AS mask)),
v AS (SELECT mask, median(x) AS value FROM masked GROUP BY mask)"""


@query(f"""WITH {_MASKED},
f AS (SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 4)) AS f(factor, bit)),
w AS (SELECT factor, bit_count(v.mask) AS k, w.value - v.value AS gain FROM v JOIN f ON v.mask & bit = 0 JOIN v w ON w.mask = v.mask | bit)
SELECT factor, round(sum(gain * CASE k WHEN 0 THEN 1 / 3.0::DOUBLE WHEN 1 THEN 1 / 6.0::DOUBLE ELSE 1 / 3.0::DOUBLE END), 6) AS share FROM w GROUP BY factor""")
def shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three factors in the median order, from the medians of all eight coalitions."""
    bit = lambda k: F.shiftright("mask", k).bitwiseAND(1)
    masks = spark.range(8).select(F.col("id").cast("int").alias("mask"))
    x = F.col("o_totalprice") * (1 + bit(0) * 0.1) * (1 - bit(1) * 0.05 * (1 + bit(0))) + bit(2) * 1000
    values = t.table(spark, sf_dir, "orders").select("o_totalprice").crossJoin(F.broadcast(masks)).withColumn("x", x)
    values = stats.exact_percentiles(values, ["mask"], "x", {"value": 0.5}).drop("n")
    return rounded(population.shapley(values, ["a", "b", "c"]), 6, "share")
