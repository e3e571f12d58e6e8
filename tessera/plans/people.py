"""Queries of the actuarial and career operators over tables of people and real series, each with its DuckDB SQL.

Customers stand for people: sex and age follow from their numbers, balances are their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FUNDS, Career, Glidepath
from tessera.functions import folds
from tessera.operators import actuarial, pension, scenarios
from tessera.plans.relational import rounded
from tessera.plans.simulation import _B, _HISTORY, _LIFE, _NAMES, _W, _softmax_sql, _u, history
from tessera.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_SEX = "CASE WHEN c_nationkey % 2 = 0 THEN 'H' ELSE 'M' END"
_OLD = f"old AS (SELECT c_custkey, {_SEX} AS sex, CAST(60 + c_custkey % 31 AS INT) AS age, CAST(2026 + c_custkey % 7 AS INT) AS year, greatest(c_acctbal, 0) AS balance FROM customer)"


def _old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, sex, age, year, balance): customers as people of 60 to 90 who retire within seven years."""
    key = F.col("c_custkey")
    sex = F.when(F.col("c_nationkey") % 2 == 0, "H").otherwise("M")
    return table(spark, sf_dir, "customer").select("c_custkey", sex.alias("sex"), (60 + key % 31).cast("int").alias("age"), (2026 + key % 7).cast("int").alias("year"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"))


# The rates by the rule of the other actuarial queries, with the cases that there are among customers.
_RATES = _LIFE.split("cases AS")[0].rstrip().rstrip(",")
_YEARS = _LIFE[_LIFE.index("years AS") :]


@query(f"""WITH {_OLD}, {_RATES},
cases AS (SELECT DISTINCT sex, age, year FROM old), {_YEARS},
months AS (SELECT sex, age, year, (x - age) * 12 + m AS k, pow(1 - q, 1 / 12.0::DOUBLE) AS stay FROM years, (SELECT unnest(range(12)) AS m)),
alive AS (SELECT *, coalesce(product(stay) OVER (PARTITION BY sex, age, year ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive FROM months),
lived AS (SELECT *, product(1 - q) OVER (PARTITION BY sex, age, year ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM years),
factors AS (SELECT sex, age, year, sum(alive / pow(pow(1.0345::DOUBLE, 1 / 12.0::DOUBLE), k)) AS factor FROM alive GROUP BY ALL),
lives AS (SELECT sex, age, year, sum(alive) + 0.5 AS expectancy FROM lived GROUP BY ALL)
SELECT c_custkey, round(factor, 4) AS factor, round(expectancy, 4) AS expectancy, round(balance / factor, 4) AS pension
FROM old JOIN factors USING (sex, age, year) JOIN lives USING (sex, age, year)""")
def customer_annuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer's balance buys as an annuity at their sex, age and year of retirement, and how long they live."""
    people, life = _old(spark, sf_dir), actuarial.gompertz_table(spark)
    cases = people.select("sex", "age", "year").distinct()
    prices = actuarial.annuity_factors(cases, life).join(actuarial.life_expectancy(cases, life), ["sex", "age", "year"])
    made = people.join(prices, ["sex", "age", "year"])
    return rounded(made.select("c_custkey", "factor", "expectancy", (F.col("balance") / F.col("factor")).alias("pension")), 4, "factor", "expectancy", "pension")


@query(f"""WITH {_OLD}, {_RATES},
bought AS (SELECT c_custkey, sex, age, CAST(extract(year FROM o_orderdate) + 25 AS INT) AS year, count(*) AS orders FROM old JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, b.year, orders, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, q0 * coalesce(list_product([1 - (0.02 - i * 0.0005) FOR i IN range(1, least(16, b.year - 2020) + 1)]), 1)
       * pow(1 - (0.02 - 16 * 0.0005), greatest(0, b.year - 2020 - 16)))), 9) AS q
FROM bought b JOIN rates r ON r.sex = b.sex AND r.age = b.age""")
def customer_mortality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected rate of every customer in each year of their orders, 25 years on."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.year("o_orderdate") + 25).cast("int").alias("year"))
    bought = _old(spark, sf_dir).select("c_custkey", "sex", "age").join(orders, "c_custkey").groupBy("c_custkey", "sex", "age", "year").agg(F.count(F.lit(1)).alias("orders"))
    # A rate per sex, age and year: a table of some thousand rows, whatever the customers.
    rates = actuarial.rate_matrix(actuarial.gompertz_table(spark), 2020, 2060)
    return rounded(bought.join(F.broadcast(rates), ["sex", "age", "year"]).select("c_custkey", "year", "orders", "q"), 9, "q")


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


_PATH = Glidepath()
_HELD = _list(_PATH.fund_growth)


@query(f"""WITH young AS (SELECT c_custkey, {_SEX} AS sex, CAST(25 + c_custkey % 40 AS INT) AS age, c_acctbal AS balance FROM customer),
curve AS (SELECT *, {_list(_PATH.curve)}[age - 17] AS raw FROM young),
share AS (SELECT *, CASE WHEN age <= 63 THEN 0.29 + (raw - 0.29) * (0.95::DOUBLE - 0.29) / (0.90::DOUBLE - 0.29) ELSE raw END AS g0 FROM curve),
pair AS (SELECT *, greatest(g0, 0.082) AS g, CASE WHEN g0 >= 0.612 THEN 1 WHEN g0 >= 0.421 THEN 2 WHEN g0 >= 0.213 THEN 3 ELSE 4 END AS hi,
         CASE WHEN g0 >= 0.824 THEN 5 WHEN g0 >= 0.612 THEN 2 WHEN g0 >= 0.421 THEN 3 WHEN g0 >= 0.213 THEN 4 ELSE 5 END AS lo FROM share),
w AS (SELECT *, (g - {_HELD}[lo]) / ({_HELD}[hi] - {_HELD}[lo]) AS w FROM pair)
SELECT c_custkey, round(g, 6) AS growth, {", ".join(f"round(balance * CASE {k} WHEN hi THEN w WHEN lo THEN 1 - w ELSE 0 END, 4) + 0.0 AS {f.lower()}" for k, f in enumerate(FUNDS, 1))},
       CASE WHEN age <= 35 THEN 'B' WHEN age <= CASE WHEN sex = 'H' THEN 55 ELSE 50 END THEN 'C' ELSE 'D' END AS by_law FROM w""")
def customer_glidepath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's balance spread over the funds by the glidepath at their age, and the fund that the law gives them."""
    rows = []
    for age in range(25, 65):
        g = pension.growth_share(_PATH, age)
        rows += [(age, sex, float(max(g, _PATH.fund_growth[-1])), *map(float, pension.replicated(_PATH, g)), FUNDS[pension.by_law(age, sex).index(1.0)]) for sex in "HM"]
    funds = [f.lower() for f in FUNDS]
    by_age = spark.createDataFrame(rows, "age int, sex string, growth double, " + ", ".join(f"{f} double" for f in funds) + ", by_law string")
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "H").otherwise("M").alias("sex"), (25 + key % 40).cast("int").alias("age"), F.col("c_acctbal").alias("balance"))
    made = people.join(F.broadcast(by_age), ["age", "sex"])
    return made.select("c_custkey", F.round("growth", 6).alias("growth"), *[(F.round(F.col("balance") * F.col(f), 4) + 0.0).alias(f) for f in funds], "by_law")


@query(f"""WITH people AS (SELECT c_custkey, {_SEX} AS sex, 10 + greatest(c_acctbal, 0) / 500 AS salary FROM customer),
m AS (SELECT sex, CAST(unnest(range((until - 25) * 12)) AS INT) AS t FROM (VALUES ('H', 65), ('M', 60)) s(sex, until)),
grown AS (SELECT sex, t, pow(1.015::DOUBLE, least(CAST(25 + t // 12 AS INT), 50) - 25) AS g FROM m),
sums AS (SELECT sex, sum(g) AS g, arg_max(g, t) AS last, CAST(count(*) AS INT) AS months FROM grown GROUP BY sex)
SELECT c_custkey, months, round(salary * last, 5) AS last_salary, round(salary * g * 0.06, 4) AS paid FROM people JOIN sums USING (sex)""")
def customer_careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, last salary and all contributions of every customer's career, from a salary by their balance."""
    unit, shapes = Career(salary=1.0), []
    for sex in "HM":
        paid = pension.salaries(unit, pension.ages(unit, sex))
        shapes.append((sex, paid, pension.contributions(unit, paid)))
    shape = spark.createDataFrame(shapes, "sex string, salaries array<double>, paid array<double>")
    salary = 10 + F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 500
    people = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "H").otherwise("M").alias("sex"), salary.alias("salary"))
    made = people.join(F.broadcast(shape), "sex")
    total = lambda c: F.aggregate(F.transform(c, lambda s: s * F.col("salary")), F.lit(0.0), lambda a, s: a + s)
    return made.select("c_custkey", F.size("salaries").alias("months"), F.round(F.element_at("salaries", -1) * F.col("salary"), 5).alias("last_salary"), F.round(total("paid"), 4).alias("paid"))


REPLICAS = 40


@query(f"""WITH RECURSIVE {_HISTORY},
n AS (SELECT CAST(count(*) AS INT) AS n FROM history),
walk AS (
  SELECT path_id, 0 AS t, CAST(floor({_u("block-start", "path_id", "0")} * n) AS INT) AS i, n FROM (SELECT unnest(range({REPLICAS})) AS path_id), n
  UNION ALL SELECT path_id, t + 1, CASE WHEN {_u("block-new", "path_id", "t + 1")} < 1 / 12.0::DOUBLE THEN CAST(floor({_u("block-start", "path_id", "t + 1")} * n) AS INT) ELSE (i + 1) % n END, n
  FROM walk WHERE t < n - 1)
SELECT path_id, {", ".join(f"round(exp(sum(ln(1 + ret[{k}]))), 6) AS growth_{f.lower()}" for k, f in enumerate(FUNDS, 1))}, CAST(sum(CAST(label = 2 AS INT)) AS BIGINT) AS months_down
FROM walk JOIN history USING (i) GROUP BY path_id""")
def block_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the five funds, and months of falls, in histories drawn by blocks from the real one."""
    rows = history(spark, sf_dir).select("i", "ret", "label")
    drawn = scenarios.block_indices(spark, REPLICAS, rows.count(), 12.0)
    growth = lambda k: F.round(F.exp(F.sum(F.ln(1 + F.col("ret")[k]))), 6)
    made = drawn.join(F.broadcast(rows), "i").groupBy("path_id")
    return made.agg(*[growth(k).alias(f"growth_{f.lower()}") for k, f in enumerate(FUNDS)], F.sum((F.col("label") == 2).cast("int")).alias("months_down"))


def _cells(x: Column) -> list[Column]:
    return [p for i in range(3) for p in folds.softmax([F.lit(_B[i][j]) + F.lit(_W[i][j]) * x for j in range(3)])]


@query(f"""WITH days AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY ALL),
z AS (SELECT event_type, date, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM days WINDOW w AS (PARTITION BY event_type)),
each AS (SELECT event_type, {", ".join(f"{b} - ({a}) AS d{n[1:]}" for n, a, b in zip(_NAMES, _softmax_sql("z"), _softmax_sql("z + 1"), strict=True))} FROM z),
mean AS (SELECT event_type, count(*) AS days, {", ".join(f"avg(d{n[1:]}) AS d{n[1:]}" for n in _NAMES)} FROM each GROUP BY event_type)
SELECT event_type, days, {", ".join(f"round(d{n[1:]}, 6) AS d{n[1:]}, round({b} - ({a}), 6) AS m{n[1:]}" for n, a, b in zip(_NAMES, _softmax_sql("0.0::DOUBLE"), _softmax_sql("1.0::DOUBLE"), strict=True))} FROM mean""")
def marginal_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect on every transition of one deviation more of a daily series: the mean over its days, and at its mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    days = table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("v"))
    z = days.withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.stddev_pop("v").over(w))
    each = z.select("event_type", *[(b - a).alias(n) for n, a, b in zip(_NAMES, _cells(F.col("z")), _cells(F.col("z") + 1), strict=True)])
    mean = each.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), *[F.round(F.avg(n), 6).alias(f"d{n[1:]}") for n in _NAMES])
    at_mean = [F.round(b - a, 6).alias(f"m{n[1:]}") for n, a, b in zip(_NAMES, _cells(F.lit(0.0)), _cells(F.lit(1.0)), strict=True)]
    return mean.select("*", *at_mean)
