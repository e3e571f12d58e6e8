"""Queries of the actuarial, pension and scenario operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FUNDS, Career, Glidepath, Reform
from tessera.functions import folds
from tessera.functions.random import uniform
from tessera.operators import actuarial, panel, pension, scenarios
from tessera.plans import tables as t
from tessera.plans.relational import rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _array(values) -> str:
    """A list literal of doubles for DuckDB."""
    return "[" + ", ".join(_array(v) if isinstance(v, (list, tuple)) else f"{v!r}::DOUBLE" for v in values) + "]"


# Cases of annuities, and the table that both engines make by the same rule.
CASES = [("H", 65, 2026), ("M", 60, 2026), ("H", 65, 2066), ("M", 65, 2061), ("H", 90, 2026)]
_LIFE = f"""rates AS (
  SELECT s.sex, CAST(a.age AS INT) AS age, CASE WHEN a.age = 110 THEN 1 ELSE least(1.0::DOUBLE, level * exp(a.age * 0.095)) END AS q0
  FROM (SELECT unnest(range(20, 111)) AS age) a, (VALUES ('H', 2.6e-5::DOUBLE), ('M', 1.8e-5::DOUBLE)) s(sex, level)),
cases AS (SELECT * FROM (VALUES {", ".join(map(str, CASES))}) AS c(sex, age, year)),
years AS (
  SELECT c.sex, c.age, c.year, x.x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, q0
         * list_product([1 - (0.02 - i * 0.0005) FOR i IN range(1, least(16, c.year + x.x - c.age - 2020) + 1)])
         * pow(1 - (0.02 - 16 * 0.0005), greatest(0, c.year + x.x - c.age - 2020 - 16)))) AS q
  FROM cases c, LATERAL (SELECT unnest(range(c.age, 111)) AS x) x JOIN rates r ON r.sex = c.sex AND r.age = x.x)"""


@query(f"""WITH {_LIFE},
months AS (SELECT sex, age, year, (x - age) * 12 + m AS k, pow(1 - q, 1 / 12.0::DOUBLE) AS stay FROM years, (SELECT unnest(range(12)) AS m)),
alive AS (SELECT *, coalesce(product(stay) OVER (PARTITION BY sex, age, year ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive FROM months),
lived AS (SELECT *, product(1 - q) OVER (PARTITION BY sex, age, year ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM years)
SELECT sex, age, year, (SELECT round(sum(alive / pow(pow(1.0345::DOUBLE, 1 / 12.0::DOUBLE), k)), 4) FROM alive a WHERE a.sex = c.sex AND a.age = c.age AND a.year = c.year) AS factor,
       (SELECT round(sum(alive) + 0.5, 4) FROM lived l WHERE l.sex = c.sex AND l.age = c.age AND l.year = c.year) AS expectancy,
       (SELECT round(1000 / sum(alive / pow(pow(1.0345::DOUBLE, 1 / 12.0::DOUBLE), k)), 4) FROM alive a WHERE a.sex = c.sex AND a.age = c.age AND a.year = c.year) AS pension
FROM cases c""")
def annuity_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = actuarial.gompertz_table(spark)
    cases = spark.createDataFrame(CASES, "sex string, age int, year int")
    both = actuarial.annuity_factors(cases, life).join(actuarial.life_expectancy(cases, life), ["sex", "age", "year"])
    return rounded(both.withColumn("pension", 1000 / F.col("factor")), 4, "factor", "expectancy", "pension")


def _months_of(sex: str):
    career = Career()
    months = pension.ages(career, sex)
    paid = pension.salaries(career, months)
    return months, paid, pension.contributions(career, paid)


@query("""WITH m AS (SELECT sex, until, CAST(unnest(range((until - 25) * 12)) AS INT) AS t FROM (VALUES ('H', 65), ('M', 60)) s(sex, until)),
a AS (SELECT sex, t, CAST(25 + t // 12 AS INT) AS age FROM m)
SELECT sex, t, age, round(25 * pow(1.015::DOUBLE, least(age, 50) - 25), 6) AS salary, round(25 * pow(1.015::DOUBLE, least(age, 50) - 25) * 0.06, 6) AS paid FROM a""")
def salary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, k, a, w, p) for s in "HM" for k, (a, w, p) in enumerate(zip(*_months_of(s), strict=True))]
    return rounded(spark.createDataFrame(rows, "sex string, t int, age int, salary double, paid double"), 6, "salary", "paid")


_CURVE = _array(Glidepath().curve)


@query(f"""WITH ages AS (SELECT CAST(unnest(range(25, 65)) AS INT) AS age),
curve AS (SELECT age, {_CURVE}[age - 17] AS raw FROM ages),
share AS (SELECT age, CASE WHEN age <= 63 THEN 0.29 + (raw - 0.29) * (0.95::DOUBLE - 0.29) / (0.90::DOUBLE - 0.29) ELSE raw END AS g FROM curve),
pair AS (SELECT age, greatest(g, 0.082) AS g, CASE WHEN g >= 0.824 THEN 1 WHEN g >= 0.612 THEN 1 WHEN g >= 0.421 THEN 2 WHEN g >= 0.213 THEN 3 ELSE 4 END AS hi,
         CASE WHEN g >= 0.824 THEN 5 WHEN g >= 0.612 THEN 2 WHEN g >= 0.421 THEN 3 WHEN g >= 0.213 THEN 4 ELSE 5 END AS lo FROM share),
w AS (SELECT *, (g - {_array(Glidepath().fund_growth)}[lo]) / ({_array(Glidepath().fund_growth)}[hi] - {_array(Glidepath().fund_growth)}[lo]) AS w FROM pair)
SELECT age, round(g, 6) AS growth, {", ".join(f"round(CASE {k} WHEN hi THEN w WHEN lo THEN 1 - w ELSE 0 END, 6) AS {f.lower()}" for k, f in enumerate(FUNDS, 1))},
       CASE WHEN age <= 35 THEN 'B' WHEN age <= 55 THEN 'C' ELSE 'D' END AS by_law FROM w""")
def glidepath_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = Glidepath(), []
    for age in range(25, 65):
        g = pension.growth_share(path, age)
        rows.append((age, g, *pension.replicated(path, g), FUNDS[pension.by_law(age, "H").index(1.0)]))
    funds = [f.lower() for f in FUNDS]
    made = spark.createDataFrame(rows, "age int, growth double, " + ", ".join(f"{f} double" for f in funds) + ", by_law string")
    return rounded(made, 6, "growth", *funds)


@query(f"""WITH g AS (SELECT unnest({list(FUNDS)}) AS fund, unnest({_array(Glidepath().fund_growth)}) AS g)
SELECT fund, market, round(g * growth + (1 - g) * 0.0252, 8) AS target FROM g, (VALUES ('consensus', 0.044::DOUBLE), ('no premium', 0.0252::DOUBLE)) m(market, growth)""")
def market_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.config import MARKETS

    rows = [(f, name, x) for name, m in MARKETS.items() if m for f, x in zip(FUNDS, pension.target_returns(m), strict=True)]
    return rounded(spark.createDataFrame(rows, "fund string, market string, target double"), 8, "target")


_FLAT = "250275.0::DOUBLE / 39703.5 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1252602.0::DOUBLE / 39703.5 - {x}) / (1252602.0::DOUBLE / 39703.5 - 789139.0::DOUBLE / 39703.5)))"


@query(f"SELECT c_custkey, round({_FLAT.format(x='c_acctbal / 200')}, 6) AS flat, round(c_acctbal / 200 + {_FLAT.format(x='c_acctbal / 200')}, 6) AS total FROM customer")
def flat_benefit_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("c_acctbal") / 200
    flat = pension.flat_benefit(base)
    return rounded(t.table(spark, sf_dir, "customer").select("c_custkey", flat.alias("flat"), (base + flat).alias("total")), 6, "flat", "total")


# ---- paths: a history of 80 months of five funds, with labels by rule -----------------

_SEGMENTS = t.SEGMENTS
_HISTORY = (
    t.FUND_MONTHS
    + f""",
wide AS (SELECT month, {", ".join(f"round(max(r) FILTER (WHERE fund = '{s}'), 6) AS {f.lower()}" for f, s in zip(FUNDS, _SEGMENTS, strict=True))} FROM fund_months GROUP BY month),
history AS (
  SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INT) AS i, [a, b, c, d, e] AS ret,
         CASE WHEN a + b + c + d + e < -0.05 THEN 2 WHEN a + b + c + d + e > 0.05 THEN 1 ELSE 0 END AS label
  FROM wide WHERE a + b + c + d + e IS NOT NULL)"""
)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, label, ret): months of the five segments as funds A to E, labelled by their sum."""
    wide = t.fund_months(spark, sf_dir).groupBy("month").pivot("fund", list(_SEGMENTS)).agg(F.round(F.max("r"), 6)).dropna()
    wide = wide.select("month", *[F.col(s).alias(f) for f, s in zip(FUNDS, _SEGMENTS, strict=True)])
    total = sum((F.col(f) for f in FUNDS[1:]), F.col("A"))
    return scenarios.fund_arrays(wide, "month", F.when(total < -0.05, 2).when(total > 0.05, 1).otherwise(0))


MOVES = [[0.90, 0.07, 0.03], [0.10, 0.85, 0.05], [0.15, 0.15, 0.70]]
PATHS, MONTHS = 40, 120


def _u(stream: str, *labels: str) -> str:
    name = " || '-' || ".join([f"'{stream}'", *[f"CAST({x} AS VARCHAR)" for x in labels]])
    return f"(CAST('0x' || substr(md5({name}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _cum(state: str, k: int) -> str:
    sums = [sum(row[: k + 1]) for row in MOVES]
    return f"CASE {state} WHEN 0 THEN {sums[0]!r}::DOUBLE WHEN 1 THEN {sums[1]!r}::DOUBLE ELSE {sums[2]!r}::DOUBLE END"


def _walk(paths: int, months: int) -> str:
    """SQL of the regime bootstrap: walked(p, t, s, i) over the history. The recursion needs no order of rows."""
    u = _u("path-move", "p", "t")
    after = f"least(2, CAST({u} > {_cum('s', 0)} AS INT) + CAST({u} > {_cum('s', 1)} AS INT) + CAST({u} > {_cum('s', 2)} AS INT))"
    return f"""
have AS (SELECT label, list(i ORDER BY i) AS pool FROM history GROUP BY label),
pools AS (SELECT l.label, coalesce(h.pool, (SELECT pool FROM have ORDER BY abs(label - l.label), label LIMIT 1)) AS pool FROM (VALUES (0), (1), (2)) l(label) LEFT JOIN have h ON h.label = l.label),
moved AS (
  SELECT CAST(p AS BIGINT) AS p, 0 AS t, 0 AS s FROM (SELECT unnest(range({paths})) AS p)
  UNION ALL SELECT p, t + 1, {after} FROM moved WHERE t < {months - 1}),
walked AS (
  SELECT p, t, s, pool[CAST(floor({_u("path-row", "p", "t")} * len(pool)) AS INT) + 1] AS i FROM moved JOIN pools ON label = s),
drawn AS (SELECT p, t, s, w.i, ret FROM walked w JOIN history h ON h.i = w.i)"""


def paths(spark: SparkSession, sf_dir: str, n: int = PATHS, months: int = MONTHS) -> DataFrame:
    return scenarios.regime_paths(spark, scenarios.pooled_history(history(spark, sf_dir), len(MOVES)), n, months, MOVES, 0)


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(PATHS, MONTHS)}
SELECT p AS path_id, count(*) FILTER (WHERE s = 0) AS calm, count(*) FILTER (WHERE s = 1) AS swing, count(*) FILTER (WHERE s = 2) AS stress,
       CAST(arg_max(s, t) AS INT) AS last_state, CAST(sum(i * (t + 1)) AS BIGINT) AS trace, round(exp(sum(ln(1 + ret[1]))), 6) AS growth_a FROM drawn GROUP BY p""")
def regime_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = paths(spark, sf_dir)
    seen = lambda k: F.size(F.filter("states", lambda s: s == k)).cast("bigint")
    trace = F.aggregate(F.zip_with("picks", F.sequence(F.lit(1), F.size("picks")), lambda i, k: i * k), F.lit(0).cast("bigint"), lambda s, x: s + x)
    growth = F.aggregate("picks", F.lit(0.0), lambda s, i: s + F.ln(1 + F.get(F.get(F.col("rows"), i), 0)))
    return made.select("path_id", seen(0).alias("calm"), seen(1).alias("swing"), seen(2).alias("stress"), F.element_at("states", -1).alias("last_state"), trace.alias("trace"), F.round(F.exp(growth), 6).alias("growth_a"))


_TARGETS = pension.target_returns({"growth": 0.044, "protected": 0.0252})


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(PATHS, MONTHS)},
f AS (SELECT {", ".join(f"exp(ln({1 + g!r}::DOUBLE) / 12 - avg(ln(1 + ret[{k}]))) AS f{k}" for k, g in enumerate(_TARGETS, 1))} FROM drawn)
SELECT p AS path_id, {", ".join(f"round(exp(sum(ln((1 + ret[{k}]) * f{k}))), 6) AS growth_{f.lower()}" for k, f in enumerate(FUNDS, 1))} FROM drawn, f GROUP BY p""")
def recentred_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.recentred(paths(spark, sf_dir), _TARGETS)
    growth = lambda k: F.exp(F.aggregate("path", F.lit(0.0), lambda s, r: s + F.ln(1 + F.get(r, k))))
    return made.select("path_id", *[F.round(growth(k), 6).alias(f"growth_{f.lower()}") for k, f in enumerate(FUNDS)])


# A short career of MONTHS months, paid evenly, of the default mix by law from age 30 on.
_AGES = [30 + k // 12 for k in range(MONTHS)]
_LAW = [pension.by_law(a, "H") for a in _AGES]


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(PATHS, MONTHS)},
port AS (SELECT p, t, CASE WHEN 30 + t // 12 <= 35 THEN ret[2] ELSE ret[3] END AS r FROM drawn),
grown AS (SELECT p, t, exp(sum(ln(1 + r)) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port)
SELECT p AS path_id, round(sum(1.5 * g), 6) AS balance, round(max(g) FILTER (WHERE t = 0), 6) AS whole_growth FROM grown GROUP BY p""")
def accumulate_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.returns_of(paths(spark, sf_dir))
    whole = F.aggregate(pension.portfolio(F.col("path"), _LAW), F.lit(1.0), lambda s, r: s * (1 + r))
    return made.select("path_id", F.round(pension.balance(F.col("path"), _LAW, [1.5] * MONTHS), 6).alias("balance"), F.round(whole, 6).alias("whole_growth"))


@query(f"""WITH RECURSIVE {t.FUND_MONTHS}
SELECT fund, month, round(exp(sum(ln(1 + r)) OVER (PARTITION BY fund ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS growth FROM fund_months""")
def reverse_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.fund_months(spark, sf_dir)
    return rows.select("fund", "month", F.round(panel.reverse_growth("r", ["fund"], "month"), 6).alias("growth"))


def _switching(ret: str = "ret", age: str = "30 + d.t // 12", paid: str = "1.5") -> str:
    """SQL of the reactive member over drawn(p, t, ret): the state after each month."""
    law = f"CASE WHEN {age} <= 35 THEN d.{ret}[2] WHEN {age} <= 55 THEN d.{ret}[3] ELSE d.{ret}[4] END"
    return f"""
member AS (
  SELECT p, -1 AS t, 0.0::DOUBLE AS balance, 0 AS switches, false AS in_e, 0 AS stayed, 0 AS pending, 0 AS wait,
         0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2 FROM (SELECT DISTINCT p FROM drawn)
  UNION ALL
  SELECT p, t, (balance + paid) * (1 + r), switches + CAST(due AS INT), in_e, stayed2,
         CASE WHEN go THEN 1 WHEN back THEN 2 ELSE pending END, CASE WHEN go OR back THEN 1 ELSE wait END, r, p1, ra, a1
  FROM (SELECT *, pending = 0 AND t >= 2 AND NOT in_e AND (1 + p2) * (1 + p1) * (1 + r) - 1 < -0.06 AS go,
               pending = 0 AND t >= 2 AND in_e AND stayed2 >= 6 AND (1 + a2) * (1 + a1) * (1 + ra) - 1 > 0.05 AS back
        FROM (SELECT *, CASE WHEN in_e THEN re ELSE rb END AS r, stayed + CAST(in_e AS INT) AS stayed2
              FROM (SELECT m.p, d.t, balance, switches, pending <> 0 AND wait = 0 AS due,
                           CASE WHEN pending <> 0 AND wait = 0 THEN pending = 1 ELSE in_e END AS in_e,
                           CASE WHEN pending = 1 AND wait = 0 THEN 0 ELSE stayed END AS stayed,
                           CASE WHEN pending <> 0 AND wait = 0 THEN 0 ELSE pending END AS pending, greatest(wait - 1, 0) AS wait,
                           p1, p2, a1, a2, {paid} AS paid, {law} AS rb, d.{ret}[5] AS re, d.{ret}[1] AS ra
                    FROM member m JOIN drawn d ON d.p = m.p AND d.t = m.t + 1))))"""


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(PATHS, MONTHS)}, {_switching()}
SELECT p AS path_id, round(balance, 6) AS balance, switches FROM member WHERE t = {MONTHS - 1}""")
def reactive_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scenarios.returns_of(paths(spark, sf_dir)).withColumn("_s", pension.reactive_state(F.col("path"), _LAW, [1.5] * MONTHS))
    return made.select("path_id", F.round("_s.balance", 6).alias("balance"), F.col("_s.switches").alias("switches"))


_CAREER = Career(start_age=50, growth_until=50)
_FACTOR = 150.0


def _port_sql(source: str, age: str, keep: str) -> str:
    """Monthly returns of the fixed funds, the default and the lifecycle, of rows that have ret and t."""
    law = f"CASE WHEN {age} <= 35 THEN ret[2] WHEN {age} <= 55 THEN ret[3] ELSE ret[4] END"
    life = _array(pension.strategies(list(range(111)), "H")[pension.LIFECYCLE])
    glide = " + ".join(f"life[{age} + 1][{k}] * ret[{k}]" for k in range(1, 6))
    mixes = {**{f"fund {f}": f"ret[{k}]" for k, f in enumerate(FUNDS, 1)}, pension.DEFAULT: law, pension.LIFECYCLE: glide}
    return f"glide AS (SELECT {life} AS life), port AS (" + " UNION ALL ".join(f"SELECT {keep}, '{n}' AS strategy, {e} AS r FROM {source}, glide" for n, e in mixes.items()) + ")"


def _strategy_sql(paths_: int, months: int) -> str:
    """Pensions of all strategies over a career of ``months`` that starts at 50."""
    return f"""{_port_sql("drawn", "(50 + t // 12)", "p, t")}, {_switching(age="(50 + d.t // 12)")},
grown AS (SELECT p, t, strategy, exp(sum(ln(1 + r)) OVER (PARTITION BY p, strategy ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port),
pays AS (SELECT p, strategy, sum(1.5 * g) / {_FACTOR} AS pension FROM grown GROUP BY p, strategy
         UNION ALL SELECT p, '{pension.REACTIVE}', balance / {_FACTOR} FROM member WHERE t = {months - 1})"""


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(100, 180)}, {_strategy_sql(100, 180)},
s AS (SELECT strategy, quantile_cont(pension, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, avg(pension) AS mean, avg(CAST(pension >= 10 AS DOUBLE)) AS reach FROM pays GROUP BY strategy)
SELECT strategy, round(q[1], 5) AS p5, round(q[2], 5) AS p25, round(q[3], 5) AS median, round(q[4], 5) AS p75, round(q[5], 5) AS p95, round(mean, 5) AS mean, reach,
       round(q[3] / 25, 6) AS replacement, (SELECT round(avg(pension), 5) FROM pays p WHERE p.strategy = s.strategy AND pension <= q[1]) AS cvar5 FROM s""")
def mc_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pension.pensions(scenarios.returns_of(paths(spark, sf_dir, 100, 180)), "H", _FACTOR, _CAREER)
    table = pension.strategy_table(made, 25.0, 0.4)
    return rounded(table.drop("n"), 5, "p5", "p25", "median", "p75", "p95", "mean", "cvar5").withColumn("replacement", F.round("replacement", 6))


@query(f"""WITH RECURSIVE {_HISTORY},
n AS (SELECT count(*) AS n FROM history),
aged AS (SELECT 0 AS p, i AS t, ret, CAST(65 - n // 12 + i // 12 AS INT) AS age FROM history, n),
drawn AS (SELECT *, 25 * pow(1.015::DOUBLE, least(age, 50) - 25) * 0.06 AS paid FROM aged),
{_port_sql("drawn", "age", "t, paid")}, {_switching(age="d.age", paid="d.paid")},
grown AS (SELECT strategy, t, paid, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port),
ended AS (SELECT strategy, sum(g * paid) AS balance, 0 AS switches FROM grown GROUP BY strategy
          UNION ALL SELECT '{pension.REACTIVE}', balance, switches FROM member, n WHERE t = n - 1)
SELECT strategy, round(balance, 5) AS balance, round(balance / {_FACTOR}, 6) AS pension, switches FROM ended""")
def historical_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one path that history took, under every strategy, for a member who retires at its end."""
    return _backtest(history(spark, sf_dir))


def _backtest(rows: DataFrame) -> DataFrame:
    n = rows.count()
    start = 65 - n // 12
    career = Career(start_age=start, growth_origin=25)
    months = [start + k // 12 for k in range(n)]
    paid = pension.contributions(career, pension.salaries(career, months))
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "ret"))), lambda x: x["ret"]).alias("path"))
    mixes = pension.strategies(months, "H")
    pay = [F.struct(F.lit(name).alias("strategy"), pension.balance(F.col("path"), w, paid).alias("balance"), F.lit(0).alias("switches")) for name, w in mixes.items()]
    moved = folds.let(pension.reactive_state(F.col("path"), mixes[pension.DEFAULT], paid), lambda s: F.struct(F.lit(pension.REACTIVE).alias("strategy"), s["balance"].alias("balance"), s["switches"].alias("switches")))
    made = one.select(F.inline(F.array(*pay, moved)))
    return made.select("strategy", F.round("balance", 5).alias("balance"), F.round(F.col("balance") / _FACTOR, 6).alias("pension"), "switches")


_OWN, _EMPLOYER, _BOND, _LAST = pension.layer_contributions(_CAREER, "H")


@query(f"""WITH RECURSIVE {_HISTORY}, {_walk(100, 180)},
paid AS (SELECT unnest(range(180)) AS t, unnest({_array(_OWN)}) AS own, unnest({_array(_EMPLOYER)}) AS employer),
port AS (SELECT p, t, CASE WHEN 50 + t // 12 <= 55 THEN ret[3] ELSE ret[4] END AS r FROM drawn),
grown AS (SELECT p, t, exp(sum(ln(1 + r)) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port),
layer AS (SELECT p, sum(own * g) / {_FACTOR} AS own, sum(employer * g) / {_FACTOR} AS employer, {_BOND / _FACTOR!r}::DOUBLE AS bond FROM grown JOIN paid ON paid.t = grown.t GROUP BY p),
full_ AS (SELECT *, {_FLAT.format(x="(own + employer + bond)")} AS flat FROM layer)
SELECT p AS path_id, round(own, 5) AS own, round(employer, 5) AS employer, round(bond, 5) AS bond, round(flat, 5) AS flat, round(own + employer + bond + flat, 5) AS total FROM full_""")
def layered_pension(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pension.layered(scenarios.returns_of(paths(spark, sf_dir, 100, 180)), "H", _FACTOR, _CAREER, names=(pension.DEFAULT,))
    return rounded(made.select("path_id", "own", "employer", "bond", "flat", "total"), 5, "own", "employer", "bond", "flat", "total")


@query(f"""WITH steps AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}::DOUBLE)" for a, b in Reform().employer)}) s(start, rate)),
m AS (SELECT CAST(unnest(range({2025 * 12}, {2056 * 12}, 6)) AS INT) AS month_no)
SELECT month_no, coalesce(rate, 0) AS rate FROM m ASOF LEFT JOIN steps ON month_no >= start""")
def contribution_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.asof import step_rate

    months = spark.range(2025 * 12, 2056 * 12, 6).select(F.col("id").cast("int").alias("month_no"))
    return months.withColumn("rate", step_rate(F.col("month_no"), list(Reform().employer)))


@query(f"""WITH RECURSIVE walk AS (
  SELECT CAST(p AS BIGINT) AS path_id, 0 AS t, CAST(floor({_u("block-start", "p", "0")} * 80) AS INT) AS i FROM (SELECT unnest(range(50)) AS p)
  UNION ALL SELECT path_id, t + 1, CASE WHEN {_u("block-new", "path_id", "t + 1")} < 1 / 12.0::DOUBLE THEN CAST(floor({_u("block-start", "path_id", "t + 1")} * 80) AS INT) ELSE (i + 1) % 80 END
  FROM walk WHERE t < 79) SELECT * FROM walk""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.block_indices(spark, 50, 80, 12.0)


_DENSITY = "(0.2 + (c_custkey % 7) / 10.0::DOUBLE)"


@query(f"""WITH RECURSIVE walk AS (
  SELECT c_custkey, {_DENSITY} AS d, 0 AS t, CAST({_u("spell-first", "c_custkey")} < {_DENSITY} AS INT) AS s FROM customer
  UNION ALL SELECT c_custkey, d, t + 1, CASE WHEN s = 1 THEN CAST({_u("spell", "c_custkey", "t")} >= 1 / 36.0::DOUBLE AS INT) ELSE CAST({_u("spell", "c_custkey", "t")} < least(1.0::DOUBLE, d / (1 - d) * (1 / 36.0::DOUBLE)) AS INT) END
  FROM walk WHERE t < 59)
SELECT c_custkey, CAST(sum(s) AS BIGINT) AS months, CAST(sum(s * t) AS BIGINT) AS trace FROM walk GROUP BY c_custkey""")
def markov_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = F.lit(0.2) + (F.col("c_custkey") % 7) / F.lit(10.0)
    rows = t.table(spark, sf_dir, "customer").select("c_custkey", scenarios.formal_months(density, F.col("c_custkey"), 60, 36.0).alias("m"))
    total = lambda f: F.aggregate(F.transform("m", f), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("c_custkey", total(lambda x, i: x).alias("months"), total(lambda x, i: x * i).alias("trace"))


# ---- fixed-parameter filters ----------------------------------------------------------

_START, _STAY = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]]
_SPREAD = (0.02, 0.06)


_FORWARD = f"""{t.FUND_MONTHS},
s AS (SELECT fund, CAST(row_number() OVER (PARTITION BY fund ORDER BY month) AS INT) AS t, {", ".join(f"exp(-0.5 * (r / {v!r}::DOUBLE) * (r / {v!r}::DOUBLE)) / ({v!r}::DOUBLE * sqrt(2 * pi())) AS b{k}" for k, v in enumerate(_SPREAD))} FROM fund_months),
f AS (
  SELECT fund, t, ln(x0 + x1) AS ll, x0 / (x0 + x1) AS p0, x1 / (x0 + x1) AS p1 FROM (SELECT fund, t, {_START[0]} * b0 AS x0, {_START[1]} * b1 AS x1 FROM s WHERE t = 1)
  UNION ALL
  SELECT fund, t, ll + ln(x0 + x1), x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.fund, s.t, f.ll, (p0 * 0.9::DOUBLE + p1 * 0.2::DOUBLE) * b0 AS x0, (p0 * 0.1::DOUBLE + p1 * 0.8::DOUBLE) * b1 AS x1 FROM f JOIN s ON s.fund = f.fund AND s.t = f.t + 1))"""


@query(f"""WITH RECURSIVE {_FORWARD}
SELECT fund, round(arg_max(ll, t), 5) AS loglik, round(arg_max(p0, t), 6) AS calm, CAST(max(t) AS INT) AS months FROM f GROUP BY fund""")
def hmm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _dense(spark, sf_dir).select("fund", folds.filtered_regimes(F.col("dense"), _START, _STAY).alias("f"))
    return made.select("fund", F.round("f.loglik", 5).alias("loglik"), F.round(F.get("f.probs", 0), 6).alias("calm"), F.col("f.t").alias("months"))


def _dense(spark, sf_dir):
    r = lambda x, v: F.exp(-0.5 * (x / v) * (x / v)) / (v * F.sqrt(2 * F.pi()))
    one = t.fund_months(spark, sf_dir).groupBy("fund").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "r"))), lambda x: x["r"]).alias("r"))
    return one.select("fund", F.transform("r", lambda x: F.array(*[r(x, v) for v in _SPREAD])).alias("dense"))


@query(f"""WITH RECURSIVE {_FORWARD},
e AS (SELECT fund, max(t) AS t FROM s GROUP BY fund),
g AS (
  SELECT fund, t, 1.0::DOUBLE AS q0, 1.0::DOUBLE AS q1 FROM e
  UNION ALL
  SELECT fund, t, x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.fund, g.t - 1 AS t, 0.9::DOUBLE * b0 * q0 + 0.1::DOUBLE * b1 * q1 AS x0, 0.2::DOUBLE * b0 * q0 + 0.8::DOUBLE * b1 * q1 AS x1 FROM g JOIN s ON s.fund = g.fund AND s.t = g.t WHERE g.t > 1))
SELECT fund, t, round(p0 * q0 / (p0 * q0 + p1 * q1), 6) AS calm FROM f JOIN g USING (fund, t)""")
def hmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of the calm state in each month given all months of the fund, before and after."""
    made = _dense(spark, sf_dir).select("fund", F.posexplode(folds.smoothed_regimes(F.col("dense"), _START, _STAY)).alias("k", "p"))
    return made.select("fund", (F.col("k") + 1).alias("t"), F.round(F.get("p", 0), 6).alias("calm"))


@query(f"""WITH RECURSIVE {t.FUND_MONTHS},
c AS (SELECT fund, CAST(row_number() OVER (PARTITION BY fund ORDER BY month) AS INT) AS t, r - avg(r) OVER (PARTITION BY fund) AS r, var_pop(r) OVER (PARTITION BY fund) AS v FROM fund_months),
g AS (
  SELECT fund, t, r, v AS s2 FROM c WHERE t = 1
  UNION ALL SELECT c.fund, c.t, c.r, 0.00005::DOUBLE + 0.08::DOUBLE * g.r * g.r + 0.9::DOUBLE * g.s2 FROM g JOIN c ON c.fund = g.fund AND c.t = g.t + 1)
SELECT fund, t, round(s2, 9) AS variance FROM g""")
def garch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = t.fund_months(spark, sf_dir).groupBy("fund").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "r"))), lambda x: x["r"]).alias("r"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    centred = F.transform("r", lambda x: x - F.col("m"))
    made = one.select("fund", F.posexplode(folds.conditional_variance(centred, 0.00005, 0.08, 0.9, F.col("v"))).alias("k", "variance"))
    return made.select("fund", (F.col("k") + 1).alias("t"), F.round("variance", 9).alias("variance"))


_B, _W = [[0.0, -2.0, -3.0], [-2.5, 0.0, -2.0], [-3.0, -1.5, 0.0]], [[0.0, 0.8, -0.4], [0.3, 0.0, 0.5], [-0.6, 0.2, 0.0]]


def _softmax_sql(z: str) -> str:
    cells = []
    for i in range(3):
        logit = [f"({_B[i][j]}::DOUBLE + {_W[i][j]}::DOUBLE * ({z}))" for j in range(3)]
        top = f"greatest({', '.join(logit)})"
        total = " + ".join(f"exp({x} - {top})" for x in logit)
        cells += [f"exp({x} - {top}) / ({total})" for x in logit]
    return cells


_NAMES = [f"p{i}{j}" for i in range(3) for j in range(3)]


@query(f"""WITH {t.FUND_MONTHS}, z AS (SELECT fund, month, (r - avg(r) OVER (PARTITION BY fund)) / stddev_pop(r) OVER (PARTITION BY fund) AS z FROM fund_months)
SELECT fund, month, {", ".join(f"round({e}, 6) AS {n}" for n, e in zip(_NAMES, _softmax_sql("z"), strict=True))}, {", ".join(f"round({b} - ({a}), 6) AS d{n[1:]}" for n, a, b in zip(_NAMES, _softmax_sql("z"), _softmax_sql("z + 1"), strict=True))} FROM z""")
def softmax_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition probabilities that follow a standardised variable, and the effect of one deviation more."""
    from pyspark.sql import Window

    w = Window.partitionBy("fund")
    z = t.fund_months(spark, sf_dir).withColumn("z", (F.col("r") - F.avg("r").over(w)) / F.stddev_pop("r").over(w))

    def cells(x):
        return [p for i in range(3) for p in folds.softmax([F.lit(_B[i][j]) + F.lit(_W[i][j]) * x for j in range(3)])]

    now, more = cells(F.col("z")), cells(F.col("z") + 1)
    return z.select("fund", "month", *[F.round(e, 6).alias(n) for n, e in zip(_NAMES, now, strict=True)], *[F.round(b - a, 6).alias(f"d{n[1:]}") for n, a, b in zip(_NAMES, now, more, strict=True)])


@query(f"""SELECT count(*) AS n, round(avg(u), 9) AS mean, round(min(u), 9) AS low, round(max(u), 9) AS high FROM (SELECT {_u("check", "p", "t")} AS u FROM (SELECT unnest(range(200)) AS p), (SELECT unnest(range(50)) AS t))""")
def counter_uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.range(200).select(F.col("id").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("t")).select(uniform("check", F.col("p"), F.col("t")).alias("u"))
    return u.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 9).alias("mean"), F.round(F.min("u"), 9).alias("low"), F.round(F.max("u"), 9).alias("high"))


_LAYERED = f"""{_HISTORY}, {_walk(100, 180)},
paid AS (SELECT unnest(range(180)) AS t, unnest({_array(_OWN)}) AS own, unnest({_array(_EMPLOYER)}) AS employer),
port AS (SELECT p, t, CASE WHEN 50 + t // 12 <= 55 THEN ret[3] ELSE ret[4] END AS r FROM drawn),
grown AS (SELECT p, t, exp(sum(ln(1 + r)) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS g FROM port),
layer AS (SELECT p, sum(own * g) / {_FACTOR} AS own, sum(employer * g) / {_FACTOR} AS employer, {_BOND / _FACTOR!r}::DOUBLE AS bond FROM grown JOIN paid ON paid.t = grown.t GROUP BY p),
full_ AS (SELECT *, {_FLAT.format(x="(own + employer + bond)")} AS flat, own + employer + bond + {_FLAT.format(x="(own + employer + bond)")} AS total FROM layer)"""


def _layered(spark, sf_dir):
    return pension.layered(scenarios.returns_of(paths(spark, sf_dir, 100, 180)), "H", _FACTOR, _CAREER, names=(pension.DEFAULT,))


@query(f"""WITH RECURSIVE {_LAYERED},
long AS (SELECT unnest(['1 own', '2 with employer', '3 with bond', '4 total']) AS layer, unnest([own, own + employer, own + employer + bond, total]) AS v FROM full_)
SELECT layer, round(quantile_cont(v, 0.05), 5) AS p5, round(median(v), 5) AS median, round(quantile_cont(v, 0.95), 5) AS p95, round(median(v / {_LAST!r}::DOUBLE), 6) AS replacement, avg(CAST(v / {_LAST!r}::DOUBLE >= 0.3 AS DOUBLE)) AS reach
FROM long GROUP BY layer""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pension.layer_table(_layered(spark, sf_dir), 0.3).drop("strategy")
    return rounded(table, 5, "p5", "median", "p95").withColumn("replacement", F.round("replacement", 6))


@query(f"""WITH RECURSIVE {_LAYERED}, m AS (SELECT median(total) AS median FROM full_)
SELECT 25.0::DOUBLE AS salary, round(median, 5) AS median, p AS path_id, round(total, 5) AS total, round(own, 5) AS own, round(employer, 5) AS employer, round(bond, 5) AS bond, round(flat, 5) AS flat
FROM full_, m ORDER BY round(abs(total - median), 9), p LIMIT 1""")
def income_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of the path next to the median, so that they add up; of two equally near the one with the lower number."""
    rows = _layered(spark, sf_dir).withColumn("salary", F.lit(25.0))
    made = pension.income_table(rows, ["salary"]).drop("last_salary")
    return rounded(made, 5, "median", "total", "own", "employer", "bond", "flat")


@query(f"""WITH {_LIFE.split("cases AS")[0].rstrip().rstrip(",")}
SELECT sex, age, CAST(year AS INT) AS year, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, q0 * coalesce(list_product([1 - (0.02 - i * 0.0005) FOR i IN range(1, least(16, year - 2020) + 1)]), 1) * pow(1 - (0.02 - 16 * 0.0005), greatest(0, year - 2020 - 16)))), 9) AS q
FROM rates, (SELECT unnest(range(2020, 2061, 10)) AS year)""")
def mortality_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(actuarial.rate_matrix(actuarial.gompertz_table(spark), 2020, 2060).where("year % 10 = 0"), 9, "q")
