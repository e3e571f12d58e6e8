"""Queries over long series: one or a few series of all rows of a table, each with its DuckDB SQL.

The series are cut into ranges of SEGMENT rows, far fewer than production would take, so that the
ranges and what is carried over them are at work on the smallest tables too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import asof, regime_scan, segments, stats, volatility_scan
from tessera.operators.panel import row_return
from tessera.plans import tables as t
from tessera.plans.relational import rounded
from tessera.plans.tables import table

QUERIES, SQL = {}, {}
#: Rows of a range.
SEGMENT = 500


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query("""WITH click AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ts)
SELECT e.event_id, c.ts AS click_ts, round(c.value, 6) AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN click c ON e.ts >= c.ts""")
def asof_latest_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest click of anyone: one key that holds all rows."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select(F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "ts")
    joined = asof.asof_backward(bought, clicks, [], "ts", "click_ts", "click_value", SEGMENT)
    return rounded(joined.select("event_id", "click_ts", "click_value"), 6, "click_value")


@query("""WITH one AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN user_id ELSE -1 END AS buyer FROM events),
click AS (SELECT buyer, ts, max(value) AS value FROM one WHERE event_type = 'click' GROUP BY buyer, ts)
SELECT e.event_id, e.buyer, c.ts AS click_ts, round(c.value, 6) AS click_value
FROM (SELECT * FROM one WHERE event_type = 'purchase') e ASOF LEFT JOIN click c ON e.buyer = c.buyer AND e.ts >= c.ts""")
def asof_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join where one key, the buyers that aren't known, has nine tenths of the rows."""
    events = table(spark, sf_dir, "events").withColumn("buyer", F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(F.lit(-1).cast("bigint")))
    clicks = events.where("event_type = 'click'").select("buyer", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "buyer", "ts")
    joined = asof.asof_backward(bought, clicks, ["buyer"], "ts", "click_ts", "click_value", SEGMENT)
    return rounded(joined.select("event_id", "buyer", "click_ts", "click_value"), 6, "click_value")


_SHIPPED = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_ORDER = ", ".join(_SHIPPED)
_LOG = "ln(1 + (l_discount - 0.05) / 1000)"


@query(f"""SELECT {_ORDER}, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, max(l_extendedprice) OVER w AS high,
       round(100 * l_extendedprice / max(l_extendedprice) OVER w - 100, 4) + 0.0 AS below
FROM lineitem WINDOW w AS (ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)""")
def running_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running turnover, the highest price so far and the fall from it, over all lines as one series."""
    lines = table(spark, sf_dir, "lineitem").select(*_SHIPPED)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    made = segments.running(lines, [], _SHIPPED, {"cents": (cents, "sum"), "high": (F.col("l_extendedprice"), "max")}, rows_per_segment=SEGMENT * 10)
    return made.withColumn("below", F.round(100 * F.col("l_extendedprice") / F.col("high") - 100, 4) + 0.0)


@query(f"""WITH rows AS (SELECT {_ORDER}, l_returnflag, l_discount, {_LOG} AS g FROM lineitem),
grown AS (SELECT *, exp(sum(g) OVER (PARTITION BY l_returnflag ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)) AS level,
                 exp(sum(g) OVER (PARTITION BY l_returnflag ORDER BY {_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ahead FROM rows),
peaks AS (SELECT *, max(level) OVER (PARTITION BY l_returnflag ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS peak FROM grown)
SELECT l_returnflag, {_ORDER}, round(100 * level, 3) AS level, round(100 * ahead, 3) AS ahead, round(100 * (level / peak - 1), 3) + 0.0 AS drawdown FROM peaks""")
def running_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, growth to the end and drawdown of three series of all lines: running and reverse products, and a running maximum."""
    lines = table(spark, sf_dir, "lineitem").select(*_SHIPPED, "l_returnflag", F.ln(1 + (F.col("l_discount") - 0.05) / 1000).alias("g"))
    size = SEGMENT * 10
    level = segments.running(lines, ["l_returnflag"], _SHIPPED, {"_sum": (F.col("g"), "sum")}, rows_per_segment=size).withColumn("level", F.exp("_sum"))
    peak = segments.running(level, ["l_returnflag"], _SHIPPED, {"peak": (F.col("level"), "max")}, rows_per_segment=size)
    both = segments.running(peak, ["l_returnflag"], _SHIPPED, {"_ahead": (F.col("g"), "sum")}, reverse=True, rows_per_segment=size)
    return both.select("l_returnflag", *_SHIPPED, F.round(100 * F.col("level"), 3).alias("level"), F.round(100 * F.exp("_ahead"), 3).alias("ahead"), (F.round(100 * (F.col("level") / F.col("peak") - 1), 3) + 0.0).alias("drawdown"))


@query("""WITH r AS (SELECT event_id, ts, value, event_type, corr(value, event_id % 97) OVER w AS c, sum(ln(1 + value / 1000)) OVER w AS s, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
SELECT event_id, event_type, round(CASE WHEN n = 36 THEN c END, 5) AS c, round(CASE WHEN n = 36 THEN exp(s / 3) - 1 END, 6) AS yearly FROM r""")
def rolling_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and annualised growth over 36 rows of long series, one for each type of event."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    full = lambda w: F.count(F.lit(1)).over(w) == 36
    measures = {
        "c": lambda w: F.when(full(w), stats.rolling_correlation(F.col("value"), F.col("event_id") % 97, w)),
        "yearly": lambda w: F.when(full(w), F.exp(F.sum(F.ln(1 + F.col("value") / 1000)).over(w) * (12 / 36)) - 1),
    }
    made = segments.rolling(events, ["event_type"], ["ts", "event_id"], 36, measures, SEGMENT)
    return made.select("event_id", "event_type", F.round("c", 5).alias("c"), F.round("yearly", 6).alias("yearly"))


_START, _MOVES = [0.6, 0.4], [[0.9, 0.1], [0.2, 0.8]]
_CENTRES, _SPREADS = [30.0, 90.0], [25.0, 45.0]
_DENSE = [f"exp(-0.5 * ((value - {m}) / {v}) * ((value - {m}) / {v})) / ({v} * sqrt(2 * pi()))" for m, v in zip(_CENTRES, _SPREADS, strict=True)]


@query(f"""WITH RECURSIVE s AS (
  SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INT) AS t, {_DENSE[0]} AS b0, {_DENSE[1]} AS b1 FROM events),
f AS (
  SELECT event_type, t, ln(x0 + x1) AS ll, x0 / (x0 + x1) AS p0, x1 / (x0 + x1) AS p1 FROM (SELECT event_type, t, 0.6 * b0 AS x0, 0.4 * b1 AS x1 FROM s WHERE t = 1)
  UNION ALL
  SELECT event_type, t, ll + ln(x0 + x1), x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.event_type, s.t, f.ll, (p0 * 0.9 + p1 * 0.2) * b0 AS x0, (p0 * 0.1 + p1 * 0.8) * b1 AS x1 FROM f JOIN s ON s.event_type = f.event_type AND s.t = f.t + 1)),
g AS (
  SELECT event_type, max(t) AS t, 1.0::DOUBLE AS q0, 1.0::DOUBLE AS q1 FROM s GROUP BY event_type
  UNION ALL
  SELECT event_type, t, x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.event_type, g.t - 1 AS t, 0.9 * b0 * q0 + 0.1 * b1 * q1 AS x0, 0.2 * b0 * q0 + 0.8 * b1 * q1 AS x1 FROM g JOIN s ON s.event_type = g.event_type AND s.t = g.t WHERE g.t > 1))
SELECT s.event_id, s.event_type, round(p0, 6) AS past, round(p0 * q0 / (p0 * q0 + p1 * q1), 6) AS calm, round(ll, 3) AS loglik
FROM f JOIN g USING (event_type, t) JOIN s USING (event_type, t)""")
def regime_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of the calm state at every event, given the past and given all, and the log-likelihood up to it; series of all events of a type."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    gap = lambda m, v: (F.col("value") - m) / v
    dense = F.array(*[F.exp(-0.5 * gap(m, v) * gap(m, v)) / (v * F.sqrt(2 * F.pi())) for m, v in zip(_CENTRES, _SPREADS, strict=True)])
    made = regime_scan.smoothed(events, ["event_type"], ["ts", "event_id"], dense, _START, _MOVES, SEGMENT)
    return made.select("event_id", "event_type", F.round(F.get("filtered", 0), 6).alias("past"), F.round(F.get("posterior", 0), 6).alias("calm"), F.round("loglik", 3).alias("loglik"))


#: Starts of the fits: a number, means and variances in units of a fund's own spread, and how likely a regime stays.
_STARTS = [(1, [0.5, -0.5], [0.5, 1.5], 0.9), (2, [0.0, 0.0], [0.3, 2.0], 0.8)]
_EM_STEPS = 3


def _em_sql(k: int) -> str:
    """One step from the parameters p{k - 1}: passes of every fit and fund, then the sums."""
    p, n = f"p{k - 1}", k
    dense = [f"exp(-0.5 * (r - m{j}) * (r - m{j}) / v{j}) / sqrt(2 * pi() * v{j})" for j in (0, 1)]
    return f"""
s{n} AS (SELECT fit, fund, t, r, {p}.* EXCLUDE (fit, fund), {dense[0]} AS b0, {dense[1]} AS b1 FROM one JOIN {p} USING (fund)),
f{n} AS (
  SELECT fit, fund, t, ln(x0 + x1) AS ll, x0 / (x0 + x1) AS c0, x1 / (x0 + x1) AS c1 FROM (SELECT fit, fund, t, s0 * b0 AS x0, s1 * b1 AS x1 FROM s{n} WHERE t = 1)
  UNION ALL
  SELECT fit, fund, t, ll + ln(x0 + x1), x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.fit, s.fund, s.t, f.ll, (c0 * a00 + c1 * a10) * b0 AS x0, (c0 * a01 + c1 * a11) * b1 AS x1 FROM f{n} f JOIN s{n} s ON s.fit = f.fit AND s.fund = f.fund AND s.t = f.t + 1)),
g{n} AS (
  SELECT fit, fund, max(t) AS t, 1.0::DOUBLE AS q0, 1.0::DOUBLE AS q1 FROM s{n} GROUP BY fit, fund
  UNION ALL
  SELECT fit, fund, t, x0 / (x0 + x1), x1 / (x0 + x1) FROM (
    SELECT s.fit, s.fund, g.t - 1 AS t, a00 * b0 * q0 + a01 * b1 * q1 AS x0, a10 * b0 * q0 + a11 * b1 * q1 AS x1 FROM g{n} g JOIN s{n} s ON s.fit = g.fit AND s.fund = g.fund AND s.t = g.t WHERE g.t > 1)),
h{n} AS (SELECT s.*, ll, c0, c1, q0, q1, c0 * q0 / (c0 * q0 + c1 * q1) AS w0, c1 * q1 / (c0 * q0 + c1 * q1) AS w1 FROM s{n} s JOIN f{n} USING (fit, fund, t) JOIN g{n} USING (fit, fund, t)),
x{n} AS (
  SELECT a.fit, a.fund, a.c0 * b.a00 * b.b0 * b.q0 AS x00, a.c0 * b.a01 * b.b1 * b.q1 AS x01, a.c1 * b.a10 * b.b0 * b.q0 AS x10, a.c1 * b.a11 * b.b1 * b.q1 AS x11
  FROM h{n} a JOIN h{n} b ON a.fit = b.fit AND a.fund = b.fund AND b.t = a.t + 1),
j{n} AS (SELECT fit, fund, {", ".join(f"sum(x{i}{j} / (x00 + x01 + x10 + x11)) AS j{i}{j}" for i in (0, 1) for j in (0, 1))} FROM x{n} GROUP BY fit, fund),
u{n} AS (
  SELECT fit, fund, max(w0) FILTER (WHERE t = 1) AS s0, max(w1) FILTER (WHERE t = 1) AS s1, {", ".join(f"sum(w{j}) AS n{j}, any_value(m{j}) + sum(w{j} * (r - m{j})) / sum(w{j}) AS m{j}, sum(w{j} * (r - m{j}) * (r - m{j})) / sum(w{j}) - pow(sum(w{j} * (r - m{j})) / sum(w{j}), 2) + 1e-12 AS v{j}" for j in (0, 1))},
         arg_max(ll, t) AS loglik FROM h{n} GROUP BY fit, fund),
p{n} AS (SELECT fit, fund, s0, s1, m0, m1, v0, v1, j00 / (j00 + j01) AS a00, j01 / (j00 + j01) AS a01, j10 / (j10 + j11) AS a10, j11 / (j10 + j11) AS a11, loglik FROM u{n} JOIN j{n} USING (fit, fund))"""


def _em_query() -> str:
    starts = " UNION ALL ".join(f"SELECT {n} AS fit, fund, 0.5::DOUBLE AS s0, 0.5::DOUBLE AS s1, m + {m[0]} * sd AS m0, m + {m[1]} * sd AS m1, {v[0]} * sd * sd AS v0, {v[1]} * sd * sd AS v1, {a} AS a00, {1 - a!r} AS a01, {1 - a!r} AS a10, {a} AS a11, 0.0::DOUBLE AS loglik FROM spread" for n, m, v, a in _STARTS)
    steps = ",".join(_em_sql(k) for k in range(1, _EM_STEPS + 1))
    cells = ", ".join(f"round({c}, {d}) AS {c}" for c, d in [("s0", 6), ("a00", 6), ("a11", 6), ("m0", 7), ("m1", 7), ("v0", 8), ("v1", 8), ("loglik", 4)])
    return f"""WITH RECURSIVE {t.FUND_MONTHS},
one AS (SELECT fund, r, CAST(row_number() OVER (PARTITION BY fund ORDER BY month) AS INT) AS t FROM fund_months),
spread AS (SELECT fund, avg(r) AS m, stddev_pop(r) AS sd FROM one GROUP BY fund),
p0 AS ({starts}),{steps}
SELECT fit, fund, {cells} FROM p{_EM_STEPS}"""


@query(_em_query())
def em_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of EM for two regimes, from two starts for each fund, all fits side by side."""
    months = t.fund_months(spark, sf_dir)
    spread = months.groupBy("fund").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    starts = F.array(*[F.struct(F.lit(n).alias("fit"), numbers([0.5, 0.5]).alias("start"), F.array(numbers([a, 1 - a]), numbers([1 - a, a])).alias("moves"), F.array(*[F.col("m") + x * F.col("sd") for x in m]).alias("mean"), F.array(*[x * F.col("sd") * F.col("sd") for x in v]).alias("variance")) for n, m, v, a in _STARTS])
    now = spread.select("fund", F.inline(starts))
    now = regime_scan.fit_regimes(months, now, ["fund"], ["month"], "r", _EM_STEPS, 30)
    cell = lambda c, *at: F.col(c)[at[0]] if len(at) == 1 else F.col(c)[at[0]][at[1]]
    cells = {"s0": (cell("start", 0), 6), "a00": (cell("moves", 0, 0), 6), "a11": (cell("moves", 1, 1), 6), "m0": (cell("mean", 0), 7), "m1": (cell("mean", 1), 7), "v0": (cell("variance", 0), 8), "v1": (cell("variance", 1), 8), "loglik": (F.col("loglik"), 4)}
    return now.select("fit", "fund", *[F.round(c, d).alias(n) for n, (c, d) in cells.items()])


# Monthly changes of the mean price of what every supplier ships, and points of parameters: shares of alpha, sums, scales.
_POINTS = [(0.1, 0.95, 1.0), (0.3, 0.9, 1.0), (0.05, 0.99, 1.5), (0.5, 0.6, 0.8), (0.0, 0.9, 1.0)]
_SUPPLIER = """monthly AS (
  SELECT l_suppkey, last_day(CAST(l_shipdate AS DATE)) AS month, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS level FROM lineitem GROUP BY ALL),
moved AS (SELECT l_suppkey, month, ln(level) - ln(lag(level) OVER (PARTITION BY l_suppkey ORDER BY month)) AS r FROM monthly),
facts AS (SELECT l_suppkey, avg(r) AS m, var_pop(r) AS v FROM moved WHERE r IS NOT NULL GROUP BY l_suppkey HAVING count(*) >= 20 AND var_pop(r) > 0),
rows AS (SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY month) AS INT) AS t, r - m AS r, v FROM moved JOIN facts USING (l_suppkey) WHERE r IS NOT NULL)"""


def _supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.last_day(F.col("l_shipdate").cast("date")).alias("month"), "l_extendedprice")
    monthly = lines.groupBy("l_suppkey", "month").agg(t.mean_of_cents("l_extendedprice").alias("level"))
    return monthly.withColumn("r", F.log1p(row_return("level", ["l_suppkey"], "month"))).where("r is not null")


@query(f"""WITH RECURSIVE {_SUPPLIER},
points AS (SELECT * FROM (VALUES {", ".join(f"({k}, {k_ * 1.0!r}::DOUBLE, {a * s!r}::DOUBLE, {(1 - a) * s!r}::DOUBLE, {1 - s!r}::DOUBLE)" for k, (a, s, k_) in enumerate(_POINTS))}) AS p(point, scale, alpha, beta, rest)),
f AS (
  SELECT l_suppkey, point, t, r, v AS s2, v * scale * rest AS omega, alpha, beta, (ln(2 * pi() * v) + r * r / v) / 2 AS cost FROM rows, points WHERE t = 1
  UNION ALL
  SELECT l_suppkey, point, t, r, s2, omega, alpha, beta, cost + (ln(2 * pi() * s2) + r * r / s2) / 2 FROM (
    SELECT f.l_suppkey, point, rows.t, rows.r, omega + alpha * f.r * f.r + beta * f.s2 AS s2, omega, alpha, beta, cost
    FROM f JOIN rows ON rows.l_suppkey = f.l_suppkey AND rows.t = f.t + 1))
SELECT l_suppkey, point, round(arg_max(cost, t), 5) AS cost FROM f GROUP BY l_suppkey, point""")
def garch_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the search: the likelihoods of several parameters for the series of every supplier."""
    moved, facts = volatility_scan.centred(_supplier_changes(spark, sf_dir), ["l_suppkey"], "r")
    point = lambda a, s, k: F.array(F.col("variance") * k * (1 - s), F.lit(a * s), F.lit((1 - a) * s))
    points = facts.withColumn("points", F.array(*[point(*p) for p in _POINTS]))
    placed = segments.in_segments(moved, ["l_suppkey"], "month", 30)
    made = volatility_scan.likelihoods(placed, points, ["l_suppkey"], ["month"], "r")
    return made.select("l_suppkey", F.posexplode("cost").alias("point", "cost")).withColumn("cost", F.round("cost", 5))
