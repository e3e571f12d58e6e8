"""Queries of the relational operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import MARKED, PLAIN, canonical_name, local_number
from tessera.operators import asof, checks, panel, peers, stats
from tessera.plans import tables as t
from tessera.plans.tables import table

WIDTHS = [0.05, 0.1, 0.25, 0.5, 1.0, 1.5]
FEES = [(0, 0.0046), (1, 0.0058), (2, 0.0116), (3, 0.0127), (4, 0.0145)]
#: Steps of a contribution calendar, as month numbers (year * 12 + month - 1) and rates.
STEPS = [(1995 * 12 + 7, 0.001), (1996 * 12 + 7, 0.0025), (1998 * 12 + 7, 0.01), (2000 * 12 + 7, 0.017)]

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {t.ORDERS_MONTHS} SELECT fund, admin, month, round(r, 6) AS r, w FROM months")
def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.orders_months(spark, sf_dir), 6, "r")


@query(f"""WITH {t.ORDERS_MONTHS},
one AS (SELECT fund, month, CASE WHEN sum(w) > 0 THEN sum(r * w) / sum(w) ELSE avg(r) END AS ret FROM months GROUP BY fund, month)
SELECT fund, month, round(ret, 6) AS ret, round(100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY fund ORDER BY month)), 4) AS level FROM one""")
def weighted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = t.orders_months(spark, sf_dir).groupBy("fund", "month").agg(panel.weighted_mean("r", "w").alias("ret"))
    return rounded(one.withColumn("level", panel.index_level("ret", ["fund"], "month")), 6, "ret").withColumn("level", F.round("level", 4))


@query(f"""WITH {t.ORDERS_PANEL},
fallen AS (SELECT fund, admin, month, unit_value / max(unit_value) OVER (PARTITION BY fund, admin ORDER BY month) - 1 AS dd FROM panel),
best AS (SELECT *, row_number() OVER (PARTITION BY fund, admin ORDER BY dd, month) AS k FROM fallen)
SELECT fund, admin, round(dd, 6) AS max_drawdown, month AS at FROM best WHERE k = 1""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.worst_drawdown(t.orders_panel(spark, sf_dir), "unit_value", ["fund", "admin"], "month"), 6, "max_drawdown")


@query(f"""WITH {t.SHIPPED_LEVELS},
monthly AS (SELECT fund, last_day(date) AS month, arg_max(level, date) AS level FROM levels
            WHERE last_day(date) < (SELECT last_day(max(date)) FROM levels) OR (SELECT day(max(date)) FROM levels) >= 20 GROUP BY 1, 2),
changed AS (SELECT *, level / lag(level) OVER (PARTITION BY fund ORDER BY month) - 1 AS ret FROM monthly)
SELECT fund, month, round(level, 6) AS level, round(ret, 6) AS ret FROM changed WHERE ret IS NOT NULL""")
def month_end_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.month_end_returns(t.shipped_levels(spark, sf_dir), "level", ["fund"], "date"), 6, "level", "ret")


_BENCH = (
    t.ORDERS_MONTHS
    + """,
benched AS (
  SELECT *, (sum(r * w) OVER p - r * w) / nullif(sum(w) OVER p - w, 0) AS bench FROM months
  WINDOW p AS (PARTITION BY fund, month)),
aligned AS (SELECT * FROM benched WHERE r IS NOT NULL AND bench IS NOT NULL)"""
)
_DEVIATION = (
    _BENCH
    + """,
rolled AS (
  SELECT fund, admin, month, count(*) OVER w AS n,
         exp(sum(ln(1 + r)) OVER w / 3) - 1 - (exp(sum(ln(1 + bench)) OVER w / 3) - 1) AS dev
  FROM aligned WINDOW w AS (PARTITION BY fund, admin ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
deviations AS (SELECT fund, admin, month, dev FROM rolled WHERE n = 36)"""
)


@query(f"WITH {_BENCH} SELECT fund, admin, month, round(r, 6) AS r, w, round(bench, 6) AS bench FROM benched")
def loo_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(peers.with_benchmark(t.orders_months(spark, sf_dir)), 6, "r", "bench")


@query(f"WITH {_DEVIATION} SELECT fund, admin, month, round(dev, 6) AS dev FROM deviations")
def rolling_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(peers.rolling_deviation(t.orders_months(spark, sf_dir)), 6, "dev")


@query(f"""WITH {_DEVIATION}
SELECT fund, CAST(width AS DOUBLE) AS width, count(*) AS n,
       round(avg(CAST(dev < -width AS DOUBLE)), 6) AS below, round(avg(CAST(dev > width AS DOUBLE)), 6) AS above,
       round(avg(CAST(abs(dev) > width AS DOUBLE)), 6) AS outside, round(quantile_cont(abs(dev), 0.95), 6) AS p95_abs
FROM deviations, (SELECT unnest({WIDTHS}::DOUBLE[]) AS width) GROUP BY fund, width""")
def band_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = peers.band_frequency(peers.rolling_deviation(t.orders_months(spark, sf_dir)), WIDTHS)
    return rounded(bands, 6, "below", "above", "outside", "p95_abs")


_ALPHA = (
    _BENCH
    + """,
alphas AS (
  SELECT admin, fund, count(*) AS months,
         exp(avg(ln(1 + r)) * 12) - 1 - (exp(avg(ln(1 + bench)) * 12) - 1) AS alpha,
         stddev_samp(ln(1 + r) - ln(1 + bench)) * sqrt(12) AS tracking_error
  FROM aligned GROUP BY admin, fund HAVING count(*) >= 24)"""
)


@query(f"""WITH {_ALPHA} SELECT admin, fund, months, round(alpha, 6) AS alpha, round(tracking_error, 6) AS tracking_error,
round(tracking_error / sqrt(months / 12.0::DOUBLE), 6) AS standard_error FROM alphas""")
def admin_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(peers.alpha(t.orders_months(spark, sf_dir)), 6, "alpha", "tracking_error", "standard_error")


@query(f"""WITH {_ALPHA},
fees AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}::DOUBLE)" for a, b in FEES)}) AS f(admin, fee)),
mean AS (SELECT admin, avg(alpha) AS alpha, max(months) AS months, avg(tracking_error / sqrt(months / 12.0::DOUBLE)) AS se FROM alphas GROUP BY admin),
joined AS (SELECT f.admin, fee, min(fee) OVER () AS fee_min, alpha, months, se FROM fees f LEFT JOIN mean m ON f.admin = m.admin)
SELECT admin, fee, round(alpha, 6) AS alpha, months, round((fee - fee_min) / 0.1, 6) AS cost_share,
       round((fee - fee_min) / 0.1 * 9.73842, 6) AS cost_pension, round((fee - fee_min) / 4, 6) AS break_even,
       round((alpha - (fee - fee_min) / 4) / se, 4) AS t
FROM joined""")
def fee_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fees = spark.createDataFrame(FEES, "admin int, fee double")
    over = F.col("fee") - F.col("fee_min")
    made = peers.fee_table(peers.alpha(t.orders_months(spark, sf_dir)), fees, over / 4, 0.1, F.lit(9.73842))
    made = rounded(made, 6, "alpha", "cost_share", "cost_pension", "break_even").withColumn("t", F.round("t", 4))
    return made.select("admin", "fee", "alpha", "months", "cost_share", "cost_pension", "break_even", "t")


@query(f"""WITH {t.FUND_MONTHS}, {t.fund_pairs_sql("fund_months", "month")}
SELECT fund, other, month, round(c, 6) AS c FROM (
  SELECT fund, other, month, corr(a, b) OVER w AS c, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER w AS n FROM pairs
  WINDOW w AS (PARTITION BY fund, other ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE n = 36""")
def rolling_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t.fund_pairs(t.fund_months(spark, sf_dir), ["month"])
    rolled = pairs.withColumn("c", panel.rolling_corr("a", "b", ["fund", "other"], "month", 36)).where("c is not null")
    return rounded(rolled.select("fund", "other", "month", "c"), 6, "c")


@query("""WITH click AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, c.ts AS click_ts, round(c.value, 6) AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN click c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    joined = asof.asof_backward(bought, clicks, ["user_id"], "ts", "click_ts", "click_value")
    return rounded(joined.select("event_id", "user_id", "click_ts", "click_value"), 6, "click_value")


@query(f"""WITH steps AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}::DOUBLE)" for a, b in STEPS)}) AS s(start, rate)),
seen AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS month_no, count(*) AS n FROM orders GROUP BY 1)
SELECT month_no, n, coalesce(rate, 0) AS rate FROM seen ASOF LEFT JOIN steps ON month_no >= start""")
def step_rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_no")
    months = table(spark, sf_dir, "orders").groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    return asof.step_lookup(months, "month_no", spark.createDataFrame(STEPS, "start int, rate double"))


# Every administrator k of the daily panel stops k days before the month's end, so that jumps meet endings.
_STOPPED = f"{t.EVENTS_PANEL}, stopped AS (SELECT * FROM daily WHERE date <= (SELECT max(date) FROM daily) - 4 * admin)"
_EVENTS = (
    _STOPPED
    + """,
ends AS (SELECT fund, admin, max(date) AS last FROM stopped GROUP BY fund, admin),
found AS (
  SELECT j.fund, j.admin, j.date, j.ret, coalesce(string_agg(CAST(e.admin AS VARCHAR), ',' ORDER BY CAST(e.admin AS VARCHAR)), '') AS vanished
  FROM (SELECT * FROM stopped WHERE abs(ret) > 0.5) j LEFT JOIN ends e ON j.fund = e.fund AND e.last = j.date - 1
  GROUP BY ALL)"""
)


def _stopped(spark, sf_dir):
    daily = t.events_panel(spark, sf_dir)
    last = daily.agg(F.max("date").alias("_end"))
    return daily.crossJoin(F.broadcast(last)).where(F.col("date") <= F.date_sub("_end", F.col("admin") * 4)).drop("_end")


def _named(daily):
    return daily.select("fund", F.col("admin").cast("string").alias("admin"), "date", "ret")


@query(f"""WITH {_EVENTS} SELECT fund, CAST(admin AS VARCHAR) AS admin, date, round(ret, 6) AS ret, vanished,
CASE WHEN vanished = '' THEN 'review by hand' ELSE 'rebase by merger' END AS diagnosis FROM found""")
def rebase_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checks.rebase_events(_named(_stopped(spark, sf_dir)), 0.5), 6, "ret")


@query(f"""WITH {_EVENTS} SELECT s.fund, CAST(s.admin AS VARCHAR) AS admin, s.date, round(s.ret, 6) AS ret,
round(CASE WHEN f.vanished <> '' THEN 0 ELSE s.ret END, 6) AS ret_adjusted
FROM stopped s LEFT JOIN found f ON s.fund = f.fund AND s.admin = f.admin AND s.date = f.date""")
def rebase_neutralise(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _named(_stopped(spark, sf_dir))
    return rounded(checks.neutralised(daily, checks.rebase_events(daily, 0.5)), 6, "ret", "ret_adjusted")


@query(f"""WITH {t.EVENTS_PANEL},
raw AS (SELECT event_type AS fund, user_id AS admin, CAST(ts AS DATE) AS date, value FROM events),
per AS (SELECT count(*) - count(DISTINCT date) AS again, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS gaps FROM raw GROUP BY fund, admin),
one AS (SELECT count(*) FILTER (WHERE value IS NULL) AS a, count(*) FILTER (WHERE abs(value - 50) > 40) AS b, count(*) FILTER (WHERE admin % 10 = 0) AS c FROM raw)
SELECT 'repeated keys' AS "check", CAST(sum(again) AS BIGINT) AS value FROM per UNION ALL SELECT 'missing days', CAST(sum(gaps) AS BIGINT) FROM per
UNION ALL SELECT 'null values', a FROM one UNION ALL SELECT 'jumps', b FROM one UNION ALL SELECT 'provisional rows', c FROM one""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("fund"), F.col("user_id").alias("admin"), F.col("ts").cast("date").alias("date"), "value")
    raw = raw.withColumn("jump", F.col("value") - 50).withColumn("provisional", F.col("admin") % 10 == 0)
    return checks.quality_report(raw, ["fund", "admin"], "date", "value", "jump", 40.0, "provisional")


_USER_DAYS = "days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events)"


def _user_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date")).distinct()


@query(f"WITH {_USER_DAYS} SELECT user_id, CAST(date_diff('day', min(date), max(date)) + 1 - count(*) AS BIGINT) AS missing FROM days GROUP BY user_id")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_days(_user_days(spark, sf_dir), ["user_id"], "date")


@query(f"""WITH {_USER_DAYS}, spans AS (SELECT user_id, min(date) AS a, max(date) AS b FROM days GROUP BY user_id)
SELECT user_id, date FROM (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans) EXCEPT SELECT user_id, date FROM days""")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_dates(_user_days(spark, sf_dir), ["user_id"], "date")


@query(f"WITH {t.EVENTS_PANEL} SELECT date FROM daily GROUP BY date HAVING isodow(date) < 6 AND sum(abs(ret)) > 0")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.effective_days(t.events_panel(spark, sf_dir), "date", "ret")


@query(f"""WITH {t.EVENTS_PANEL},
deflator AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 3 AS date, min(round(1 + value / 1000, 6)) AS level FROM events GROUP BY 1),
joined AS (SELECT d.fund, d.admin, d.date, unit_value, level FROM daily d LEFT JOIN deflator f ON d.date = f.date),
filled AS (
  SELECT * EXCLUDE (level), coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY fund, admin ORDER BY date ROWS UNBOUNDED PRECEDING),
         first_value(level IGNORE NULLS) OVER (PARTITION BY fund, admin ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM joined)
SELECT fund, admin, date, round(unit_value, 6) AS unit_value, level, round(unit_value / level, 6) AS unit_value_real FROM filled""")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deflator published once a week, on Thursdays, from all events of the week."""
    thursday = F.date_add(F.date_trunc("week", "ts").cast("date"), 3)
    deflator = table(spark, sf_dir, "events").select(thursday.alias("date"), F.round(1 + F.col("value") / 1000, 6).alias("level"))
    daily = t.events_panel(spark, sf_dir).select("fund", "admin", "date", "unit_value")
    real = panel.deflated(daily, deflator, "unit_value", ["fund", "admin"], "date")
    return rounded(real, 6, "unit_value", "unit_value_real")


@query("""WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2),
spine AS (SELECT user_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY user_id)
SELECT s.user_id, s.date, last_value(cents IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS cents
FROM spine s LEFT JOIN daily d ON s.user_id = d.user_id AND s.date = d.date""")
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return panel.on_spine(daily, ["user_id"], "date").select("user_id", "date", panel.filled_both_ways("cents", ["user_id"], "date").alias("cents"))


_MACRO = """macro AS (
  SELECT l_returnflag AS series, last_day(CAST(l_shipdate AS DATE)) AS month,
         CAST(sum(CAST(round(l_discount * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS rate,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS price
  FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_MACRO}, made AS (
  SELECT series, month, CASE WHEN count(*) OVER y = 12 THEN exp(sum(ln(1 + rate / 100)) OVER y) - 1 END AS year_rate,
         rate - lag(rate, 6) OVER s AS change_6, ln(price) - ln(lag(price, 3) OVER s) AS log_change_3, lag(rate, 2) OVER s AS lag_2
  FROM macro WINDOW s AS (PARTITION BY series ORDER BY month), y AS (PARTITION BY series ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT series, month, round(lag(year_rate) OVER (PARTITION BY series ORDER BY month), 9) AS inflation_12, round(change_6, 9) AS change_6,
       round(log_change_3, 9) AS log_change_3, round(lag_2, 9) AS lag_2 FROM made""")
def macro_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.last_day(F.col("l_shipdate").cast("date")).alias("month"))
    cents = F.sum(F.round(F.col("l_discount") * 10000).cast("bigint")).cast("double") / F.count(F.lit(1)) / 10000
    macro = rows.agg(cents.alias("rate"), t.mean_of_cents("l_extendedprice").alias("price"))
    keys = ["series"]
    year = panel.rolling_product(1 + F.col("rate") / 100, keys, "month", 12) - 1
    made = macro.withColumn("year_rate", year).select(
        "series", "month", panel.previous("year_rate", keys, "month").alias("inflation_12"), (F.col("rate") - panel.previous("rate", keys, "month", 6)).alias("change_6"),
        panel.log_change("price", keys, "month", 3).alias("log_change_3"), panel.previous("rate", keys, "month", 2).alias("lag_2"),
    )
    return rounded(made, 9, "inflation_12", "change_6", "log_change_3", "lag_2")


@query("""WITH cells AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE replace(replace(replace(format('{:,.2f}', c_acctbal), ',', '_'), '.', ','), '_', '.') END AS cell FROM customer)
SELECT c_custkey, cell, TRY_CAST(replace(replace(cell, '.', ''), ',', '.') AS DOUBLE) AS number FROM cells""")
def local_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    cells = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "").otherwise(shown).alias("cell"))
    return cells.withColumn("number", local_number(F.col("cell")))


@query(f"""SELECT doc_id, upper(replace(trim(regexp_replace(translate(text, '{MARKED}', '{PLAIN}'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 'ß', 'SS')) AS name FROM documents""")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", canonical_name(F.col("text")).alias("name"))


@query("""WITH base AS (SELECT o_orderpriority AS strategy, quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean, count(*) AS n, avg(CAST(o_totalprice >= 200000 AS DOUBLE)) AS reach FROM orders GROUP BY 1)
SELECT strategy, round(q[1], 4) AS p5, round(q[2], 4) AS p25, round(q[3], 4) AS p50, round(q[4], 4) AS p75, round(q[5], 4) AS p95, round(mean, 4) AS mean, n, round(reach, 6) AS reach,
       (SELECT round(avg(o_totalprice), 4) FROM orders WHERE o_orderpriority = strategy AND o_totalprice <= q[1]) AS cvar5 FROM base""")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("strategy"), "o_totalprice")
    made = stats.summary(orders, ["strategy"], "o_totalprice", goal=200000.0, large=True)
    return rounded(made, 4, "p5", "p25", "p50", "p75", "p95", "mean", "cvar5").withColumn("reach", F.round("reach", 6))


@query("""WITH edges AS (SELECT c_mktsegment AS s, quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS e FROM customer GROUP BY 1),
cut AS (SELECT c_mktsegment AS segment, c_acctbal, CASE WHEN c_acctbal <= e[1] THEN 1 WHEN c_acctbal <= e[2] THEN 2 WHEN c_acctbal <= e[3] THEN 3 WHEN c_acctbal <= e[4] THEN 4 ELSE 5 END AS quintile FROM customer JOIN edges ON s = c_mktsegment)
SELECT segment, quintile, count(*) AS n, round(median(c_acctbal), 6) AS median FROM cut GROUP BY 1, 2""")
def quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    cut = stats.quintiles(rows, ["segment"], "c_acctbal", large=True)
    return rounded(stats.exact_percentiles(cut, ["segment", "quintile"], "c_acctbal", {"median": 0.5}), 6, "median")


@query("""WITH c AS (SELECT o_orderstatus AS status, quantile_cont(o_totalprice, [x / 100.0 FOR x IN range(1, 100)]) AS q FROM orders GROUP BY 1)
SELECT status, CAST(unnest(range(1, 100)) AS INT) AS percent, round(unnest(q), 4) AS value FROM c""")
def percentile_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    return rounded(stats.percentile_curve(rows, ["status"], "o_totalprice"), 4, "value")


@query("""WITH long AS (UNPIVOT (SELECT l_returnflag AS flag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE value)
SELECT flag, metric, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM long GROUP BY 1, 2""")
def melt_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), *metrics)
    return rounded(stats.melted_percentiles(rows, ["flag"], metrics, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, large=True), 6, "p5", "p50", "p95")


@query("""SELECT event_type, CAST(least(CASE WHEN value = 90 THEN 89 ELSE floor(value - 0.0::DOUBLE) END, 89) AS INT) AS bin, count(*) AS n
FROM events WHERE value >= 0 AND value <= 90 GROUP BY 1, 2""")
def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 0.0, 90.0, 90)


GRID = [(g0, a1, g1) for g0 in (0.6, 0.8, 1.0) for a1 in (30, 45) for g1 in (0.2, 0.6, 0.8) if g1 <= g0]


@query(f"""WITH grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}, {c}::DOUBLE)" for a, b, c in GRID)}) AS g(g0, a1, g1)),
pays AS (SELECT g0, a1, g1, (o_totalprice / 1000) * (1 - g0) + g1 * 100 + a1 AS x FROM orders, grid)
SELECT g0, a1, g1, round(pow(avg(pow(greatest(x, 1e-9), -2.0::DOUBLE)), -0.5::DOUBLE), 6) AS ce, round(median(x), 6) AS median,
       round(exp(avg(ln(greatest(x, 1e-9)))), 6) AS ce_log
FROM pays GROUP BY ALL ORDER BY ce DESC, g0, a1, g1 LIMIT 5""")
def certainty_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best points of a grid, each applied to all orders; the report is a top five by nature."""
    grid = spark.createDataFrame(GRID, "g0 double, a1 int, g1 double")
    pays = table(spark, sf_dir, "orders").select("o_totalprice").crossJoin(F.broadcast(grid))
    pays = pays.withColumn("x", F.col("o_totalprice") / 1000 * (1 - F.col("g0")) + F.col("g1") * 100 + F.col("a1"))
    x = F.col("x")
    made = pays.groupBy("g0", "a1", "g1").agg(stats.certainty_equivalent(x, 3.0).alias("ce"), stats.certainty_equivalent(x, 1.0).alias("ce_log"))
    made = made.join(stats.exact_percentiles(pays, ["g0", "a1", "g1"], "x", {"median": 0.5}).drop("n"), ["g0", "a1", "g1"])
    return rounded(made, 6, "ce", "median", "ce_log").orderBy(F.desc("ce"), "g0", "a1", "g1").limit(5)


@query("""WITH m AS (SELECT o_orderstatus AS status, median(o_totalprice) AS median FROM orders GROUP BY 1),
near AS (SELECT status, median, o_orderkey, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY status ORDER BY round(abs(o_totalprice - median), 9), o_orderkey) AS k FROM orders JOIN m ON o_orderstatus = status)
SELECT status, round(median, 4) AS median, o_orderkey, o_totalprice, o_orderpriority FROM near WHERE k = 1""")
def nearest_median_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", "o_totalprice", "o_orderpriority")
    return rounded(stats.nearest_to_median(rows, ["status"], "o_totalprice", "o_orderkey", ["o_orderpriority"]), 4, "median")


@query(f"""WITH {t.FUND_MONTHS}, {t.fund_pairs_sql("fund_months", "month")},
c AS (SELECT fund, other, corr(a, b) AS r, CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS n FROM pairs GROUP BY fund, other)
SELECT fund, other, round(r, 6) AS r, n, round(tanh(atanh(r) - 1.645 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.645 / sqrt(n - 3)), 6) AS high FROM c""")
def fisher_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t.fund_pairs(t.fund_months(spark, sf_dir), ["month"]).dropna()
    each = pairs.groupBy("fund", "other").agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))
    low, high = stats.fisher_interval(F.col("r"), F.col("n"))
    return rounded(each.select("fund", "other", "r", "n", low.alias("low"), high.alias("high")), 6, "r", "low", "high")


@query(f"""WITH {t.FUND_MONTHS}, {t.fund_pairs_sql("fund_months", "month")},
c AS (SELECT fund, other, month, a - b - avg(a - b) OVER pair AS c, avg(a - b) OVER pair AS m FROM pairs WHERE a - b IS NOT NULL WINDOW pair AS (PARTITION BY fund, other)),
l AS (SELECT fund, other, c, m, {", ".join(f"lag(c, {k}) OVER (PARTITION BY fund, other ORDER BY month) AS l{k}" for k in range(1, 7))} FROM c),
v AS (SELECT fund, other, count(*) AS n, any_value(m) AS mean, (sum(c * c) + {" + ".join(f"2 * (1 - {k} / 7.0::DOUBLE) * coalesce(sum(c * l{k}), 0)" for k in range(1, 7))}) / count(*) AS variance FROM l GROUP BY fund, other)
SELECT fund, other, n, round(mean, 8) AS mean, round(variance, 8) AS variance, round(mean / sqrt(variance / n), 4) AS t FROM v""")
def dm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = t.fund_pairs(t.fund_months(spark, sf_dir), ["month"]).dropna()
    made = stats.diebold_mariano(pairs.select("fund", "other", "month", (F.col("a") - F.col("b")).alias("d")), "month", "d", keys=("fund", "other"))
    return rounded(made, 8, "mean", "variance").withColumn("t", F.round("t", 4))


@query("""SELECT e.vec_id, e.label, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot,
       round(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS norm
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q""")
def embedding_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    first = rows.agg(F.min_by("x", "vec_id").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    joined = rows.crossJoin(F.broadcast(first))
    return joined.select("vec_id", "label", F.round(dot("x", "q"), 6).alias("dot"), F.round(F.sqrt(dot("x", "x")), 6).alias("norm"))


@query("""WITH x AS (SELECT vec_id, CAST(1 + label AS DOUBLE) AS w, CAST(unnest(range(1, len(embedding) + 1)) AS INT) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT a.k AS a, b.k AS b, round(covar_samp(a.x, b.x), 6) + 0 AS cov, round(sum(a.w * a.x * b.x) / sum(a.w) - sum(a.w * a.x) / sum(a.w) * sum(a.w * b.x) / sum(a.w), 6) + 0 AS wcov
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY a.k, b.k""")
def embedding_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("embedding", (1 + F.col("label")).alias("w"))
    return rounded(stats.covariance_matrix(rows, "embedding", "w"), 6, "cov", "wcov")


@query(f"""WITH {t.ORDERS_MONTHS}, {t.fund_pairs_sql("months", "admin, month")}
SELECT admin, fund, other, count(*) AS n, avg(CAST(a > b AS DOUBLE)) AS wins, avg(CAST(a < b AS DOUBLE)) AS loses, round(median(a) - median(b), 6) AS median_gap
FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY admin, fund, other""")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one strategy beats another on the same path, for every two of them."""
    pairs = t.fund_pairs(t.orders_months(spark, sf_dir), ["admin", "month"]).dropna()
    a, b = F.col("a"), F.col("b")
    gap = F.percentile(a, F.lit(0.5)) - F.percentile(b, F.lit(0.5))
    return pairs.groupBy("admin", "fund", "other").agg(F.count(F.lit(1)).alias("n"), F.avg((a > b).cast("double")).alias("wins"), F.avg((a < b).cast("double")).alias("loses"), F.round(gap, 6).alias("median_gap"))


@query(f"""WITH {t.FUND_MONTHS},
labelled AS (SELECT fund, month, CASE WHEN r < -0.03 THEN 2 WHEN r > 0.03 THEN 1 ELSE 0 END AS label FROM fund_months),
rest AS (SELECT fund, month, label, avg(CAST(label = 1 AS DOUBLE)) OVER (PARTITION BY fund ORDER BY month DESC ROWS UNBOUNDED PRECEDING) AS share FROM labelled)
SELECT fund, CASE label WHEN 0 THEN 'calm' WHEN 1 THEN 'swing' ELSE 'stress' END AS regime, count(*) AS months, min(month) AS first_month,
       min(month) FILTER (WHERE label = 1 AND share > 0.3) AS sustained FROM rest GROUP BY fund, label""")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, first month and start of a sustained stretch of each label."""
    label = F.when(F.col("r") < -0.03, 2).when(F.col("r") > 0.03, 1).otherwise(0)
    rows = t.fund_months(spark, sf_dir).withColumn("label", label)
    onward = Window.partitionBy("fund").orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("share", F.avg((F.col("label") == 1).cast("double")).over(onward))
    names = F.create_map(*[F.lit(x) for kv in ((0, "calm"), (1, "swing"), (2, "stress")) for x in kv])
    sustained = F.min(F.when((F.col("label") == 1) & (F.col("share") > 0.3), F.col("month")))
    made = rows.groupBy("fund", "label").agg(F.count(F.lit(1)).alias("months"), F.min("month").alias("first_month"), sustained.alias("sustained"))
    return made.select("fund", names[F.col("label")].alias("regime"), "months", "first_month", "sustained")


@query(f"""WITH {t.ORDERS_MONTHS},
vol AS (SELECT fund, month, stddev_samp(r) AS vol FROM months GROUP BY 1, 2 HAVING count(*) > 1)
SELECT fund, month, round(vol, 6) AS vol, round(avg(vol) OVER (PARTITION BY fund ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth,
       round(sum(vol) OVER (PARTITION BY fund ORDER BY month), 4) AS cumulative FROM vol""")
def smoothed_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly dispersion, its mean of up to three months, and its running sum."""
    vol = t.orders_months(spark, sf_dir).groupBy("fund", "month").agg(F.stddev_samp("r").alias("vol"), F.count(F.lit(1)).alias("n")).where("n > 1")
    w = panel.series(["fund"], "month")
    made = vol.select("fund", "month", "vol", F.avg("vol").over(w.rowsBetween(-2, 0)).alias("smooth"), F.sum("vol").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))
    return rounded(made, 6, "vol", "smooth").withColumn("cumulative", F.round("cumulative", 4))


@query(f"""WITH {t.SHIPPED_LEVELS},
r AS (SELECT fund, date, level / 50000 AS x FROM levels),
z AS (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY fund ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT fund, date, round((x - m) / s, 4) + 0 AS z FROM z WHERE n >= 24 AND s > 0""")
def past_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the scale of their own past only."""
    past = panel.series(["fund"], "date").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.shipped_levels(spark, sf_dir).withColumn("x", F.col("level") / 50000)
    rows = rows.withColumn("m", F.avg("x").over(past)).withColumn("s", F.stddev_pop("x").over(past)).withColumn("n", F.count("x").over(past))
    return rows.where("n >= 24 and s > 0").select("fund", "date", F.round((F.col("x") - F.col("m")) / F.col("s"), 4).alias("z"))


@query(f"""WITH {_ALPHA} SELECT admin, fund, round(alpha - 1.96 * tracking_error / sqrt(months / 12.0::DOUBLE), 5) AS low, round(alpha, 5) AS alpha,
round(alpha + 1.96 * tracking_error / sqrt(months / 12.0::DOUBLE), 5) AS high, CAST(rank() OVER (PARTITION BY fund ORDER BY round(alpha, 5) DESC, admin) AS INT) AS place FROM alphas""")
def alpha_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 1.96 standard errors around each alpha, best first within a fund."""
    made = peers.alpha(t.orders_months(spark, sf_dir))
    wide = 1.96 * F.col("standard_error")
    made = made.select("admin", "fund", F.round(F.col("alpha") - wide, 5).alias("low"), F.round("alpha", 5).alias("alpha"), F.round(F.col("alpha") + wide, 5).alias("high"))
    return made.withColumn("place", F.rank().over(Window.partitionBy("fund").orderBy(F.desc("alpha"), "admin")))


@query(f"""WITH {t.ORDERS_MONTHS}, a AS (SELECT fund, admin, month, r FROM months WHERE admin <= 2), b AS (SELECT fund, admin, month, r FROM months WHERE admin >= 2)
SELECT coalesce(a.fund, b.fund) AS fund, coalesce(a.month, b.month) AS month, count(*) AS n, round(sum(coalesce(a.r, 0) - coalesce(b.r, 0)), 6) AS gap
FROM a FULL JOIN b ON a.fund = b.fund AND a.admin = b.admin AND a.month = b.month GROUP BY 1, 2""")
def aligned_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two tables on their keys, a key that one lacks counting as 0 there: the lower and the upper administrators, who share one."""
    months, keys = t.orders_months(spark, sf_dir).select("fund", "admin", "month", "r"), ["fund", "admin", "month"]
    a, b = months.where("admin <= 2").withColumnRenamed("r", "x"), months.where("admin >= 2").withColumnRenamed("r", "y")
    joined = a.join(b, keys, "full")
    gap = F.sum(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return joined.groupBy("fund", "month").agg(F.count(F.lit(1)).alias("n"), F.round(gap, 6).alias("gap"))
