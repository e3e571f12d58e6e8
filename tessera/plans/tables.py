"""The driver's tables seen as fund panels, each with the SQL that says the same.

Prices are added up as whole cents, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.panel import row_return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean_of_cents(value: str):
    return F.sum(F.round(F.col(value) * 100).cast("bigint")).cast("double") / F.count(F.lit(1)) / 100


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, admin, month, unit_value, weight): market segment, region, mean order, orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.last_day(F.col("o_orderdate").cast("date")).alias("month"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = joined.groupBy(F.col("c_mktsegment").alias("fund"), F.col("n_regionkey").alias("admin"), "month")
    return grouped.agg(mean_of_cents("o_totalprice").alias("unit_value"), F.count(F.lit(1)).cast("double").alias("weight"))


ORDERS_PANEL = """panel AS (
  SELECT c_mktsegment AS fund, n_regionkey AS admin, last_day(CAST(o_orderdate AS DATE)) AS month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS unit_value,
         CAST(count(*) AS DOUBLE) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""


def orders_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, admin, month, r, w): returns of the panel's unit values, first rows dropped."""
    panel = orders_panel(spark, sf_dir)
    r = row_return("unit_value", ["fund", "admin"], "month")
    return panel.withColumn("r", r).where("r is not null").select("fund", "admin", "month", "r", F.col("weight").alias("w"))


ORDERS_MONTHS = (
    ORDERS_PANEL
    + """,
months AS (
  SELECT * FROM (
    SELECT fund, admin, month, unit_value / lag(unit_value) OVER (PARTITION BY fund, admin ORDER BY month) - 1 AS r, weight AS w FROM panel)
  WHERE r IS NOT NULL)"""
)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, admin, date, unit_value, assets, ret): event type, user modulo 7, mean value, events, daily return."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("fund"), (F.col("user_id") % 7).cast("int").alias("admin"), F.col("ts").cast("date").alias("date"), "value")
    panel = rows.groupBy("fund", "admin", "date").agg(mean_of_cents("value").alias("unit_value"), F.count(F.lit(1)).cast("double").alias("assets"))
    return panel.withColumn("ret", row_return("unit_value", ["fund", "admin"], "date"))


EVENTS_PANEL = """daily AS (
  SELECT *, unit_value / nullif(lag(unit_value) OVER (PARTITION BY fund, admin ORDER BY date), 0) - 1 AS ret FROM (
    SELECT event_type AS fund, CAST(user_id % 7 AS INT) AS admin, CAST(ts AS DATE) AS date,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS unit_value, CAST(count(*) AS DOUBLE) AS assets
    FROM events GROUP BY ALL))"""


def shipped_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, date, level): return flag, ship date, mean extended price."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("fund"), F.col("l_shipdate").cast("date").alias("date"), "l_extendedprice")
    return rows.groupBy("fund", "date").agg(mean_of_cents("l_extendedprice").alias("level"))


SHIPPED_LEVELS = """levels AS (
  SELECT l_returnflag AS fund, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS level
  FROM lineitem GROUP BY ALL)"""


def fund_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fund, month, r): weighted return of all administrators of a fund, damped to a monthly scale by tanh(r) / 10."""
    months = orders_months(spark, sf_dir)
    mean = F.sum(F.col("r") * F.col("w")) / F.sum("w")
    return months.groupBy("fund", "month").agg((F.tanh(F.round(mean, 9)) / 10).alias("r"))


FUND_MONTHS = (
    ORDERS_MONTHS
    + """,
fund_months AS (SELECT fund, month, tanh(round(sum(r * w) / sum(w), 9)) / 10 AS r FROM months GROUP BY fund, month)"""
)

#: The five segments in the order of funds A to E.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PAIRS = [(a, b) for i, a in enumerate(SEGMENTS) for b in SEGMENTS[i + 1 :]]


def fund_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fund, other, a, b): returns of every two funds beside each other, null where one has none."""
    wide = rows.groupBy(*keys).pivot("fund", list(SEGMENTS)).agg(F.max("r"))
    pair = lambda a, b: F.struct(F.lit(a).alias("fund"), F.lit(b).alias("other"), F.col(a).alias("a"), F.col(b).alias("b"))
    return wide.select(*keys, F.inline(F.array(*[pair(a, b) for a, b in PAIRS])))


def fund_pairs_sql(source: str, keys: str) -> str:
    wide = ", ".join(f"max(r) FILTER (WHERE fund = '{s}') AS {s.lower()}" for s in SEGMENTS)
    cells = " UNION ALL ".join(f"SELECT {keys}, '{a}' AS fund, '{b}' AS other, {a.lower()} AS a, {b.lower()} AS b FROM wide" for a, b in PAIRS)
    return f"wide AS (SELECT {keys}, {wide} FROM {source} GROUP BY {keys}), pairs AS ({cells})"
