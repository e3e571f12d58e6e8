"""Mortality, annuity factors and life expectancy as windows over months of a life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import ANNUITY_RATE, LAST_AGE

BASE_YEAR = 2020


def gompertz_table(spark: SparkSession) -> DataFrame:
    """A table for tests and demonstrations: (sex, age, q0, aa), ages 20 to 110, the last one certain."""
    ages = spark.range(20, LAST_AGE + 1).select(F.col("id").cast("int").alias("age"))
    sexes = spark.createDataFrame([("H", 2.6e-5), ("M", 1.8e-5)], "sex string, level double")
    q = F.when(F.col("age") == LAST_AGE, 1.0).otherwise(F.least(F.lit(1.0), F.col("level") * F.exp(F.col("age") * 0.095)))
    return ages.crossJoin(F.broadcast(sexes)).select("sex", "age", q.alias("q0"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.lit(0.02) - i * 0.0005).alias("aa"))


def projected(q0: Column, aa: Column, year: Column) -> Column:
    """q0 improved from 2021 to the year, the last improvement going on; within [0, 1]."""
    n = F.greatest(year - BASE_YEAR, F.lit(0))
    known = F.least(n, F.size(aa))
    better = F.aggregate(F.slice(aa, F.lit(1), known), F.lit(1.0), lambda s, a: s * (1 - a))
    further = F.pow(1 - F.element_at(aa, -1), (n - known).cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), q0 * better * further))


def _life_years(cases: DataFrame, table: DataFrame) -> DataFrame:
    """One row per case (sex, age, year) and age x it lives through, with q of that year."""
    span = table.groupBy("sex").agg(F.min("age").alias("_low"), F.max("age").alias("_high"))
    years = cases.join(F.broadcast(span), "sex").withColumn("x", F.explode(F.sequence(F.col("age"), F.lit(LAST_AGE))))
    held = years.withColumn("_at", F.least(F.greatest(F.col("x"), F.col("_low")), F.col("_high")))
    rates = table.select(F.col("sex").alias("_sex"), F.col("age").alias("_at2"), "q0", "aa")
    joined = held.join(F.broadcast(rates), (F.col("sex") == F.col("_sex")) & (F.col("_at") == F.col("_at2")))
    q = F.when(F.col("x") > F.col("_high"), 1.0).otherwise(projected(F.col("q0"), F.col("aa"), F.col("year") + F.col("x") - F.col("age")))
    return joined.select(*cases.columns, "x", q.alias("q"))


def annuity_factors(cases: DataFrame, table: DataFrame, rate: float = ANNUITY_RATE) -> DataFrame:
    """Adds factor: the price of 1 a month for life, paid in advance, for cases (sex, age, year).

    The mortality table is small by nature (ages by sexes) and is broadcast.
    """
    years = _life_years(cases, table)
    months = years.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("k", (F.col("x") - F.col("age")) * 12 + F.col("m"))
    stay = F.pow(1 - F.col("q"), F.lit(1 / 12))
    before = Window.partitionBy(*cases.columns).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    alive = months.withColumn("alive", F.coalesce(F.product(stay).over(before), F.lit(1.0)))
    monthly = (1 + rate) ** (1 / 12)
    return alive.groupBy(*cases.columns).agg(F.sum(F.col("alive") / F.pow(F.lit(monthly), F.col("k").cast("double"))).alias("factor"))


def life_expectancy(cases: DataFrame, table: DataFrame) -> DataFrame:
    """Adds expectancy: whole years still lived, and half a one."""
    upto = Window.partitionBy(*cases.columns).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    alive = _life_years(cases, table).withColumn("alive", F.product(1 - F.col("q")).over(upto))
    return alive.groupBy(*cases.columns).agg((F.sum("alive") + 0.5).alias("expectancy"))


def rate_matrix(table: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(sex, age, year, q) for a range of years."""
    years = table.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    return years.select("sex", "age", "year", projected(F.col("q0"), F.col("aa"), F.col("year")).alias("q"))
