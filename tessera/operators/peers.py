"""Administrators against their peers: leave-one-out benchmarks, deviations, bands, fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.panel import rolling_log_return


def monthly_admin_returns(daily: DataFrame, min_days: int = 20) -> DataFrame:
    """(fund, admin, month, r, w) of daily (fund, admin, date, ret, weight): compounded, last known weight."""
    r = F.exp(F.sum(F.ln(1 + F.coalesce("ret", F.lit(0.0))))) - 1
    last = F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("date")))
    months = daily.groupBy("fund", "admin", F.last_day("date").alias("month")).agg(r.alias("r"), last.alias("w"), F.count(F.lit(1)).alias("days"))
    return months.where(F.col("days") >= min_days).drop("days")


def with_benchmark(months: DataFrame) -> DataFrame:
    """Adds bench: the weighted return of the others of the fund and month; null where there are none."""
    peers = Window.partitionBy("fund", "month")
    w = F.when(F.col("r").isNotNull(), F.col("w"))
    rw = F.col("r") * w
    total_rw, total_w = F.coalesce(F.sum(rw).over(peers), F.lit(0.0)), F.coalesce(F.sum(w).over(peers), F.lit(0.0))
    return months.withColumn("bench", F.try_divide(total_rw - F.coalesce(rw, F.lit(0.0)), total_w - F.coalesce(w, F.lit(0.0))))


def aligned(months: DataFrame) -> DataFrame:
    return with_benchmark(months).where("r is not null and bench is not null")


def rolling_deviation(months: DataFrame, window: int = 36) -> DataFrame:
    """(fund, admin, month, dev): annualised return over ``window`` aligned rows less the peers'."""
    keys = ["fund", "admin"]
    own, peer = (rolling_log_return(c, keys, "month", window) for c in ("r", "bench"))
    return aligned(months).withColumn("dev", own - peer).where("dev is not null").select(*keys, "month", "dev")


def band_frequency(deviations: DataFrame, widths: list[float]) -> DataFrame:
    """(fund, width, n, below, above, outside, p95_abs) of each fund and band width."""
    share = lambda test: F.avg(test.cast("double"))
    banded = deviations.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    return banded.groupBy("fund", "width").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("dev") < -F.col("width")).alias("below"),
        share(F.col("dev") > F.col("width")).alias("above"),
        share(F.abs("dev") > F.col("width")).alias("outside"),
        F.percentile(F.abs("dev"), F.lit(0.95)).alias("p95_abs"),
    )


def alpha(months: DataFrame, min_months: int = 24) -> DataFrame:
    """(admin, fund, months, alpha, tracking_error, standard_error) against the peers."""
    year = lambda c: F.exp(F.avg(F.ln(1 + F.col(c))) * 12) - 1
    te = F.stddev_samp(F.ln(1 + F.col("r")) - F.ln(1 + F.col("bench"))) * F.sqrt(F.lit(12.0))
    per = aligned(months).groupBy("admin", "fund").agg(F.count(F.lit(1)).alias("months"), (year("r") - year("bench")).alias("alpha"), te.alias("tracking_error"))
    return per.where(F.col("months") >= min_months).withColumn("standard_error", F.col("tracking_error") / F.sqrt(F.col("months") / 12.0))


def fee_table(alphas: DataFrame, fees: DataFrame, break_even: Column, contribution: float, pension: Column) -> DataFrame:
    """Per administrator of ``fees`` (admin, fee): cost in pension, extra return needed, alpha, t.

    ``break_even`` and ``pension`` are expressions over (fee, fee_min): the extra return
    that offsets the fee, and the pension that the plain contribution pays.
    """
    mean = alphas.groupBy("admin").agg(F.avg("alpha").alias("alpha"), F.max("months").alias("months"), F.avg("standard_error").alias("standard_error"))
    cheapest = fees.agg(F.min("fee").alias("fee_min"))
    table = fees.crossJoin(F.broadcast(cheapest)).join(mean, "admin", "left")
    over = (F.col("fee") - F.col("fee_min")) / contribution
    table = table.withColumn("cost_share", over).withColumn("cost_pension", over * pension).withColumn("break_even", break_even)
    excess = F.col("alpha") - F.col("break_even")
    return table.withColumn("excess", excess).withColumn("t", F.try_divide(excess, F.col("standard_error")))
