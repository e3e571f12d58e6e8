"""Data quality: jumps after mergers, duplicates, gaps, provisional rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW = "review by hand"


def rebase_events(panel: DataFrame, threshold: float = 0.10) -> DataFrame:
    """(fund, admin, date, ret, vanished, diagnosis) of each jump beyond the threshold.

    ``panel`` is (fund, admin, date, ret). A jump on the day after the last row of other
    administrators of the fund is a rebase by merger; others are left for review.
    """
    jumps = panel.where(F.abs("ret") > threshold).select("fund", "admin", "date", "ret")
    ends = panel.groupBy(F.col("fund").alias("_fund"), F.col("admin").alias("_gone")).agg(F.max("date").alias("_last"))
    met = jumps.join(ends, (F.col("fund") == F.col("_fund")) & (F.col("_last") == F.date_sub("date", 1)), "left")
    gone = F.array_join(F.array_sort(F.collect_list("_gone")), ",")
    events = met.groupBy("fund", "admin", "date", "ret").agg(gone.alias("vanished"))
    return events.withColumn("diagnosis", F.when(F.col("vanished") == "", REVIEW).otherwise("rebase by merger"))


def neutralised(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ret_adjusted: 0 where a rebase explains the jump, else ret."""
    keys = ["fund", "admin", "date"]
    flags = events.where(F.col("diagnosis") != REVIEW).select(*keys, F.lit(True).alias("_rebase"))
    return panel.join(flags, keys, "left").withColumn("ret_adjusted", F.when(F.col("_rebase"), 0.0).otherwise(F.col("ret"))).drop("_rebase")


def missing_days(panel: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, missing): calendar days between a series' first and last day without a row."""
    span = F.datediff(F.max(date), F.min(date)) + 1 - F.count_distinct(date)
    return panel.groupBy(*keys).agg(span.cast("bigint").alias("missing"))


def missing_dates(panel: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, date) of those days."""
    spans = panel.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    every = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias(date))
    return every.join(panel.select(*keys, date), [*keys, date], "left_anti")


def quality_report(panel: DataFrame, keys: list[str], date: str, value: str, jump: str, threshold: float, provisional: str) -> DataFrame:
    """(check, value) in five rows: repeated keys, missing days, null values, jumps, provisional rows.

    ``jump`` is a column with returns and ``provisional`` a boolean column. One pass counts
    what needs no keys; repeats and gaps are counted per series first.
    """
    plain = panel.agg(
        F.count_if(F.col(value).isNull()).alias("null values"),
        F.count_if(F.abs(jump) > threshold).alias("jumps"),
        F.count_if(provisional).alias("provisional rows"),
    )
    per = panel.groupBy(*keys).agg(
        (F.count(F.lit(1)) - F.count_distinct(date)).alias("_again"),
        (F.datediff(F.max(date), F.min(date)) + 1 - F.count_distinct(date)).alias("_gaps"),
    )
    grouped = per.agg(F.coalesce(F.sum("_again"), F.lit(0)).alias("repeated keys"), F.coalesce(F.sum("_gaps"), F.lit(0)).cast("bigint").alias("missing days"))
    names = ["repeated keys", "missing days", "null values", "jumps", "provisional rows"]
    return grouped.crossJoin(plain).select(*names).unpivot([], names, "check", "value")
