"""Panels of series: returns, fills, weighted indices, drawdowns, month ends, rolling measures.

A panel is long: keys, an order column and values. Every operator is a window over the
keys or an aggregation, so it shuffles once on the keys; operators on the same keys
reuse that partitioning. Rows are ordered within a series, whose length is a span of
time and doesn't grow with the number of series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: list[str], order: str, rows: int):
    return series(keys, order).rowsBetween(1 - rows, 0)


def previous(value: str, keys: list[str], order: str, k: int = 1) -> Column:
    return F.lag(value, k).over(series(keys, order))


def row_return(value: str, keys: list[str], order: str) -> Column:
    """Change against the row before, by row and not by calendar; null on the first row."""
    return F.try_divide(F.col(value), previous(value, keys, order)) - 1


def log_change(value: str, keys: list[str], order: str, k: int) -> Column:
    return F.ln(value) - F.ln(previous(value, keys, order, k))


def filled_both_ways(value: str, keys: list[str], order: str) -> Column:
    """The last known value; before the first known one, that one."""
    w = series(keys, order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after)


def compound(ret: str | Column) -> Column:
    """Aggregate: return over all rows, a null counting as no change."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    return F.exp(F.sum(F.ln(1 + F.coalesce(ret, F.lit(0.0))))) - 1


def weighted_mean(ret: str, weight: str) -> Column:
    """Aggregate: mean by weight; plain mean where the weights sum to nothing. Nulls count as 0."""
    r, w = F.coalesce(F.col(ret), F.lit(0.0)), F.coalesce(F.col(weight), F.lit(0.0))
    return F.when(F.sum(w) > 0, F.try_divide(F.sum(r * w), F.sum(w))).otherwise(F.avg(r))


def index_level(ret: str, keys: list[str], order: str, base: float = 100.0) -> Column:
    w = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.lit(base) * F.exp(F.sum(F.ln(1 + F.coalesce(F.col(ret), F.lit(0.0)))).over(w))


def drawdown(level: str, keys: list[str], order: str) -> Column:
    peak = F.max(level).over(series(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(level) / peak - 1


def worst_drawdown(levels: DataFrame, level: str, keys: list[str], order: str) -> DataFrame:
    """(keys, max_drawdown, at): the deepest fall of each series and its first date."""
    fallen = levels.withColumn("_dd", drawdown(level, keys, order))
    return fallen.groupBy(*keys).agg(F.min("_dd").alias("max_drawdown"), F.min_by(F.col(order), F.struct("_dd", order)).alias("at"))


def month_end_returns(levels: DataFrame, level: str, keys: list[str], date: str, last_month_min_day: int = 20) -> DataFrame:
    """(keys, month, level, ret): the last level of each month and its change; the first month drops out.

    The last month counts only if the table's last day is that far into it.
    """
    monthly = levels.groupBy(*keys, F.last_day(date).alias("month")).agg(F.max_by(level, date).alias("level"), F.max(date).alias("_last"))
    last = levels.agg(F.max(date).alias("_end"))
    monthly = monthly.crossJoin(F.broadcast(last)).where((F.col("month") < F.last_day("_end")) | (F.dayofmonth("_end") >= last_month_min_day))
    return monthly.withColumn("ret", row_return("level", keys, "month")).where("ret is not null").select(*keys, "month", "level", "ret")


def rolling_log_return(ret: str, keys: list[str], order: str, rows: int, per_year: int = 12) -> Column:
    """Annualised return over the last ``rows`` rows that there are; null before that many."""
    w = trailing(keys, order, rows)
    total = F.sum(F.ln(1 + F.col(ret))).over(w)
    return F.when(F.count(ret).over(w) == rows, F.exp(total * (per_year / rows)) - 1)


def rolling_product(factor: Column, keys: list[str], order: str, rows: int) -> Column:
    w = trailing(keys, order, rows)
    return F.when(F.count(factor).over(w) == rows, F.exp(F.sum(F.ln(factor)).over(w)))


def rolling_corr(a: str, b: str, keys: list[str], order: str, rows: int) -> Column:
    w = trailing(keys, order, rows)
    return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(w) == rows, F.corr(a, b).over(w))


def reverse_growth(ret: str, keys: list[str], order: str) -> Column:
    """Growth from each row to the end, that row's return included."""
    w = series(keys, order).rowsBetween(0, Window.unboundedFollowing)
    return F.exp(F.sum(F.ln(1 + F.col(ret))).over(w))


def effective_days(panel: DataFrame, date: str, ret: str) -> DataFrame:
    """(date) of weekdays on which some series moved."""
    moved = panel.groupBy(date).agg(F.sum(F.abs(ret)).alias("_moved"))
    return moved.where((F.weekday(date) < 5) & (F.col("_moved") > 0)).select(date)


def on_spine(rows: DataFrame, keys: list[str], date: str, step: str = "interval 1 day") -> DataFrame:
    """Each series on every calendar step between its first and last date, gaps null."""
    spans = rows.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    spine = spans.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(date))
    return spine.join(rows, [*keys, date], "left")


def deflated(panel: DataFrame, deflator: DataFrame, value: str, keys: list[str], date: str) -> DataFrame:
    """Adds level (filled both ways within a series) and real value = value / level.

    The deflator has one level per date, a small table by nature: (date, level); of
    repeated dates the least level counts.
    """
    levels = deflator.groupBy(date).agg(F.min("level").alias("level"))
    joined = panel.join(levels, date, "left").withColumn("level", filled_both_ways("level", keys, date))
    return joined.withColumn(f"{value}_real", F.try_divide(F.col(value), F.col("level")))
