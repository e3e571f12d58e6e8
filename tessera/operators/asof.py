"""As-of joins and step functions, without a Cartesian product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.segments import ROWS_PER_SEGMENT, marked


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, value: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Each left row with the right side's latest (right_on, value) at or before it.

    Both sides are laid in one order per key and the last right row is carried forward:
    one shuffle and one sort, whatever the distance between rows. A key with more rows than
    ``rows_per_segment`` is cut into ranges of time, which take over the mark of the range before.
    A right row of the same moment counts; of several, the one with the largest value. Without keys
    both sides are one series.
    """
    carried = F.struct(F.col(right_on).alias("at"), F.col(value).alias("value"))
    rows = left.withColumn("_when", F.col(on))
    marks = right.where(F.col(right_on).isNotNull()).select(*by, carried.alias("_mark"), F.col(right_on).alias("_when"))
    both = marked(rows, marks, by, "_when", "_mark", rows_per_segment)
    return both.select(*left.columns, F.col("_last.at").alias(right_on), F.col("_last.value").alias(value))


def step_rate(at: Column, steps: list[tuple[int, float]]) -> Column:
    """The rate in force at a month number: that of the last step at or before it, 0 before the first."""
    rate = F.lit(0.0)
    for start, value in sorted(steps):
        rate = F.when(at >= start, F.lit(value)).otherwise(rate)
    return rate


def step_lookup(rows: DataFrame, at: str, steps: DataFrame, start: str = "start", rate: str = "rate") -> DataFrame:
    """Same for a table of steps, a calendar of a few rows that is broadcast as ranges."""
    until = F.lead(start).over(Window.orderBy(start))
    ranges = steps.select(F.col(start).alias("_from"), until.alias("_until"), F.col(rate).alias(rate))
    held = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return rows.join(F.broadcast(ranges), held, "left").withColumn(rate, F.coalesce(rate, F.lit(0.0))).drop("_from", "_until")


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the knots, flat outside."""
    knots = sorted(knots)
    out = F.lit(float(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = F.when(x >= x0, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x >= knots[-1][0], F.lit(float(knots[-1][1]))).otherwise(out)
