"""Long series in many tasks: running measures, rolling windows and as-of marks by ranges of a series.

A window over a series puts all of it in one task. Here a series with more rows than
``rows_per_segment`` is cut into ranges of its order, at quantiles that an aggregation sketches;
each range is reduced to one row, what the ranges before it come to is carried over by a scan of those
few rows, and enters each range as a row of its own. So the rows are shuffled once, by series
and range, and no task holds more than a range. Cuts only decide where work is done: results
are those of one window over the series, whatever the cuts are.

Rolling windows need no carry but the rows before a range: rows are numbered by a running count,
and the last ones of each block of numbers are copied into the next one.

Rows of equal order stand in one range, so an order with very many equal values should have
further columns; only the first one makes cuts, the others break ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a series that one task may hold, about.
ROWS_PER_SEGMENT = 1_000_000
#: Cuts of one series at most; of a longer one the ranges grow.
MOST_CUTS = 10_000
#: Series and cuts that are broadcast at most: about 8 bytes each. Beyond it Spark shuffles.
BROADCAST_CUTS = 1_000_000


def _null_safe(keys: list[str], side: str) -> Column:
    matches = [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys]
    out = F.lit(True)
    for m in matches:
        out = out & m
    return out


def cut_points(rows: DataFrame, keys: list[str], order: str, rows_per_segment: int) -> tuple[DataFrame, int] | None:
    """(keys, heads, groups) of the series with more rows than a segment, and the number of cuts; None if there is none.

    ``groups`` holds the cuts in groups of equal length, ``heads`` the first one of each, so that
    a row finds its range with few comparisons.
    """
    sizes = rows.groupBy(*keys).agg(F.count(order).alias("_n")).where(F.col("_n") > rows_per_segment)
    most, series = sizes.agg(F.max("_n"), F.count(F.lit(1))).first()
    if not series:
        return None
    steps = min(MOST_CUTS, -(-most // rows_per_segment))
    shares = F.expr("array(" + ", ".join(f"{k / steps!r}D" for k in range(1, steps)) + ")") if steps > 1 else F.expr("array(0.5D)")
    found = rows.groupBy(*keys).agg(F.count(order).alias("_n"), F.percentile_approx(order, shares, max(10_000, 20 * steps)).alias("_cuts")).where(F.col("_n") > rows_per_segment)
    stride = F.greatest(F.lit(1), F.floor(F.lit(float(steps)) * rows_per_segment / F.col("_n")).cast("int"))
    kept = found.select(*keys, stride.alias("_stride"), F.array_distinct("_cuts").alias("_cuts"))
    kept = kept.select(*keys, F.filter("_cuts", lambda c, i: (i + 1) % F.col("_stride") == 0).alias("_cuts"))
    width = max(1, int(steps**0.5))
    firsts = F.when(F.size("_cuts") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_cuts")), F.lit(width))).otherwise(F.array().cast("array<int>"))
    grouped = kept.select(*keys, F.transform(firsts, lambda i: F.slice("_cuts", i, F.lit(width))).alias("_groups"))
    return grouped.withColumn("_heads", F.transform("_groups", lambda g: F.get(g, 0))), series * steps


def in_segments(rows: DataFrame, keys: list[str], order: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Adds ``_segment``: the number of the range of its series that a row is in, by rising order; 0 where the order is null."""
    found = cut_points(rows, keys, order, rows_per_segment)
    if found is None:
        return rows.withColumn("_segment", F.lit(0))
    cuts, n = found
    cuts = cuts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    cuts = F.broadcast(cuts) if n <= BROADCAST_CUTS else cuts
    joined = rows.join(cuts, _null_safe(keys, "_of_"), "left")
    before = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col(order)))
    group = F.when(F.col("_heads").isNull(), 0).otherwise(before(F.col("_heads")))
    inside = F.get("_groups", F.col("_group") - 1)
    width = F.size(F.get("_groups", 0))
    segment = F.when(F.col("_group") == 0, 0).otherwise((F.col("_group") - 1) * width + before(inside))
    return joined.withColumn("_group", group).withColumn("_segment", segment.cast("int")).drop("_group", "_groups", "_heads", *[f"_of_{k}" for k in keys])


def _reduced(kind: str, value: Column, order: list[str]) -> Column:
    """Aggregate: what a whole range comes to."""
    if kind == "last":
        return F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_value"))))["_value"]
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _windowed(kind: str, value: Column, window: WindowSpec) -> Column:
    return F.last(value, True).over(window) if kind == "last" else {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)


def running(rows: DataFrame, keys: list[str], order: list[str], scans: dict[str, tuple[Column, str]], reverse: bool = False, rows_per_segment: int = ROWS_PER_SEGMENT, segment: Column | None = None) -> DataFrame:
    """Adds a column for each scan: the sum, max, min or last known of a value from the series' first row to each row.

    ``scans`` maps names to (value, kind). With ``reverse`` it is from each row to the series' last
    one, and ``last`` is the next known. Without keys all rows are one series. Nulls are passed
    over; where nothing is known yet the result is null. Rows with a null order are the first.
    ``segment`` names ranges that are known already, by a column that rises with the order.
    """
    names = list(scans)
    rows = rows.withColumns({f"_in_{n}": v for n, (v, _) in scans.items()})
    one = rows if keys else rows.withColumn("_series", F.lit(0))
    series = keys or ["_series"]
    placed = in_segments(one, series, order[0], rows_per_segment) if segment is None else one.withColumn("_segment", segment)
    first_if_reversed = lambda n: F.min(F.when(F.col(f"_in_{n}").isNotNull(), F.struct(*order, F.col(f"_in_{n}").alias("_value"))))["_value"]
    reduced = lambda n: first_if_reversed(n) if reverse and scans[n][1] == "last" else _reduced(scans[n][1], F.col(f"_in_{n}"), order)
    totals = placed.groupBy(*series, "_segment").agg(*[reduced(n).alias(f"_in_{n}") for n in names])
    by_segment = F.desc("_segment") if reverse else F.asc("_segment")
    earlier = Window.partitionBy(*series).orderBy(by_segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*series, "_segment", *[_windowed(scans[n][1], F.col(f"_in_{n}"), earlier).alias(f"_in_{n}") for n in names])
    known = F.lit(False)
    for n in names:
        known = known | F.col(f"_in_{n}").isNotNull()
    both = placed.withColumn("_carried", F.lit(1)).unionByName(carried.where(known).withColumn("_carried", F.lit(0)), allowMissingColumns=True)
    by_order = [F.desc(c) if reverse else F.asc(c) for c in order]
    window = Window.partitionBy(*series, "_segment").orderBy("_carried", *by_order).rowsBetween(Window.unboundedPreceding, 0)
    made = both.withColumns({n: _windowed(scans[n][1], F.col(f"_in_{n}"), window) for n in names}).where("_carried = 1")
    return made.drop("_carried", "_segment", "_series", *[f"_in_{n}" for n in names])


def rolling(rows: DataFrame, keys: list[str], order: list[str], size: int, measures: dict[str, Callable[[WindowSpec], Column]], rows_per_block: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Adds a column for each measure of the last ``size`` rows of the series, the row itself included.

    Measures are functions of a window; near the first row it has fewer rows. The order must
    tell rows of a series apart.
    """
    series = keys or ["_series"]
    one = rows if keys else rows.withColumn("_series", F.lit(0))
    numbered = running(one, series, order, {"_row": (F.lit(1), "sum")}, rows_per_segment=rows_per_block)
    block = max(rows_per_block, size)
    own = F.floor((F.col("_row") - 1) / block).cast("bigint")
    into = F.when((F.col("_row") - 1) % block >= block - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))
    copied = numbered.withColumn("_own", own).withColumn("_block", F.explode(into))
    window = Window.partitionBy(*series, "_block").orderBy("_row").rowsBetween(1 - size, 0)
    made = copied.withColumns({n: f(window) for n, f in measures.items()}).where("_block = _own")
    return made.drop("_row", "_own", "_block", "_series")


def marked(rows: DataFrame, marks: DataFrame, by: list[str], on: str, mark: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Each row with the last mark of its key at or before it, as a column ``_last``.

    ``marks`` has the key, the column ``on`` and a struct ``mark``. Rows and marks are one series, in
    which marks of the same moment come first.
    """
    both = rows.withColumn("_side", F.lit(1)).unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return running(both, by, [on, "_side", mark], {"_last": (F.col(mark), "last")}, rows_per_segment=rows_per_segment).where("_side = 1")
