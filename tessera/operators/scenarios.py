"""Paths of returns: regime-switching bootstrap, recentring, block bootstrap, employment spells.

Random numbers come from the names of path, month and stream, so paths don't depend on
partitions, and cases that share a stream share their draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import FUNDS
from tessera.functions.folds import let, literal
from tessera.functions.random import uniform


def pooled_history(history: DataFrame, labels: int) -> DataFrame:
    """One row: rows (returns by time) and pools (time indices by label) of (i, label, ret).

    A history is a series of months and fits in a row. A label without months gets the pool
    of the nearest label that has some, the lower one first.
    """
    one = history.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "ret"))), lambda x: x["ret"]).alias("rows"),
        *[F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("i").cast("int")))).alias(f"_p{k}") for k in range(labels)],
    )
    filled = []
    for k in range(labels):
        near = sorted((j for j in range(labels) if j != k), key=lambda j: (abs(j - k), j))
        out = F.col(f"_p{k}")
        for j in [*near]:
            out = F.when(F.size(out) > 0, out).otherwise(F.col(f"_p{j}"))
        filled.append(out)
    return one.select("rows", F.array(*filled).alias("pools"))


def regime_paths(spark: SparkSession, pooled: DataFrame, n: int, months: int, moves: list[list[float]], start: int, stream: str = "path", first: int = 0) -> DataFrame:
    """(path_id, states, picks, rows): regimes and drawn history rows of each month.

    A month draws a row of the current regime's pool, then the regime moves by inverse
    distribution function, the last regime taking what is left over.
    """
    sums = literal([[sum(row[: k + 1]) for k in range(len(row))] for row in moves])
    top = len(moves) - 1
    paths = spark.range(first, first + n).withColumnRenamed("id", "path_id").crossJoin(F.broadcast(pooled))

    def month(s, t):
        pool = F.get(F.col("pools"), s["now"])
        pick = F.get(pool, F.floor(uniform(f"{stream}-row", F.col("path_id"), t) * F.size(pool)).cast("int"))
        u = uniform(f"{stream}-move", F.col("path_id"), t)
        after = let(u, lambda v: F.least(F.aggregate(F.get(sums, s["now"]), F.lit(0), lambda c, x: c + (v > x).cast("int")), F.lit(top)))
        return F.struct(after.alias("now"), F.concat(s["states"], F.array(s["now"])).alias("states"), F.concat(s["picks"], F.array(pick)).alias("picks"))

    empty = F.array().cast("array<int>")
    zero = F.struct(F.lit(start).alias("now"), empty.alias("states"), empty.alias("picks"))
    walked = paths.withColumn("_w", F.aggregate(F.sequence(F.lit(0), F.lit(months - 1)), zero, month))
    return walked.select("path_id", F.col("_w.states").alias("states"), F.col("_w.picks").alias("picks"), "rows")


def returns_of(paths: DataFrame, factors: Column | None = None, haircut: float = 0.0) -> DataFrame:
    """(path_id, path): returns by month and fund; (1 + r) times a factor by fund, less a yearly haircut."""
    less = (1 - haircut) ** (1 / 12)
    rows = F.transform("picks", lambda i: F.get(F.col("rows"), i))
    if factors is not None:
        rows = F.transform(rows, lambda r: F.zip_with(r, factors, lambda x, f: (1 + x) * f - 1))
    if haircut:
        rows = F.transform(rows, lambda r: F.transform(r, lambda x: (1 + x) * less - 1))
    return paths.select("path_id", rows.alias("path"))


def recentred(paths: DataFrame, targets: list[float]) -> DataFrame:
    """Paths whose geometric mean by fund, over all paths and months, is the yearly target.

    The mean needs all paths before the first is rescaled: one aggregation of sums, then one row that is broadcast.
    """
    logs = lambda k: F.aggregate("picks", F.lit(0.0), lambda s, i: s + F.ln(1 + F.get(F.get(F.col("rows"), i), k)))
    sums = [F.sum(logs(k)).alias(f"_s{k}") for k in range(len(targets))]
    means = paths.agg(*sums, F.sum(F.size("picks")).alias("_n"))
    factors = F.array(*[F.exp(F.lit(1 / 12) * F.ln(F.lit(1 + g)) - F.col(f"_s{k}") / F.col("_n")) for k, g in enumerate(targets)])
    return returns_of(paths.crossJoin(F.broadcast(means.select(factors.alias("_f")))), F.col("_f"))


def block_indices(spark: SparkSession, n: int, length: int, mean_block: float, stream: str = "block") -> DataFrame:
    """(path_id, t, i): stationary circular block bootstrap of Politis and Romano, blocks of geometric length."""
    steps = F.sequence(F.lit(1), F.lit(length - 1))
    fresh = lambda p, t: F.floor(uniform(f"{stream}-start", p, t) * length).cast("int")

    def month(s, t):
        again = uniform(f"{stream}-new", F.col("path_id"), t) < 1 / mean_block
        return F.concat(s, F.array(F.when(again, fresh(F.col("path_id"), t)).otherwise((F.element_at(s, -1) + 1) % length)))

    ids = spark.range(n).withColumnRenamed("id", "path_id")
    walked = ids.withColumn("_i", F.aggregate(steps, F.array(fresh(F.col("path_id"), F.lit(0))), month))
    return walked.select("path_id", F.posexplode("_i").alias("t", "i"))


def formal_months(density: Column, person: Column, months: int, spell: float, stream: str = "spell") -> Column:
    """Array of 0/1: months in formal work, as a two-state chain with mean spell and that share of months."""
    leave = 1 / spell
    enter = F.least(F.lit(1.0), density / (1 - density) * leave)
    first = (uniform(f"{stream}-first", person) < density).cast("int")

    def month(s, t):
        u = uniform(stream, person, t)
        return F.concat(s, F.array(F.when(F.element_at(s, -1) == 1, (u >= leave).cast("int")).otherwise((u < enter).cast("int"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(months - 2)), F.array(first), month)


def fund_arrays(wide: DataFrame, order: str, label: Column) -> DataFrame:
    """(i, label, ret) of a monthly table with one column per fund; i counts months from 0."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy(order)) - 1
    return wide.select(at.alias("i"), label.cast("int").alias("label"), F.array(*[F.col(f) for f in FUNDS]).alias("ret"))
