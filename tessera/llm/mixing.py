"""Operator 10: mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``max_repeats`` times
its size; what is cut off is shared again by weight until no target is above its cap.
The words of a source are taken target / size of the source times: the whole part of
that is certain for each document, and the fraction is drawn. Within a source and a size
class (half an octave of words) a sample of fixed size is drawn with inclusion odds in
proportion to the document's words, so that of one class longer documents are drawn more
often: documents are ranked by the odds of a uniform number of their own over their
inclusion odds, and the lowest ranks are taken. What
a class can't take in whole documents is carried on to the next smaller class, so a
source ends within about one small document of its target.

Shape at scale: texts are read once and leave the scan as (id, source, size). The
ranks are not sorted per source, as one source may hold a third of all rows: counts over
a grid of ranks find the cell where a class reaches its sample size, and only that cell is
looked at closer, on a grid of its own, and then a third time. What is ordered at last are
the different ranks of one cell in 6.9 x 10^10, each with its count; rows of one rank, which
have equal ids and sizes, are told apart by a hash of the row alone, on such grids again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, durable, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of a grid over [0, 1), and how often the one cell that matters is divided again.
CELLS, DEPTH = 4096, 3


def source_targets(sizes: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """(source, source_size) -> also target. Weights repeat over the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    everywhere = Window.partitionBy()
    # Sources in the order in which rising levels reach their caps; those before are full.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("words", F.sum("source_size").over(everywhere))
        .withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * F.col("left"))
    )
    ranked = (
        ranked.withColumn("left", F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everywhere), F.lit(0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere), F.lit(0)))
    )
    share = F.col("weight") * (F.col("left").cast("double") / F.col("open"))
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _class_of(size):
    bits = F.length(F.bin(size))
    upper = size.cast("double") * size >= F.pow(F.lit(2.0), 2 * bits - 1)
    return F.when(size == 0, 0).otherwise(2 * bits + upper.cast("int"))


def _draws(strata: DataFrame) -> DataFrame:
    """Sample size of each class of a source: (source, class) -> n_draw, from the largest class down."""
    listed = strata.where("class > 0").groupBy("source").agg(
        F.first("fraction").alias("fraction"),
        F.reverse(F.array_sort(F.collect_list(F.struct("class", "n_docs", "words", "squares")))).alias("classes"),
    )
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:int,n_draw:bigint>>").alias("done"))

    def take(state, c):
        want = F.col("fraction") * c["words"] + state["carry"]
        mean = c["squares"].cast("double") / c["words"]
        n = F.greatest(F.lit(0), F.least(c["n_docs"], F.floor(want / mean + 0.5))).cast("bigint")
        return F.struct((want - n * mean).alias("carry"), F.concat(state["done"], F.array(F.struct(c["class"].alias("class"), n.alias("n_draw")))).alias("done"))

    drawn = listed.select("source", F.inline(F.aggregate("classes", start, take, lambda s: s["done"])))
    return drawn


def mix(
    docs: DataFrame,
    weights: list[int],
    max_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "",
) -> DataFrame:
    """Per document: id, size, source_size, target, copies and taken = copies x size.

    A null source is a source of its own, after all others. Null and blank texts have
    size 0 and are taken 0 times. Rows with equal ids are drawn alike, each on its own.
    An empty table gives no rows. Reruns draw the same: the uniform number of a row
    comes from the md5 of seed and id. Other columns are ignored.
    """
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("bigint").alias("size"),
            uniform.alias("u"),
        ).withColumn("class", _class_of(F.col("size")).cast("int"))
    )
    squares = F.sum(F.col("size") * F.col("size"))
    strata = durable(rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("words"), squares.alias("squares")))
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    copies = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(copies)).withColumn("fraction", copies - F.floor(copies))
    plan = _null_safe(strata, targets, ["source"])
    plan = durable(_null_safe(plan, _draws(plan), ["source", "class"], "left").withColumn("n_draw", F.coalesce("n_draw", F.lit(0))))
    n_plan = plan.count()
    ranked = _null_safe(rows, broadcast_if_small(plan, n_plan), ["source", "class"])
    inclusion = F.least(F.lit(1.0), F.col("n_draw").cast("double") * F.col("size") / F.col("words"))
    odds = (F.col("u") / (1.0 - F.col("u"))) * F.try_divide(1.0 - inclusion, inclusion)
    # A class that is drawn whole needs no ranks, which would all be 0.
    some = (F.col("n_draw") > 0) & (F.col("n_draw") < F.col("n_docs"))
    ranked = ranked.withColumn("rank", F.when(some, odds / (1.0 + odds)))
    stratum = ["source", "class"]
    asked = plan.where(some).select(*stratum, F.col("n_draw").alias("need"))
    lower = _lowest(ranked.where("rank is not null"), asked, stratum, "rank", n_plan)
    sure = ranked.where("rank is null").withColumn("drawn", (F.col("n_draw") > 0).cast("int"))
    drawn = sure.unionByName(lower.select(*sure.columns))
    done = drawn.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("drawn")).otherwise(0))
    return done.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )


def _lowest(rows: DataFrame, asked: DataFrame, stratum: list[str], value: str, n_strata: int) -> DataFrame:
    """``rows`` with drawn = 1 for the ``need`` rows of each stratum that are lowest by (value in [0, 1), id), else 0.

    Of rows that are equal in both those are drawn that are lowest by a hash of the row. No
    task orders the rows of a stratum; no order is needed but of what shares a cell of the last grid.
    """
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    known = rows.withColumn("_at", F.col(value)).withColumn("_cell", F.lit(0).cast("bigint"))
    cuts, open_ = None, asked
    for depth in range(DEPTH):
        # The cell where the counts of this grid, within the cell that was open, reach what is needed.
        inside = known if cuts is None else _null_safe(known, broadcast_if_small(cuts, n_strata), stratum).where(F.col("_cell") == F.col("cut")).drop("cut")
        known = inside.withColumn("_cell", F.col("_cell") * CELLS + F.floor(F.col("_at") * CELLS)).withColumn("_at", F.col("_at") * CELLS - F.floor(F.col("_at") * CELLS))
        grid = known.groupBy(*stratum, "_cell").agg(F.count(F.lit(1)).alias("in_cell"))
        upto = Window.partitionBy(*stratum).orderBy("_cell")
        counted = _null_safe(grid.withColumn("upto", F.sum("in_cell").over(upto)), open_, stratum)
        found = durable(counted.where("upto >= need and upto - in_cell < need").select(*stratum, F.col("_cell").alias("cut"), (F.col("need") - F.col("upto") + F.col("in_cell")).alias("need")))
        cuts, open_ = found.select(*stratum, "cut"), found.drop("cut")
    # Of the last cell: different (value, id) with their counts, in order.
    last = _null_safe(known, broadcast_if_small(cuts, n_strata), stratum).where(F.col("_cell") == F.col("cut"))
    groups = last.groupBy(*stratum, value, "id").agg(F.count(F.lit(1)).alias("in_group"))
    upto = Window.partitionBy(*stratum).orderBy(value, "id")
    groups = durable(_null_safe(groups.withColumn("upto", F.sum("in_group").over(upto)), open_, stratum))
    edge = groups.where("upto >= need and upto - in_group < need").select(*stratum, F.col(value).alias("_edge"), F.col("id").alias("_edge_id"), (F.col("need") - F.col("upto") + F.col("in_group")).alias("_left"), "in_group")
    edge = durable(edge)
    split = _null_safe(rows, broadcast_if_small(edge, n_strata), stratum, "left")
    same = (F.col(value) == F.col("_edge")) & F.col("id").eqNullSafe(F.col("_edge_id"))
    below = (F.col(value) < F.col("_edge")) | ((F.col(value) == F.col("_edge")) & F.coalesce(F.col("id") < F.col("_edge_id"), F.col("id").isNull() & F.col("_edge_id").isNotNull()))
    split = split.withColumn("drawn", F.when(F.col("_edge").isNull(), 0).when(same, F.when(F.col("_left") == F.col("in_group"), 1)).otherwise(below.cast("int")))
    plain = split.where("drawn is not null").drop("_edge", "_edge_id", "_left", "in_group", "_row")
    tied = edge.where("_left < in_group")
    if tied.isEmpty():
        return plain
    # Rows of one id and rank on both sides of the edge: the same again, by a hash of the row instead of the id.
    some = split.where("drawn is null").drop("drawn", "_edge", "_edge_id", "_left", "in_group").withColumn("_own_id", F.col("id")).withColumn("id", F.col("_row"))
    some = some.withColumn("_mark", F.pmod(F.xxhash64("_row"), F.lit(1 << 50)) / F.lit(float(1 << 50))).drop("_row")
    more = _lowest(some, tied.select(*stratum, F.col("_left").alias("need")), stratum, "_mark", n_strata)
    return plain.unionByName(more.withColumn("id", F.col("_own_id")).select(*plain.columns))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the left keys stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns if c in keys or c not in left.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
