"""Window operators against short models in plain Python, over random series."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import asof, checks, panel, peers, stats

LOOSE = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
RETURNS = st.lists(st.one_of(st.none(), st.floats(-0.5, 0.5)), min_size=1, max_size=30)
DAY = dt.date(2020, 1, 1)


def frame(spark, values):
    return spark.createDataFrame([("k", DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "key string, date date, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def near(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(a, b, strict=True))


@LOOSE
@given(values=RETURNS)
def test_fill_and_index(spark, values):
    df = frame(spark, values).withColumn("f", panel.filled_both_ways("x", ["key"], "date")).withColumn("level", panel.index_level("x", ["key"], "date"))
    last, ahead, level, levels = None, [], 100.0, []
    for v in values:
        last = v if v is not None else last
        ahead.append(last)
        level *= 1 + (v or 0.0)
        levels.append(level)
    first = next((v for v in values if v is not None), None)
    assert near(column(df, "f"), [first if v is None else v for v in ahead])
    assert near(column(df, "level"), levels)
    df = df.withColumn("dd", panel.drawdown("level", ["key"], "date"))
    assert near(column(df, "dd"), [x / max(levels[: i + 1]) - 1 for i, x in enumerate(levels)])


@LOOSE
@given(values=st.lists(st.floats(-0.3, 0.3), min_size=1, max_size=25), rows=st.integers(2, 6))
def test_rolling(spark, values, rows):
    df = frame(spark, values).withColumn("r", panel.rolling_log_return("x", ["key"], "date", rows)).withColumn("g", panel.reverse_growth("x", ["key"], "date"))
    want = [math.prod(1 + v for v in values[i - rows + 1 : i + 1]) ** (12 / rows) - 1 if i + 1 >= rows else None for i in range(len(values))]
    assert near(column(df, "r"), want)
    assert near(column(df, "g"), [math.prod(1 + v for v in values[i:]) for i in range(len(values))])


def test_partition_independence(spark, sf_dir):
    from tessera.plans.tables import orders_months

    months = orders_months(spark, sf_dir).persist()
    one, many = (sorted(map(tuple, peers.rolling_deviation(months.repartition(n)).select("fund", "admin", "month", F.round("dev", 9)).collect())) for n in (1, 8))
    assert one == many and one


def test_identical_administrators_have_no_alpha(spark):
    months = [dt.date(2018 + i // 12, i % 12 + 1, 28) for i in range(60)]
    rows = [("A", a, m, 0.01 * math.sin(i), 1.0 + a) for a in range(3) for i, m in enumerate(months)]
    made = peers.alpha(spark.createDataFrame(rows, "fund string, admin int, month date, r double, w double")).collect()
    assert len(made) == 3 and all(abs(r["alpha"]) < 1e-12 for r in made)


def test_single_administrator_has_no_benchmark(spark):
    df = spark.createDataFrame([("A", 1, DAY, 0.1, 2.0), ("A", 2, DAY, None, 5.0)], "fund string, admin int, month date, r double, w double")
    assert {r["admin"]: r["bench"] for r in peers.with_benchmark(df).collect()}[1] is None


def test_zero_weights_fall_back_to_the_plain_mean(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.3, None)], "r double, w double")
    assert math.isclose(df.agg(panel.weighted_mean("r", "w")).first()[0], 0.2)


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("c", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("b", 10, 1.0), ("c", None, 3.0)], "k string, s int, v double")
    made = {(r["k"], r["t"]): (r["s"], r["v"]) for r in asof.asof_backward(left, right, ["k"], "t", "s", "v").collect()}
    assert made == {("a", 5): (5, 50.0), ("a", 1): (None, None), ("b", 9): (None, None), ("c", 1): (None, None)}


def test_steps(spark):
    steps = [(10, 0.1), (20, 0.2)]
    at = spark.createDataFrame([(9,), (10,), (19,), (25,)], "m int")
    expr = [r[0] for r in at.select(asof.step_rate(F.col("m"), steps)).collect()]
    joined = {r["m"]: r["rate"] for r in asof.step_lookup(at, "m", spark.createDataFrame(steps, "start int, rate double")).collect()}
    assert expr == [0.0, 0.1, 0.1, 0.2] == [joined[m] for m in (9, 10, 19, 25)]


def test_rebases(spark):
    day = lambda k: DAY + dt.timedelta(k)
    rows = [("A", "GONE", day(k), 0.001) for k in range(3)] + [("A", "NEW", day(k), 0.84 if k == 3 else 0.001) for k in range(6)] + [("A", "ODD", day(k), 0.5 if k == 1 else 0.0) for k in range(6)]
    df = spark.createDataFrame(rows, "fund string, admin string, date date, ret double")
    events = checks.rebase_events(df)
    found = {r["admin"]: (r["vanished"], r["diagnosis"]) for r in events.collect()}
    assert found == {"NEW": ("GONE", "rebase by merger"), "ODD": ("", checks.REVIEW)}
    adjusted = {(r["admin"], r["date"]): r["ret_adjusted"] for r in checks.neutralised(df, events).collect()}
    assert adjusted["NEW", day(3)] == 0.0 and adjusted["ODD", day(1)] == 0.5


def test_quality_report(spark):
    rows = [("A", DAY, 1.0, 0.2, True), ("A", DAY, None, 0.0, False), ("A", DAY + dt.timedelta(3), 1.0, None, False)]
    df = spark.createDataFrame(rows, "k string, d date, v double, r double, p boolean")
    made = {r["check"]: r["value"] for r in checks.quality_report(df, ["k"], "d", "v", "r", 0.1, "p").collect()}
    assert made == {"repeated keys": 1, "missing days": 2, "null values": 1, "jumps": 1, "provisional rows": 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "fund string, admin int, month date, r double, w double")
    assert peers.band_frequency(peers.rolling_deviation(empty), [0.1]).count() == 0
    assert stats.quintiles(empty, ["fund"], "r").count() == 0
    assert stats.summary(empty, ["fund"], "r").count() == 0


def test_certainty_equivalent_falls_with_risk_aversion(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    ce = [df.agg(stats.certainty_equivalent(F.col("x"), g)).first()[0] for g in (1, 2.0, 5.0)]
    assert math.isclose(ce[0], 2.0) and ce[0] > ce[1] > ce[2] > 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-4.5,), (4.5,), (0.0,), (5.0,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, [], "x", -4.5, 4.5, 90).collect()} == {0: 1, 89: 1, 45: 1}


@LOOSE
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-9, 9)), min_size=1, max_size=90), accuracy=st.sampled_from([8, 20, 10_000]))
def test_bracketed_percentiles_are_exact(spark, values, accuracy):
    df = spark.createDataFrame([("a" if i % 3 else None, v) for i, v in enumerate(values)], "k string, x double")
    levels = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    own = {r["k"]: r for r in stats.exact_percentiles(df, ["k"], "x", levels, accuracy=accuracy).collect()}
    for r in df.where("x is not null").groupBy("k").agg(*stats.percentile_columns("x", levels)).collect():
        assert all(math.isclose(own[r["k"]][n], r[n], rel_tol=1e-12, abs_tol=1e-12) for n in levels)


def test_rows_are_never_the_broadcast_side_of_percentiles(spark, tmp_path):
    """Rows exploded from a small file look small to Spark; broadcasting them would fill the driver."""
    spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("x")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    for made in (stats.exact_percentiles(rows, ["k"], "x", {"p50": 0.5}), stats.exact_percentiles(rows, [], "x", {"p50": 0.5}), stats.quintiles(rows, ["k"], "x", large=True)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan
