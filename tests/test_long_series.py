"""Scans over ranges of long series against one window, one pass or one task over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import asof, regime_scan, regimes, segments, stats
from tessera.plans import long_series
from tests.harness import assert_same, connection


@pytest.fixture(scope="module")
def hot(spark):
    """One key with nine rows in ten, a null key, nulls in the value and repeated times."""
    rng = np.random.default_rng(2)
    rows = [(None if k % 37 == 5 else 0 if k % 10 else k % 4, int(rng.integers(0, 600)), k, None if k % 11 == 3 else float(rng.integers(1, 100))) for k in range(2000)]
    return spark.createDataFrame(rows, "k int, t int, id int, v double").repartition(7).cache()


@pytest.mark.parametrize("size", [25, 300, 10**6])
def test_ranges_are_bounded(hot, size):
    placed = segments.in_segments(hot, ["k"], "t", size)
    rows = placed.groupBy("k", "_segment").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("k", "_segment").collect()
    assert max(r["n"] for r in rows) <= max(2 * size, 60) and sum(r["n"] for r in rows) == 2000
    for a, b in zip(rows, rows[1:], strict=False):
        assert a["k"] != b["k"] or a["high"] < b["low"]


@pytest.mark.parametrize("size", [25, 10**6])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_one_window(hot, size, reverse, keys):
    scans = {"s": (F.col("v"), "sum"), "hi": (F.col("v"), "max"), "lo": (F.col("v"), "min"), "known": (F.when(F.col("v") > 50, F.col("v")), "last")}
    made = segments.running(hot, keys, ["t", "id"], scans, reverse, size).toPandas()
    order = [F.desc("t"), F.desc("id")] if reverse else ["t", "id"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumns({"s": F.sum("v").over(w), "hi": F.max("v").over(w), "lo": F.min("v").over(w), "known": F.last(F.when(F.col("v") > 50, F.col("v")), True).over(w)}).toPandas()
    assert sorted(made.columns) == sorted(plain.columns)
    pd.testing.assert_frame_equal(made.sort_values("id", ignore_index=True)[plain.columns], plain.sort_values("id", ignore_index=True))


@pytest.mark.parametrize("size", [40, 10**6])
def test_rolling_equals_one_window(hot, size):
    measures = {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}
    made = segments.rolling(hot, ["k"], ["t", "id"], 36, measures, size).toPandas()
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-35, 0)
    plain = hot.withColumns({n: f(w) for n, f in measures.items()}).toPandas()
    pd.testing.assert_frame_equal(made.sort_values("id", ignore_index=True)[plain.columns], plain.sort_values("id", ignore_index=True))


def test_asof_over_ranges(spark, hot):
    marks = hot.where("id % 5 = 0 and v is not null").select("k", F.col("t").alias("at"), F.col("v").alias("x"))
    rows = hot.where("id % 5 <> 0").drop("v")
    small, whole = (asof.asof_backward(rows, marks, ["k"], "t", "at", "x", n).toPandas().sort_values("id", ignore_index=True) for n in (20, 10**6))
    pd.testing.assert_frame_equal(small, whole)
    known = marks.toPandas()
    for r in whole.sample(60, random_state=1).itertuples():
        own = known[(known["k"].isna() if pd.isna(r.k) else known["k"] == r.k) & (known["at"] <= r.t)].sort_values(["at", "x"])
        assert (pd.isna(r.x) and not len(own)) or (r.at, r.x) == tuple(own[["at", "x"]].iloc[-1])
    assert asof.asof_backward(rows, marks.limit(0), ["k"], "t", "at", "x", 20).where("x is not null").count() == 0
    assert asof.asof_backward(rows.limit(0), marks, ["k"], "t", "at", "x", 20).count() == 0


def test_scan_equals_one_pass_with_moves_that_change(spark):
    rng = np.random.default_rng(3)
    n, k = 700, 3
    dense, moves = rng.uniform(0.05, 1, (n, k)), rng.dirichlet(np.ones(k), (n, k))
    start = [0.5, 0.3, 0.2]
    frame = spark.createDataFrame([(0 if t < 650 else 1, t, dense[t].tolist(), moves[t].tolist()) for t in range(n)], "s int, t int, b array<double>, m array<array<double>>").repartition(5)
    made = regime_scan.smoothed(frame, ["s"], ["t"], F.col("b"), start, F.col("m"), 40).orderBy("t").toPandas()
    for part in (slice(0, 650), slice(650, n)):
        loglik, posterior, _ = regimes.smooth(np.log(dense[part]), np.array(start), moves[part][1:])
        assert np.allclose(np.stack(made["posterior"].iloc[part]), posterior, atol=1e-9)
        assert abs(made["loglik"].iloc[part].iloc[-1] - loglik) < 1e-6


def test_fit_finds_the_regimes_of_a_long_series(spark):
    """Thousands of rows in many ranges; the likelihood never falls, and one range gives the same fit."""
    rng = np.random.default_rng(5)
    state, x = 0, []
    for _ in range(3000):
        state = state if rng.random() < (0.97, 0.9)[state] else 1 - state
        x.append((0.01, -0.03)[state] + rng.normal() * (0.01, 0.04)[state])
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "s string, t int, r double").repartition(4)
    begin = spark.createDataFrame([(f, "a", [0.5, 0.5], [[p, 1 - p], [1 - p, p]], [0.0, -0.01], [1e-4, 9e-4]) for f, p in ((1, 0.9), (2, 0.7))], "fit int, s string, start array<double>, moves array<array<double>>, mean array<double>, variance array<double>")
    logliks, now = [], begin
    for _ in range(4):
        now = regime_scan.fit_regimes(rows, now, ["s"], ["t"], "r", 2, 250)
        logliks.append([r["loglik"] for r in now.orderBy("fit").collect()])
    assert (np.diff(np.array(logliks), axis=0) > -1e-6).all()
    found = now.orderBy("fit").collect()[0]
    assert np.allclose(found["mean"], [0.01, -0.03], atol=0.005) and np.allclose(np.sqrt(found["variance"]), [0.01, 0.04], rtol=0.15)
    assert abs(found["moves"][0][0] - 0.97) < 0.03 and abs(found["moves"][1][1] - 0.9) < 0.06
    ranges, whole = (regime_scan.fit_regimes(rows, begin, ["s"], ["t"], "r", 1, size).orderBy("fit").toPandas() for size in (100, 10**6))
    for c in ("start", "mean", "variance"):
        assert np.allclose(np.stack(ranges[c]), np.stack(whole[c]), rtol=1e-8)


def test_garch_by_grids_finds_what_a_simplex_finds(spark):
    """A long series in ranges, beside one that is too short and one without variance; the likelihood is that of the search in one task, and parameters are near the true ones."""
    from tessera.operators import volatility, volatility_scan

    rng, frames = np.random.default_rng(8), []
    for name, n in (("long", 2500), ("b", 19), ("flat", 50)):
        now, r = 1e-4, []
        for _ in range(n):
            r.append(float(np.sqrt(now) * rng.normal()))
            now = 2e-6 + 0.08 * r[-1] ** 2 + 0.90 * now
        frames += [(name, t, 0.5 if name == "flat" else x) for t, x in enumerate(r)]
    rows = spark.createDataFrame([*frames, ("long", 9999, None)], "s string, t int, r double").repartition(5)
    found = {r["s"]: r for r in volatility_scan.fit_garch(rows, ["s"], ["t"], "r", rounds=9, rows_per_segment=700).collect()}
    assert set(found) == {"long"}
    for name in found:
        own = volatility.fit_garch(np.array([x for s, _, x in frames if s == name]))
        assert found[name]["loglik"] > own["loglik"] - 0.01
        assert abs(found[name]["alpha"] - own["alpha"]) < 0.01 and abs(found[name]["beta"] - own["beta"]) < 0.02
    assert abs(found["long"]["alpha"] - 0.08) < 0.04 and abs(found["long"]["beta"] - 0.90) < 0.05


def test_rolling_halo_where_values_do_not_vary(spark, tmp_path):
    """Windows of equal values have no correlation, as in the SQL: NaN, not an error and not a null."""
    rows = [(k, "a" if k % 2 else "b", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=k // 160), 5.0 if k < 300 else float(k % 13)) for k in range(700)]
    pd.DataFrame(rows, columns=["event_id", "event_type", "ts", "value"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    frame = long_series.rolling_halo(spark, str(tmp_path))
    con = connection(str(tmp_path))
    assert_same(frame, long_series.SQL["rolling_halo"], con)
    counts = frame.agg(F.count_if(F.isnan("c")), F.count_if(F.col("c").isNull())).first()
    sql = con.execute(f"SELECT count(*) FILTER (WHERE isnan(c)), count(*) FILTER (WHERE c IS NULL) FROM ({long_series.SQL['rolling_halo']})").fetchone()
    assert tuple(counts) == sql and sql[0] > 100


def test_rolling_correlation_takes_whole_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 9.0), (3, 4.0, 3.0), (4, 2.0, None), (5, 3.0, 7.0)], "t int, x double, y double")
    w = Window.orderBy("t").rowsBetween(-3, 0)
    made = df.select("t", stats.rolling_correlation(F.col("x"), F.col("y"), w).alias("c")).orderBy("t").collect()
    assert np.isnan([made[0]["c"], made[1]["c"]]).all() and [round(r["c"], 12) for r in made[2:]] == [1.0, 1.0, -1.0]
