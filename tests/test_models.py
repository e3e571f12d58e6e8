"""Fitted models on data of known parameters, and the studies' invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Career, Glidepath
from tessera.functions import numerics
from tessera.operators import macro_regimes, pension, population, regimes, studies, volatility
from tessera.plans import catalogue


@pytest.fixture(scope="module")
def two():
    return regimes.Regimes(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.15, 0.85]]), np.array([[0.01, 0.005], [-0.02, -0.01]]), np.array([np.diag([4e-4, 2e-4]), np.diag([4e-3, 3e-3])]))


@pytest.fixture(scope="module")
def series(two):
    return regimes.simulate(two, 1500, np.random.default_rng(0))


def test_regimes_are_recovered(two, series):
    made = regimes.fit(series, 2, 5, 3)
    assert np.abs(made.moves - two.moves).max() < 0.04 and np.abs(made.means - two.means).max() < 0.006
    assert np.allclose(regimes.posterior(series, made), made.posterior)
    assert np.allclose(regimes.stationary(made.moves) @ made.moves, regimes.stationary(made.moves))


def test_one_regime_where_there_are_none(spark):
    x = np.random.default_rng(1).normal(size=(400, 2))
    table = regimes.select_regimes(spark, x, (1, 2), 4, 2).orderBy("bic").collect()
    assert table[0]["k"] == 1 and regimes.unpacked(table[0]).k == 1


def test_permuted_regimes_are_aligned(two):
    back = regimes.aligned(two.reordered([1, 0]), two)
    assert np.allclose(back.means, two.means) and np.allclose(back.moves, two.moves)


def test_varying_transitions_that_do_not_vary(two, series):
    logb = regimes.log_density(series, two.means, two.covs)
    a = regimes.smooth(logb, two.start, two.moves)
    b = regimes.smooth(logb, two.start, np.broadcast_to(two.moves, (len(series) - 1, 2, 2)))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])
    z = np.random.default_rng(2).normal(size=(50, 3))
    assert np.allclose(macro_regimes.transitions(np.zeros((2, 2)), np.random.default_rng(3).normal(size=(2, 2, 3)), z).sum(-1), 1)


def test_macro_fit_gains_likelihood(series):
    x = series[:300]
    z = np.random.default_rng(4).normal(size=(300, 2))
    constant = regimes.fit(x, 2, 3, 1)
    macro = macro_regimes.fit_macro(x, z, constant)
    assert macro.loglik >= constant.loglik - 1e-3
    assert np.allclose(macro_regimes.marginal_effects(macro).sum(-1), 0)
    assert len(macro_regimes.predictive_scores(x, macro, 250, 300, z)) == 50


def test_garch_is_recovered():
    rng = np.random.default_rng(5)
    r, now = np.empty(6000), 1e-4
    for t in range(6000):
        r[t] = math.sqrt(now) * rng.normal()
        now = 2e-6 + 0.08 * r[t] ** 2 + 0.9 * now
    made = volatility.fit_garch(r)
    assert made["alpha"] == pytest.approx(0.08, abs=0.025) and made["beta"] == pytest.approx(0.9, abs=0.03)


def test_recursion_in_blocks_is_the_recursion():
    u = np.random.default_rng(6).normal(size=333)
    want = [0.5]
    for x in u:
        want.append(x + 0.93 * want[-1])
    assert np.allclose(numerics.linear_recursion(u, 0.93, 0.5), want)


def test_numerics():
    assert numerics.normal_quantile(np.array([0.025, 0.5, 0.975])) == pytest.approx([-1.959964, 0, 1.959964], abs=1e-6)
    assert numerics.beta_cdf(np.array([0.3]), 2.0, 3.0)[0] == pytest.approx(0.3483, abs=1e-9)
    assert numerics.beta_cdf(numerics.beta_quantile(np.array([0.1, 0.9]), 1.158, 0.842), 1.158, 0.842) == pytest.approx([0.1, 0.9], abs=1e-9)
    point, value = numerics.simplex_search(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, (0.3, 0.3))
    assert point == pytest.approx([1, -2], abs=1e-4) and value < 1e-8


def test_bootstrap_does_not_depend_on_partitions(spark, two, series):
    x = series[:200]
    model = regimes.fit(x, 2, 2, 1)
    made = regimes.bootstrap(spark, x, model, ["A", "B"], 3).orderBy("replica", "regime").collect()
    again = regimes.bootstrap(spark, x, model, ["A", "B"], 3).coalesce(1).orderBy("replica", "regime").collect()
    assert made == again and len(made) == 6


def paths(spark, n, months, seed=0):
    cube = np.random.default_rng(seed).normal(0.003, 0.02, (n, months, 5))
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cube)], "path_id long, path array<array<double>>"), cube


def test_population_is_calibrated(spark):
    row = population.people(spark, 8000).groupBy("sex").agg(F.percentile("income", F.lit(0.5)).alias("m"), F.avg("density").alias("d"), F.count("*").alias("n"), F.corr("income", "density").alias("c")).collect()
    by = {r["sex"]: r for r in row}
    assert by["H"]["m"] == pytest.approx(1_076_628 / 40_820.31, rel=0.05) and by["M"]["m"] == pytest.approx(926_383 / 40_820.31, rel=0.05)
    assert by["H"]["d"] == pytest.approx(0.579, abs=0.02) and by["M"]["d"] == pytest.approx(0.496, abs=0.02) and by["H"]["c"] > 0.15
    assert by["M"]["n"] / 8000 == pytest.approx(0.44, abs=0.02)


def test_product_of_matrices_is_accumulation(spark):
    rows, cube = paths(spark, 6, 24)
    weights = [[0.2] * 5] * 24
    person = spark.createDataFrame([(1, [1.0 + t for t in range(24)])], "person long, paid array<double>")
    made = {r["scenario"]: r["b"] for r in population.balances(person, ["person"], {"b": "paid"}, population.growths(rows, {"x": weights}), 24).collect()}
    plain = {r["path_id"]: r["b"] for r in rows.select("path_id", pension.balance(F.col("path"), weights, [1.0 + t for t in range(24)]).alias("b")).collect()}
    assert made == pytest.approx(plain)


def test_blocks_of_people_and_scenarios_are_those_of_one(spark):
    """Blocks of a row or two on either side give the balances of one block; no task gets more than its blocks."""
    rows, _ = paths(spark, 9, 36)
    people = spark.createDataFrame([(p, [float(p + t) for t in range(36)], [1.0] * 36) for p in range(11)], "person long, a array<double>, b array<double>")
    grown = population.growths(rows, {"x": [[0.2] * 5] * 36, "y": [[1.0, 0, 0, 0, 0]] * 36})
    run = lambda cells: sorted(map(tuple, population.balances(people, ["person"], {"own": "a", "more": "b"}, grown, 36, cells).collect()))
    whole, blocks = run(10**6), run(2 * 36)
    assert [r[:3] for r in blocks] == [r[:3] for r in whole] and len(whole) == 11 * 9 * 2
    assert np.allclose([r[3:] for r in blocks], [r[3:] for r in whole])
    assert population.balances(people.limit(0), ["person"], {"own": "a"}, grown, 36).count() == 0


def test_blocks_meet_over_many_partitions(spark):
    """Both sides of a block go to the same partition, also where Spark does not merge partitions afterwards."""
    rows, _ = paths(spark, 9, 36)
    people = spark.range(11).select(F.col("id").alias("person"), F.array_repeat(F.lit(1.0), 36).alias("a"))
    grown = population.growths(rows, {"x": [[0.2] * 5] * 36})
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert population.balances(people, ["person"], {"own": "a"}, grown, 36, 2 * 36).count() == 11 * 9
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_product_does_not_pass_through_the_driver(spark, monkeypatch):
    """Far more growth cells than a block: nothing is collected or broadcast, and a task holds one block of each side."""
    rows, _ = paths(spark, 60, 120)
    cohort = population.people(spark, 40, sex="H")
    monkeypatch.setattr(type(rows), "collect", None)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    grown = population.career_growths(rows, "H", Career(start_age=55))
    made = population.balances(cohort.withColumn("paid", F.array_repeat(F.lit(1.0), 120)), ["person"], {"own": "paid"}, grown, 120, 10 * 120)
    assert made.count() == 40 * 60 * 2


def test_shared_growths_are_those_of_each_call(spark):
    rows, _ = paths(spark, 4, 60)
    cohort, career = population.people(spark, 6, sex="M"), Career(start_age=55)
    run = lambda **k: {(r["person"], r["scenario"]): r["total"] for r in population.cohort_pensions(cohort, rows, "M", 190.0, career, retire_at=60, **k).where(F.col("strategy") == pension.DEFAULT).collect()}
    shared = population.career_growths(rows, "M", career, 60, (pension.DEFAULT,))
    own = run()
    assert run(grown=shared) == pytest.approx(own) and run(grown=shared) == pytest.approx(own) and len(own) == 6 * 4


def test_gap_is_that_of_one_case_at_a_time(spark):
    """The lattice's medians are those of each coalition's cohort by itself, and the parts add up to the gap."""
    from dataclasses import replace

    from tessera.config import Population

    rows, _ = paths(spark, 5, 120)
    career, c = Career(start_age=55), Population()
    price = lambda sex, age: {"H": 150.0, "M": 190.0}[sex] + 5 * (65 - age)
    every = population.gap_rows(spark, rows, price, 15, career, c).toPandas()
    medians = every.groupby("mask").total.median()
    assert sorted(medians.index) == list(range(-1, 16))
    for mask in (0, 6, 9, 15):
        has = [bool(mask >> k & 1) for k in range(4)]
        mixed = replace(c, income={**c.income, "M": c.income["MH"[has[1]]]}, density={**c.density, "M": c.density["MH"[has[0]]]})
        age = 65 if has[2] else 60
        one = population.cohort_pensions(population.people(spark, 15, mixed, "M"), rows, "M", price("MH"[has[3]], age), career, c=mixed, retire_at=age)
        assert one.where(F.col("strategy") == pension.DEFAULT).toPandas().total.median() == pytest.approx(medians[mask])
    parts = population.gender_gap(spark, rows, price, 15, career, c).collect()
    assert sum(r["share"] for r in parts) == pytest.approx(medians[-1] - medians[0]) and len(parts) == 5


def test_parts_add_up_to_the_whole(spark):
    values = {m: float(np.random.default_rng(m).normal()) for m in range(16)}
    made = population.shapley(spark.createDataFrame(list(values.items()), "mask int, value double"), ["a", "b", "c", "d"]).collect()
    assert sum(r["share"] for r in made) == pytest.approx(values[15] - values[0])


def test_break_even_hits_its_goal(spark):
    rows, _ = paths(spark, 20, 120)
    career = Career(start_age=55)
    found = {r["surcharge"]: r["break_even"] for r in studies.break_even(rows, [0.0, 0.005, 9.0], career).collect()}
    x = found[0.005]
    assert found[0.0] < 1e-6 and found[9.0] == pytest.approx(0.03, abs=1e-6)
    months = pension.ages(career, "H")
    paid = pension.contributions(career, pension.salaries(career, months))
    weights = pension.strategies(months, "H")[pension.DEFAULT]
    lifted = rows.select(F.transform("path", lambda m: F.transform(m, lambda r: (1 + r) * (1 + x) ** (1 / 12) - 1)).alias("path"))
    median = lambda df: df.agg(F.percentile(pension.balance(F.col("path"), weights, paid), F.lit(0.5))).first()[0]
    assert median(lifted) / median(rows) == pytest.approx(1.05, abs=1e-5)


def test_grid_is_the_fold(spark):
    rows, _ = paths(spark, 5, 60)
    months = [60 + t // 12 for t in range(60)]
    mixes = [[pension.replicated(Glidepath(), pension.family_share(a, 0.8, 60, 0.3, 65)) for a in months], [pension.by_law(a, "H") for a in months]]
    made = {(r["path_id"], r["point"]): r["balance"] for r in studies.grid_pensions(rows, mixes, [1.0] * 60).collect()}
    for k, w in enumerate(mixes):
        for r in rows.select("path_id", pension.balance(F.col("path"), w, [1.0] * 60).alias("b")).collect():
            assert made[r["path_id"], k] == pytest.approx(r["b"])
    assert len(studies.grid_points()) == 270


def test_search_prefers_no_risk_when_risk_does_not_pay(spark):
    cube = np.random.default_rng(7).normal(0.0, 0.08, (40, 60, 5)) * np.array([1.0, 0.7, 0.4, 0.2, 0.01])
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cube)], "path_id long, path array<array<double>>")
    grid = {"g0": (0.3, 0.9), "a1": (62,), "g1": (0.1, 0.9)}
    table, compared = studies.glidepath_search(rows, rows, "H", 150.0, 5.0, Career(start_age=60), grid=grid, with_reform=False)
    best = compared.first()
    assert (best["g0"], best["g1"]) == (0.3, 0.1) and table.count() == 3


@pytest.mark.parametrize("name", ["cohort_table", "gap_lattice"])
def test_no_join_broadcasts_or_repeats_the_customers(spark, sf_dir, name):
    """Customers times scenarios or coalitions only meet rows of their groups, which are the broadcast side."""
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "HashJoin [person" not in plan and "MergeJoin [person" not in plan
