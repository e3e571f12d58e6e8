"""Careers, weights, accumulation, switching, layers, annuities."""

import math
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import BANDS, Career, Glidepath, Reactive, Reform, month_no
from tessera.operators import actuarial, pension, scenarios

LOOSE = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PATHS = st.lists(st.lists(st.lists(st.floats(-0.15, 0.15), min_size=5, max_size=5), min_size=24, max_size=24), min_size=1, max_size=3)


def paths(spark, cubes):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cubes)], "path_id long, path array<array<double>>")


def balance_model(path, weights, paid):
    total = 0.0
    for r, w, a in zip(path, weights, paid, strict=True):
        total = (total + a) * (1 + sum(x * y for x, y in zip(r, w, strict=True)))
    return total


def reactive_model(path, weights, paid, rule):
    """A diary of one member, kept as a list of planned moves by month."""
    in_e, since, total, moves, planned, held, fund_a = False, 0, 0.0, 0, None, [], []
    for t, (r, w, a) in enumerate(zip(path, weights, paid, strict=True)):
        if planned and t >= planned[0]:
            in_e, since, moves, planned = planned[1], 0 if planned[1] else since, moves + 1, None
        x = r[4] if in_e else sum(p * q for p, q in zip(r, w, strict=True))
        total = (total + a) * (1 + x)
        held.append(x)
        fund_a.append(r[0])
        since += in_e
        if t >= 2 and not planned:
            three = lambda v: math.prod(1 + y for y in v[-3:]) - 1
            if not in_e and three(held) < rule.fall:
                planned = (t + 1 + rule.lag, True)
            elif in_e and since >= rule.least_months and three(fund_a) > rule.recovery:
                planned = (t + 1 + rule.lag, False)
    return total, moves


@LOOSE
@given(cubes=PATHS)
def test_folds_match_plain_models(spark, cubes):
    weights, paid = [pension.by_law(30 + t, "H") for t in range(24)], [1.0 + t / 10 for t in range(24)]
    rule = Reactive(fall=-0.04, least_months=3, recovery=0.02)
    made = paths(spark, cubes).select("path_id", pension.balance(F.col("path"), weights, paid).alias("b"), pension.reactive_state(F.col("path"), weights, paid, rule).alias("s")).collect()
    for r in made:
        assert math.isclose(r["b"], balance_model(cubes[r["path_id"]], weights, paid), rel_tol=1e-9)
        total, moves = reactive_model(cubes[r["path_id"]], weights, paid, rule)
        assert math.isclose(r["s"]["balance"], total, rel_tol=1e-9) and r["s"]["switches"] == moves


def test_a_signal_moves_the_money_two_months_later(spark):
    path = [[0.0, -0.03, 0.0, 0.0, 0.0]] * 3 + [[0.0, 0.01, 0.0, 0.0, 0.5]] * 3
    weights = [[0.0, 1.0, 0.0, 0.0, 0.0]] * 6
    s = paths(spark, [path]).select(pension.reactive_state(F.col("path"), weights, [1.0] + [0.0] * 5, Reactive()).alias("s")).first()["s"]
    assert s["switches"] == 1 and math.isclose(s["balance"], 0.97**3 * 1.01 * 1.5 * 1.5)


def test_a_rule_that_never_fires_is_the_default(spark):
    cube = [[[0.01, -0.02, 0.0, 0.01, 0.0]] * 24]
    weights, paid = [pension.by_law(40, "H")] * 24, [1.0] * 24
    row = paths(spark, cube).select(pension.balance(F.col("path"), weights, paid).alias("b"), pension.reactive_state(F.col("path"), weights, paid, Reactive(fall=-9.0)).alias("s")).first()
    assert math.isclose(row["b"], row["s"]["balance"]) and row["s"]["switches"] == 0


def test_without_returns_the_balance_is_what_was_paid(spark):
    cube = [[[0.0] * 5] * 12]
    assert paths(spark, cube).select(pension.balance(F.col("path"), [[0.2] * 5] * 12, [2.0] * 12)).first()[0] == pytest.approx(24.0)


def test_weights():
    path = Glidepath()
    assert pension.growth_share(path, 18) == pension.growth_share(path, 38) == pytest.approx(0.95)
    assert pension.growth_share(path, 63) == pytest.approx(0.29)
    for g in (0.05, 0.082, 0.213, 0.3, 0.5, 0.612, 0.824, 0.9, 0.95):
        w = pension.replicated(path, g)
        assert sum(w) == pytest.approx(1) and sum(x != 0 for x in w) <= 2
        assert sum(x * h for x, h in zip(w, path.fund_growth, strict=True)) == pytest.approx(max(g, 0.082))
    assert pension.replicated(path, 0.95)[0] == pytest.approx(1.17, abs=0.005)
    assert min(pension.replicated(replace(path, extrapolate=False), 0.95)) >= 0
    assert [pension.by_law(a, s).index(1.0) for a, s in ((35, "H"), (36, "H"), (55, "H"), (56, "H"), (51, "M"))] == [1, 2, 2, 3, 3]


def test_career_anchors():
    months = pension.ages(Career(), "H")
    paid = pension.salaries(Career(), months)
    assert len(months) == 480 and paid[-1] == pytest.approx(36.27363, abs=1e-5)
    assert sum(s * 0.6 for s in paid) == pytest.approx(9328.8967, abs=1e-3)


def test_calendar_and_benefit(spark):
    steps = Reform().employer
    assert [pension.rate_at(steps, month_no(y, m)) for y, m in ((2025, 7), (2025, 8), (2029, 8), (2033, 8), (2044, 1), (2054, 9), (2070, 1))] == pytest.approx([0, 0.001, 0.017, 0.045, 0.045, 0.06, 0.06])
    assert pension.rate_at(Reform().bond, month_no(2060, 1)) == pytest.approx(0)
    low, high, full = 789_139 / 39_703.5, 1_252_602 / 39_703.5, 250_275 / 39_703.5
    got = [r[0] for r in spark.createDataFrame([(0.0,), (low,), ((low + high) / 2,), (high,), (99.0,)], "x double").select(pension.flat_benefit(F.col("x"))).collect()]
    assert got == pytest.approx([full, full, full / 2, 0, 0]) and full == pytest.approx(6.3036, abs=1e-4)


def test_layers_add_up(spark):
    career = Career(start_age=60, growth_until=60)
    cube = [[[0.002 * k] * 5 for k in range(60)], [[0.0] * 5] * 60]
    rows = pension.layered(paths(spark, cube), "H", 150.0, career).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["total"] == pytest.approx(r["own"] + r["employer"] + r["bond"] + r["flat"])
    table = pension.layer_table(pension.layered(paths(spark, cube), "H", 150.0, career), 0.4)
    assert table.count() == 8


def test_annuities(spark):
    table = actuarial.gompertz_table(spark)
    cases = spark.createDataFrame([("H", 65, 2026), ("M", 65, 2026), ("H", 65, 2060), ("H", 112, 2026)], "sex string, age int, year int")
    f = {(r["sex"], r["age"], r["year"]): r["factor"] for r in actuarial.annuity_factors(cases.where("age < 110"), table).collect()}
    e = {(r["sex"], r["year"]): r["expectancy"] for r in actuarial.life_expectancy(cases.where("age < 110"), table).collect()}
    assert f["M", 65, 2026] > f["H", 65, 2026] and f["H", 65, 2060] > f["H", 65, 2026] and e["M", 2026] > e["H", 2026]
    dear = actuarial.annuity_factors(cases.where("sex = 'M'"), table, 0.06).first()["factor"]
    assert dear < f["M", 65, 2026]
    # The same price by a plain sum over months.
    q = {r["age"]: (r["q0"], r["aa"]) for r in table.where("sex = 'H'").collect()}
    alive, price = 1.0, 0.0
    for x in range(65, 111):
        n = 2026 + x - 65 - 2020
        q0, aa = q[x]
        qx = min(1.0, q0 * math.prod(1 - aa[min(i, 15)] for i in range(n)))
        for m in range(12):
            price += alive / 1.0345 ** (((x - 65) * 12 + m) / 12)
            alive *= (1 - qx) ** (1 / 12)
    assert f["H", 65, 2026] == pytest.approx(price, rel=1e-9)


def test_recentring_is_exact(spark):
    rows = [(i, i % 2, [0.01 * i - 0.02, 0.0, 0.01, -0.01, 0.002 * i]) for i in range(6)]
    pooled = scenarios.pooled_history(spark.createDataFrame(rows, "i int, label int, ret array<double>"), 2)
    targets = [0.04, 0.03, 0.02, 0.01, 0.0]
    made = scenarios.recentred(scenarios.regime_paths(spark, pooled, 5, 24, [[0.8, 0.2], [0.3, 0.7]], 0), targets).collect()
    for k, g in enumerate(targets):
        logs = [math.log1p(m[k]) for r in made for m in r["path"]]
        assert math.exp(12 * sum(logs) / len(logs)) - 1 == pytest.approx(g, abs=1e-12)


def test_an_empty_pool_takes_the_nearest(spark):
    pooled = scenarios.pooled_history(spark.createDataFrame([(0, 0, [0.1] * 5), (1, 2, [0.2] * 5)], "i int, label int, ret array<double>"), 3).first()
    assert pooled["pools"] == [[0], [0], [1]]


def test_blocks_and_spells_have_their_lengths(spark):
    rows = scenarios.block_indices(spark, 40, 240, 12.0).orderBy("path_id", "t").collect()
    cuts = sum(1 for a, b in zip(rows, rows[1:], strict=False) if a["path_id"] == b["path_id"] and (a["i"] + 1) % 240 != b["i"])
    assert 40 * 239 / cuts == pytest.approx(12, abs=2)
    people = spark.range(300).select(scenarios.formal_months(F.lit(0.6), F.col("id"), 240, 36.0).alias("m")).collect()
    share = sum(sum(r["m"]) for r in people) / (300 * 240)
    assert share == pytest.approx(0.6, abs=0.04)


def test_official_bands():
    assert BANDS == (0.010, 0.015, 0.020, 0.024, 0.029, 0.040)
