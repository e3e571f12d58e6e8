"""From raw files to all reports: ``python -m tessera RAW OUT``.

RAW holds vcf[A-E]*.csv (unit values in blocks), uf.csv (date, level), members.csv
(date, admin, n) or members.xlsx, mortality.csv (sex, age, q0, aa with ';' inside)
or mortality.xlsx, and, if there are macro regimes to fit, macro.csv
(date, indicator, value). OUT gets a CSV for each table and results.json.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import BANDS, FEES, FUNDS, LEGAL_AGE, MARKETS, Career
from tessera.functions.text import canonical_name
from tessera.operators import actuarial, checks, macro_regimes, panel, peers, pension, population, regimes, scenarios, stats, studies, volatility
from tessera.sources import block_text, sinks, tables


@dataclass(frozen=True)
class Sizes:
    """How much of each study is made; the defaults are the published ones."""

    paths: int = 10_000
    months: int = 480
    starts: int = 25
    layered_paths: int = 3_000
    grid_paths: int = 5_000
    people: int = 20_000
    people_scenarios: int = 400
    gap_people: int = 6_000
    replicas: int = 200
    garch_replicas: int = 100
    replica_paths: int = 2_000
    window: int = 36
    since: str = "2002-08-01"
    walk_from: int = 148


def _exists(path: str) -> bool:
    return Path(path).exists()


def load(spark: SparkSession, raw: str):
    """Panel of unit values, deflator, members and mortality table."""
    values = block_text.read_unit_values(spark, f"{raw}/vcf*.csv")
    deflator = tables.read_deflator(spark, f"{raw}/uf.csv")
    if _exists(f"{raw}/members.xlsx"):
        members = tables.members_from_cells(tables.read_xlsx(spark, f"{raw}/members.xlsx"))
    else:
        members = spark.read.schema("date date, admin string, n double").option("header", True).csv(f"{raw}/members.csv").withColumn("admin", canonical_name(F.col("admin")))
    if _exists(f"{raw}/mortality.xlsx"):
        mortality = tables.mortality_from_cells(tables.read_xlsx(spark, f"{raw}/mortality.xlsx"), {"Vejez-Hombres": "H", "Vejez-Mujeres": "M"})
    else:
        rows = spark.read.schema("sex string, age int, q0 double, aa string").option("header", True).csv(f"{raw}/mortality.csv")
        mortality = rows.withColumn("aa", F.transform(F.split("aa", ";"), lambda x: x.cast("double")))
    return values, deflator, members, mortality


def run(spark: SparkSession, raw: str, out: str, sizes: Sizes = Sizes(), career: Career = Career()) -> dict[str, DataFrame]:
    """All stages; writes every table to ``out`` and returns them by name."""
    made: dict[str, DataFrame] = {}
    values, deflator, members, mortality = load(spark, raw)
    unit = block_text.unit_panel(values)
    returns = unit.select("fund", "admin", "date", "ret")
    made["rebases"] = checks.rebase_events(returns)
    clean = checks.neutralised(unit, made["rebases"])
    flagged = values.withColumn("provisional", F.col("status") == "provisional").join(returns, ["fund", "admin", "date"], "left")
    made["quality"] = checks.quality_report(flagged, ["fund", "admin"], "date", "unit_value", "ret", 0.10, "provisional")
    real = block_text.real_panel(clean, deflator, members).persist()
    index = block_text.system_index(real, "ret_real_adjusted", sizes.since).persist()
    levels = index.withColumn("level", panel.index_level("ret", ["fund"], "date"))
    made["index"] = levels
    made["drawdowns"] = panel.worst_drawdown(levels, "level", ["fund"], "date")
    monthly = panel.month_end_returns(levels, "level", ["fund"], "date").persist()
    made["monthly_returns"] = monthly.select("fund", "month", "ret")

    wide = monthly.groupBy("month").pivot("fund", list(FUNDS)).agg(F.max("ret")).dropna().orderBy("month").collect()
    dates, x = [r["month"] for r in wide], np.array([[r[f] for f in FUNDS] for r in wide], float)
    picked = regimes.select_regimes(spark, x, (1, 2, 3), sizes.starts).orderBy("bic").collect()
    model = regimes.unpacked(picked[0])
    made["regime_selection"] = spark.createDataFrame([(r["k"], r["loglik"], r["bic"]) for r in picked], "k int, loglik double, bic double")
    made["regimes"] = spark.createDataFrame(regimes.regime_rows(model, list(FUNDS)), "regime int, fund string, annual_return double, annual_vol double, months double, share double")
    label = model.posterior.argmax(1)
    made["regime_probabilities"] = spark.createDataFrame([(d, k, float(p)) for d, row in zip(dates, model.posterior, strict=True) for k, p in enumerate(row)], "month date, regime int, probability double")
    days = panel.effective_days(index, "date", "ret")
    busy = index.join(days, "date").persist()
    made["garch"] = volatility.garch_by_series(busy, "fund", "date", "ret")
    pairs = monthly.where(F.col("fund").isin("C", "E")).groupBy("month").pivot("fund", ["C", "E"]).agg(F.max("ret")).withColumn("one", F.lit(1))
    made["correlation"] = pairs.select("month", panel.rolling_corr("C", "E", ["one"], "month", sizes.window).alias("correlation")).dropna()

    history = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(len(x))], "i int, label int, ret array<double>")
    moves, start = model.moves.tolist(), int(label[-1])
    # Factors of every (sex, age, year) that a study asks for, in one query.
    cases = {(s, a, career.start_year + a - career.start_age) for s in "HM" for a in (60, 65)} | {(s, a, career.start_year + a - 35) for s in "HM" for a in (60, 65)} | {(s, LEGAL_AGE[s], 2026) for s in "HM"}
    priced = actuarial.annuity_factors(spark.createDataFrame(sorted(cases), "sex string, age int, year int"), mortality).collect()
    factors = {(r["sex"], r["age"], r["year"]): r["factor"] for r in priced}
    factor = lambda sex, age=None: factors[sex, age or LEGAL_AGE[sex], career.start_year + (age or LEGAL_AGE[sex]) - career.start_age]
    made["annuity_factors"] = spark.createDataFrame([(*k, v) for k, v in sorted(factors.items())], "sex string, age int, year int, factor double")

    pooled = scenarios.pooled_history(history, model.k)
    walked = scenarios.regime_paths(spark, pooled, sizes.paths, sizes.months, moves, start).persist()
    paths = scenarios.returns_of(walked)
    base = None
    for sex in "HM":
        pays = pension.pensions(paths, sex, factor(sex), career).persist()
        last = pension.salaries(career, pension.ages(career, sex))[-1]
        made[f"strategies_{sex}"] = pension.strategy_table(pays, last, career.goal)
        if sex == "H":
            base = pays
            lower = pension.pensions(scenarios.returns_of(walked, haircut=0.01), sex, factor(sex), career)
            made["strategies_H_less_1pp"] = pension.strategy_table(lower, last, career.goal)
    if len(x) >= 12:
        made["backtest"] = _backtest(spark, x, factors)
    made["robustness"] = studies.robustness(spark, history, moves, start, factor, sizes.paths, months=sizes.months)
    made["markets"] = studies.market_scenarios(spark, history, moves, start, factor, sizes.paths, sizes.months)

    few = walked.where(F.col("path_id") < sizes.layered_paths)
    consensus = scenarios.recentred(few, pension.target_returns(MARKETS["consensus"])).persist()
    for sex in "HM":
        made[f"layers_{sex}"] = pension.layer_table(pension.layered(consensus, sex, factor(sex), career), career.goal)
    made["incomes"] = _incomes(consensus, factor("H"), career)
    made.update(_population(spark, consensus.where(F.col("path_id") < sizes.people_scenarios).persist(), factor, career, sizes))
    sets = [scenarios.recentred(scenarios.regime_paths(spark, pooled, sizes.grid_paths, sizes.months, moves, start, s), pension.target_returns(MARKETS["consensus"])).persist() for s in ("train", "test")]
    best = None
    for with_reform in (True, False):
        for gamma in (2.0, 3.0, 5.0):
            one = studies.glidepath_search(*sets, "H", factor("H"), gamma, career, with_reform=with_reform)[1].withColumns({"gamma": F.lit(gamma), "reform": F.lit(with_reform)})
            best = one if best is None else best.unionByName(one)
    made["glidepaths"] = best

    weights = real.withColumn("weight", F.col("assets")).select("fund", "admin", "date", F.col("ret_real_adjusted").alias("ret"), "weight")
    months = peers.monthly_admin_returns(weights).persist()
    made["deviations"] = peers.rolling_deviation(months, sizes.window)
    made["bands"] = peers.band_frequency(made["deviations"], list(BANDS))
    made["fees"] = _fees(spark, months, consensus, base, career)
    made["regime_bootstrap"] = regimes.bootstrap(spark, x, model, list(FUNDS), sizes.replicas)
    made["garch_bootstrap"] = volatility.garch_bootstrap(busy, "fund", "date", "ret", sizes.garch_replicas)
    made["pension_bootstrap"] = studies.pension_bootstrap(spark, x, model, sizes.replicas, sizes.replica_paths, factor("H"), sizes.months, career=career)
    made["pension_intervals"] = stats.melted_percentiles(made["pension_bootstrap"].persist(), [], ["premium", "lifecycle_median", "lifecycle_wins", "reactive_median", "default_median"], {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    if _exists(f"{raw}/macro.csv") and model.k == 3 and len(x) > sizes.walk_from:
        made.update(_macro(spark, raw, x, dates, sizes))
    write(made, out, {"regimes": model.k, "first_month": str(dates[0]), "last_month": str(dates[-1]), "made": sorted(made)})
    return made


def _backtest(spark, x, factors) -> DataFrame:
    """What history's own path paid members who retired at its end."""
    one = spark.createDataFrame([(0, x.tolist())], "path_id long, path array<array<double>>")
    out = None
    for sex in "HM":
        until = LEGAL_AGE[sex]
        first = until - len(x) // 12
        past = Career(start_age=first, growth_origin=25)
        ages = [first + k // 12 for k in range(len(x))]
        paid = pension.contributions(past, pension.salaries(past, ages))
        mixes = pension.strategies(ages, sex)
        state = pension.reactive_state(F.col("path"), mixes[pension.DEFAULT], paid)
        pay = [F.struct(F.lit(n).alias("strategy"), pension.balance(F.col("path"), w, paid).alias("balance"), F.lit(0).alias("switches")) for n, w in mixes.items()]
        moved = F.struct(F.lit(pension.REACTIVE).alias("strategy"), state["balance"].alias("balance"), state["switches"].alias("switches"))
        rows = one.select(F.inline(F.array(*pay, moved))).withColumns({"sex": F.lit(sex), "pension": F.col("balance") / factors[sex, until, 2026]})
        default = rows.where(F.col("strategy") == pension.DEFAULT).select(F.col("pension").alias("_d"))
        rows = rows.crossJoin(default).select("sex", "strategy", "balance", "pension", "switches", (F.col("pension") / F.col("_d") - 1).alias("over_default"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _incomes(paths, factor, career) -> DataFrame:
    from dataclasses import replace

    from tessera.config import Reform

    out = None
    for salary in Reform().salaries:
        rows = pension.layered(paths, "H", factor, replace(career, salary=salary), names=(pension.DEFAULT,)).withColumn("salary", F.lit(salary))
        out = rows if out is None else out.unionByName(rows)
    return pension.income_table(out, ["salary"])


def _population(spark, paths, factor, career, sizes) -> dict[str, DataFrame]:
    cohort = population.people(spark, sizes.people).persist()
    top = stats.exact_percentiles(cohort, [], "income", {"top": 0.9}).first()["top"]
    out = None
    for sex in "HM":
        one = population.cohort_pensions(cohort.where(F.col("sex") == sex), paths, sex, factor(sex), career, flat_up_to=F.lit(top))
        out = one if out is None else out.unionByName(one)
    out = out.persist()
    return {
        "population": population.cohort_summary(out, career.goal, by_quintile=False),
        "population_quintiles": population.cohort_summary(out, career.goal, by_quintile=True),
        "population_curve": stats.percentile_curve(out.where(F.col("strategy") == pension.DEFAULT).withColumn("rate", F.col("total") / F.greatest(F.col("last_salary"), F.lit(1e-9))), ["sex"], "rate"),
        "gender_gap": population.gender_gap(spark, paths, factor, sizes.gap_people, career),
    }


def _fees(spark, months, paths, pays, career) -> DataFrame:
    least = min(FEES.values())
    found = studies.break_even(paths, sorted({f - least for f in FEES.values() if f > least}), career)
    fees = spark.createDataFrame([(a, f, f - least) for a, f in FEES.items()], "admin string, fee double, surcharge double").join(F.broadcast(found), "surcharge", "left")
    fees = fees.select("admin", "fee", F.coalesce("break_even", F.lit(0.0)).alias("extra"))
    plain = pays.where(F.col("strategy") == pension.DEFAULT).agg(F.percentile("pension", F.lit(0.5))).first()[0]
    base = sum(pension.salaries(career, pension.ages(career, "H"))) * career.density
    table = peers.fee_table(peers.alpha(months, 24), fees, F.col("extra"), career.contribution, F.lit(plain))
    return table.drop("extra", "fee_min").withColumn("paid_in_life", F.col("fee") * base)


def _macro(spark, raw, x, dates: list[dt.date], sizes) -> dict[str, DataFrame]:
    macro = tables.read_macro(spark, f"{raw}/macro.csv", ["ipc", "tpm", "dolar", "imacec"])
    names = ["inflation_12", "policy_6", "dollar_3", "activity"]
    by = {r["month"]: [r[n] for n in names] for r in tables.macro_variables(macro, str(dates[-1])).collect()}
    if any(d not in by or any(v is None for v in by[d]) for d in dates):
        return {}
    z = np.array([by[d] for d in dates], float)
    scores = macro_regimes.walk_forward(spark, x, z, sizes.walk_from).persist()
    tests = None
    for name in ("constant", "normal"):
        one = stats.diebold_mariano(scores.select("t", (F.col("macro") - F.col(name)).alias("d")), "t", "d").withColumn("against", F.lit(name))
        tests = one if tests is None else tests.unionByName(one)
    scaled = (z - z.mean(0)) / (z.std(0) + 1e-12)
    effects = macro_regimes.marginal_effects(macro_regimes.fit_macro(x, scaled, regimes.fit(x, 3, 10, 11)))
    rows = [(n, i, j, float(effects[k, i, j])) for k, n in enumerate(names) for i in range(3) for j in range(3)]
    return {"macro_scores": scores, "macro_tests": tests, "macro_effects": spark.createDataFrame(rows, "variable string, origin int, target int, effect double")}


#: Tables with a row per day or per replica go out as folders of parts; the others are reports.
WIDE = {"index", "deviations", "regime_bootstrap", "garch_bootstrap", "pension_bootstrap"}


def write(made: dict[str, DataFrame], out: str, facts: dict) -> None:
    Path(out).mkdir(parents=True, exist_ok=True)
    for name, df in made.items():
        if name in WIDE:
            sinks.write_csv(df, f"{out}/{name}")
        else:
            sinks.write_report_csv(df, f"{out}/{name}.csv.gz")
    reports = {n: made[n] for n in made if n not in WIDE and n not in ("regime_probabilities", "monthly_returns")}
    sinks.write_json({"facts": facts} | reports, f"{out}/results.json")
    sinks.write_xlsx({n[:31]: sinks.sheet_of(df) for n, df in reports.items()}, f"{out}/results.xlsx")
