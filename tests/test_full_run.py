"""The whole run over small raw files made here: every table has rows, and known facts come out."""

import datetime as dt
import gzip
import json
import math

import numpy as np
import pytest

from tessera.config import Career
from tessera.operators import actuarial
from tessera.plans import full_run

FIRST, MONTHS = dt.date(2018, 1, 1), 40


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(0)
    days = [FIRST + dt.timedelta(k) for k in range(MONTHS * 31) if FIRST + dt.timedelta(k) < dt.date(2021, 5, 1)]
    number = lambda v: f"{v:,.2f}".replace(",", "_").replace(".", ",").replace("_", ".")
    for f, vol in zip("ABCDE", (0.012, 0.009, 0.006, 0.004, 0.003), strict=True):
        unit = np.cumprod(1 + np.where([d.weekday() < 5 for d in days], rng.normal(2e-4, vol, (3, len(days))), 0.0), axis=1) * 1000
        lines = ["Valores Confirmados", "Fecha;UNO;x;MODELO;x;CAPITAL;x"]
        lines += [";".join([str(d), *[c for a in range(3) for c in (number(unit[a, k]), number(100.0 + a))]]) for k, d in enumerate(days)]
        (folder / f"vcf{f}.csv").write_bytes("\n".join(lines).encode("latin-1"))
    (folder / "uf.csv").write_text("date,level\n" + "\n".join(f"{d},{1 + k * 1e-4:.6f}" for k, d in enumerate(days)))
    (folder / "members.csv").write_text("date,admin,n\n" + "\n".join(f"2018-03-31,{a},{n}" for n, a in enumerate(("UNO", "MODELO", "CAPITAL"), 1)))
    rows = actuarial.gompertz_table(spark).collect()
    (folder / "mortality.csv").write_text("sex,age,q0,aa\n" + "\n".join(f"{r['sex']},{r['age']},{r['q0']!r},{';'.join(map(repr, r['aa']))}" for r in rows))
    return str(folder)


def test_full_run(spark, raw, tmp_path):
    sizes = full_run.Sizes(paths=12, months=360, starts=2, layered_paths=8, grid_paths=6, people=30, people_scenarios=4, gap_people=12, replicas=2, garch_replicas=1, replica_paths=4, window=12, since="2018-01-01")
    made = full_run.run(spark, raw, str(tmp_path / "out"), sizes, Career(start_age=55, growth_until=60))
    bundle = json.loads((tmp_path / "out/results.json").read_text())
    assert bundle["facts"]["first_month"] == "2018-02-28" and bundle["facts"]["last_month"] == "2021-04-30"
    assert {r["strategy"] for r in bundle["strategies_H"]} >= {"by law", "lifecycle", "reactive", "fund A"} and len(bundle["strategies_M"]) == 8
    assert len(bundle["bands"]) == 30 and len(bundle["garch"]) == 5 and len(bundle["robustness"]) >= 10 and len(bundle["glidepaths"]) == 36
    assert sum(r["share"] for r in bundle["gender_gap"]) > 0 and not bundle["rebases"]
    for r in bundle["incomes"]:
        assert math.isclose(r["total"], r["own"] + r["employer"] + r["bond"] + r["flat"], rel_tol=1e-9)
    assert gzip.open(tmp_path / "out/fees.csv.gz", "rt").readline().startswith("admin,fee")
    assert {"population", "layers_H", "markets", "backtest", "pension_intervals"} <= set(made)
