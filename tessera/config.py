"""Assumptions as frozen records; a case overrides some with ``dataclasses.replace``.

Rates, tables and dates are values fixed by public law and statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FUNDS = ("A", "B", "C", "D", "E")
LEGAL_AGE = {"H": 65, "M": 60}
ANNUITY_RATE = 0.0345
LAST_AGE = 110


@dataclass(frozen=True)
class Career:
    start_age: int = 25
    start_year: int = 2026
    salary: float = 25.0
    salary_growth: float = 0.015
    growth_until: int = 50
    growth_origin: int | None = None
    contribution: float = 0.10
    density: float = 0.60
    goal: float = 0.40


@dataclass(frozen=True)
class Reactive:
    """A member who flees to fund E after a fall and comes back after a recovery."""

    fall: float = -0.06
    least_months: int = 6
    recovery: float = 0.05
    lag: int = 1


# Most growth assets by age in the published chart, ages 18 to 75.
GROWTH_CURVE = (
    0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90,
    0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90, 0.90,
    0.89, 0.87, 0.86, 0.85, 0.83, 0.81, 0.80, 0.78, 0.76, 0.74, 0.71,
    0.69, 0.66, 0.64, 0.61, 0.58, 0.55, 0.52, 0.50, 0.47, 0.43,
    0.39, 0.36, 0.32, 0.29, 0.29, 0.29, 0.29, 0.29, 0.29, 0.29,
    0.30, 0.31, 0.31, 0.32, 0.32, 0.32,
)

# Fixed values of the law: year, month and rate from then on.
EMPLOYER_RATES = (
    (2025, 8, 0.001), (2027, 8, 0.0025), (2028, 8, 0.010), (2029, 8, 0.017), (2030, 8, 0.024), (2031, 8, 0.031), (2032, 8, 0.038), (2033, 8, 0.045),
    (2045, 9, 0.0465), (2046, 9, 0.048), (2047, 9, 0.0495), (2048, 9, 0.051), (2049, 9, 0.0525), (2050, 9, 0.054), (2051, 9, 0.0555), (2052, 9, 0.057), (2053, 9, 0.0585), (2054, 9, 0.06),
)
BOND_RATES = (
    (2026, 8, 0.009), (2027, 8, 0.015),
    (2045, 9, 0.0135), (2046, 9, 0.012), (2047, 9, 0.0105), (2048, 9, 0.009), (2049, 9, 0.0075), (2050, 9, 0.006), (2051, 9, 0.0045), (2052, 9, 0.003), (2053, 9, 0.0015), (2054, 9, 0.0),
)


@dataclass(frozen=True)
class Glidepath:
    first_age: int = 18
    curve: tuple = GROWTH_CURVE
    cap: float = 0.95
    fund_growth: tuple = (0.824, 0.612, 0.421, 0.213, 0.082)
    extrapolate: bool = True


def month_no(year: int, month: int) -> int:
    return year * 12 + month - 1


def by_month(calendar) -> tuple:
    """(month number, rate) steps of a calendar."""
    return tuple((month_no(year, month), rate) for year, month, rate in calendar)


@dataclass(frozen=True)
class Reform:
    #: Steps of the employer's contribution and of the protected-return bond.
    employer: tuple = by_month(EMPLOYER_RATES)
    bond: tuple = by_month(BOND_RATES)
    bond_rate: float = 0.0252
    unit: float = 39_703.50
    flat: float = 250_275.0
    full_below: float = 789_139.0
    none_above: float = 1_252_602.0
    salaries: tuple = (15.0, 25.0, 40.0, 60.0)


@dataclass(frozen=True)
class Population:
    people: int = 20_000
    scenarios: int = 400
    women: float = 0.44
    unit: float = 40_820.31
    income: dict = field(default_factory=lambda: {"H": (1_076_628.0, 1_419_609.0), "M": (926_383.0, 1_263_282.0)})
    density: dict = field(default_factory=lambda: {"H": 0.579, "M": 0.496})
    concentration: float = 2.0
    correlation: float = 0.3
    spell: float = 36.0
    income_cap: float = 90.0
    income_floor: float = 5.0
    income_age: int = 40
    flat_up_to: float = 0.90


# Market views, band widths, fees by administrator.
MARKETS = {"history": None, "consensus": {"growth": 0.044, "protected": 0.0252}, "no premium": {"growth": 0.0252, "protected": 0.0252}}
BANDS = (0.010, 0.015, 0.020, 0.024, 0.029, 0.040)
FEES = {"UNO": 0.0046, "MODELO": 0.0058, "PLANVITAL": 0.0116, "HABITAT": 0.0127, "CAPITAL": 0.0144, "CUPRUM": 0.0144, "PROVIDA": 0.0145}
#: name, changes of the career, of the scenarios, of the reactive member, of the glidepath, sex.
ROBUSTNESS = (
    ("base, man", {}, {}, {}, {}, "H"),
    ("woman, retires at 60", {}, {}, {}, {}, "M"),
    ("no real salary growth", {"salary_growth": 0.0}, {}, {}, {}, "H"),
    ("salary grows 3 % a year", {"salary_growth": 0.03}, {}, {}, {}, "H"),
    ("starts at 35", {"start_age": 35}, {}, {}, {}, "H"),
    ("returns 1 pp lower", {}, {"haircut": 0.01}, {}, {}, "H"),
    ("returns 2 pp lower", {}, {"haircut": 0.02}, {}, {}, "H"),
    ("starts in calm", {}, {"start": 0}, {}, {}, "H"),
    ("starts in stress", {}, {"start": 2}, {}, {}, "H"),
    ("reacts at -4 %", {}, {}, {"fall": -0.04}, {}, "H"),
    ("reacts at -10 %", {}, {}, {"fall": -0.10}, {}, "H"),
    ("glidepath capped at 90 %", {}, {}, {}, {"cap": 0.90}, "H"),
    ("glidepath within fund A", {}, {}, {}, {"extrapolate": False}, "H"),
)
GRID = {"g0": (0.6, 0.7, 0.8, 0.9, 0.95, 1.0), "a1": (30, 35, 40, 45, 50, 55), "g1": (0.08, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)}
