"""From paths of returns to pensions: careers, weights, strategies, layers, summaries.

A path is one row: an array over months of arrays over the five funds. Weights and
contributions are the same for all paths and are constants of the plan, so that all
strategies of a path come from one projection of it, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import FUNDS, LEGAL_AGE, Career, Glidepath, Reactive, Reform, month_no
from tessera.functions.folds import accumulated, dot, let, literal
from tessera.operators.stats import nearest_to_median, summary

DEFAULT, LIFECYCLE, REACTIVE = "by law", "lifecycle", "reactive"


def ages(career: Career, sex: str, retire_at: int | None = None) -> list[int]:
    """Age in each month of the career; it changes once a year."""
    until = retire_at or LEGAL_AGE[sex]
    return [career.start_age + t // 12 for t in range((until - career.start_age) * 12)]


def salaries(career: Career, month_ages: list[int]) -> list[float]:
    origin = career.start_age if career.growth_origin is None else career.growth_origin
    return [career.salary * (1 + career.salary_growth) ** (min(a, career.growth_until) - origin) for a in month_ages]


def contributions(career: Career, paid: list[float], rate: float | None = None) -> list[float]:
    return [s * (career.contribution if rate is None else rate) * career.density for s in paid]


def growth_share(path: Glidepath, age: float) -> float:
    """Growth assets at an age: the curve, with the part before its floor stretched to the cap."""
    at = min(max(age - path.first_age, 0), len(path.curve) - 1)
    k = int(at)
    after = path.curve[min(k + 1, len(path.curve) - 1)]
    share = path.curve[k] + (at - k) * (after - path.curve[k])
    low, high = min(path.curve), max(path.curve)
    if age <= path.first_age + path.curve.index(low):
        share = low + (share - low) * (path.cap - low) / (high - low)
    return share


def replicated(path: Glidepath, share: float) -> list[float]:
    """Weights of the funds with that share of growth: two neighbours; beyond fund A, the line from E through A."""
    held = path.fund_growth
    share = max(share, held[-1])
    if share >= held[0]:
        share = share if path.extrapolate else held[0]
        high, low = 0, len(held) - 1
    else:
        high = min(bisect_right([-h for h in held], -share) - 1, len(held) - 2)
        low = high + 1
    weight = (share - held[low]) / (held[high] - held[low])
    out = [0.0] * len(held)
    out[high] += weight
    out[low] += 1 - weight
    return out


def by_law(age: int, sex: str) -> list[float]:
    """Fund B up to 35, C up to 55 (men) or 50 (women), then D."""
    fund = 1 if age <= 35 else 2 if age <= (55 if sex == "H" else 50) else 3
    return [float(k == fund) for k in range(len(FUNDS))]


def strategies(month_ages: list[int], sex: str, path: Glidepath = Glidepath()) -> dict[str, list[list[float]]]:
    """Weights by month of the five fixed funds, the default by law and the lifecycle."""
    fixed = {f"fund {f}": [[float(g == f) for g in FUNDS]] * len(month_ages) for f in FUNDS}
    return fixed | {DEFAULT: [by_law(a, sex) for a in month_ages], LIFECYCLE: [replicated(path, growth_share(path, a)) for a in month_ages]}


def portfolio(path: Column, weights: list[list[float]]) -> Column:
    """Monthly returns of a mix of funds."""
    return F.zip_with(F.slice(path, 1, len(weights)), literal(weights), dot)


def balance(path: Column, weights: list[list[float]], paid: list[float]) -> Column:
    return accumulated(portfolio(path, weights), literal(paid))


def reactive_state(path: Column, weights: list[list[float]], paid: list[float], rule: Reactive = Reactive()) -> Column:
    """Final (balance, switches) of a member who moves between a base mix and fund E.

    In a month a switch that waited long enough takes place first, then the wait shortens,
    then the month's return and the signals: so with a lag of one month a signal at the end
    of month t moves the money at the start of t + 2. A fall is that of the held mix over
    three months; a recovery that of fund A, after the least stay in E.
    """
    stay, flee, back = 0, 1, 2
    plan = F.zip_with(F.slice(path, 1, len(weights)), literal([[*w, a] for w, a in zip(weights, paid, strict=True)]), lambda r, w: F.struct(r.alias("r"), w.alias("w")))

    def month(s, x):
        due = (s["pending"] != stay) & (s["wait"] == 0)
        moved = F.struct(
            due.alias("due"),
            F.when(due, s["pending"] == flee).otherwise(s["in_e"]).alias("in_e"),
            F.when(due & (s["pending"] == flee), 0).otherwise(s["stayed"]).alias("stayed"),
            F.when(due, stay).otherwise(s["pending"]).alias("pending"),
            F.greatest(s["wait"] - 1, F.lit(0)).alias("wait"),
        )

        def earned(m):
            held = F.when(m["in_e"], x["r"][4]).otherwise(sum((x["r"][k] * x["w"][k] for k in range(1, 5)), x["r"][0] * x["w"][0]))
            return let(F.struct(held.alias("r"), m.alias("m")), signalled)

        def signalled(e):
            m, r = e["m"], e["r"]
            stayed = m["stayed"] + m["in_e"].cast("int")
            free = (m["pending"] == stay) & (s["t"] >= 2)
            fell = (1 + s["p2"]) * (1 + s["p1"]) * (1 + r) - 1 < rule.fall
            rose = (1 + s["a2"]) * (1 + s["a1"]) * (1 + x["r"][0]) - 1 > rule.recovery
            signal = F.when(free & ~m["in_e"] & fell, flee).when(free & m["in_e"] & (stayed >= rule.least_months) & rose, back).otherwise(stay)

            def close(c):
                return F.struct(
                    (s["t"] + 1).alias("t"),
                    ((s["balance"] + x["w"][5]) * (1 + r)).alias("balance"),
                    (s["switches"] + m["due"].cast("int")).alias("switches"),
                    m["in_e"].alias("in_e"),
                    stayed.alias("stayed"),
                    F.when(c != stay, c).otherwise(m["pending"]).alias("pending"),
                    F.when(c != stay, rule.lag).otherwise(m["wait"]).alias("wait"),
                    r.alias("p1"),
                    s["p1"].alias("p2"),
                    x["r"][0].alias("a1"),
                    s["a1"].alias("a2"),
                )

            return let(signal, close)

        return let(moved, earned)

    ints = {c: F.lit(0) for c in ("t", "switches", "stayed", "pending", "wait")}
    reals = {c: F.lit(0.0) for c in ("balance", "p1", "p2", "a1", "a2")}
    order = ("t", "balance", "switches", "in_e", "stayed", "pending", "wait", "p1", "p2", "a1", "a2")
    zero = F.struct(*[({"in_e": F.lit(False)} | ints | reals)[c].alias(c) for c in order])
    return F.aggregate(plan, zero, month, lambda s: F.struct(s["balance"].alias("balance"), s["switches"].alias("switches")))


def pensions(paths: DataFrame, sex: str, factor: float, career: Career = Career(), rule: Reactive = Reactive(), path: Glidepath = Glidepath(), retire_at: int | None = None) -> DataFrame:
    """(path_id, strategy, pension, switches): all eight strategies of every path, from one projection."""
    months = ages(career, sex, retire_at)
    paid = contributions(career, salaries(career, months))
    mixes = strategies(months, sex, path)
    pay = [F.struct(F.lit(name).alias("strategy"), balance(F.col("path"), w, paid).alias("balance"), F.lit(0).alias("switches")) for name, w in mixes.items()]
    moved = let(reactive_state(F.col("path"), mixes[DEFAULT], paid, rule), lambda s: F.struct(F.lit(REACTIVE).alias("strategy"), s["balance"].alias("balance"), s["switches"].alias("switches")))
    return paths.select("path_id", F.inline(F.array(*pay, moved))).select("path_id", "strategy", (F.col("balance") / factor).alias("pension"), "switches")


def strategy_table(made: DataFrame, last_salary: float, goal: float) -> DataFrame:
    """Percentiles, mean, tail mean, median replacement rate and the chance to reach the goal."""
    table = summary(made, ["strategy"], "pension", goal=goal * last_salary)
    return table.withColumn("replacement", F.col("p50") / last_salary).withColumnRenamed("p50", "median")


def flat_benefit(base: Column, reform: Reform = Reform()) -> Column:
    """The means-tested benefit: full up to one pension, then falling in a line to nothing at another."""
    full, low, high = (x / reform.unit for x in (reform.flat, reform.full_below, reform.none_above))
    return full * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (high - base) / (high - low)))


def rate_at(steps, when: int) -> float:
    """The rate of the last step at or before a month number; 0 before the first."""
    k = bisect_right([s for s, _ in steps], when)
    return steps[k - 1][1] if k else 0.0


def layer_contributions(career: Career, sex: str, reform: Reform = Reform(), retire_at: int | None = None):
    """Monthly own and employer contributions, and the protected bond's value at retirement."""
    months = ages(career, sex, retire_at)
    paid = salaries(career, months)
    start = month_no(career.start_year, 1)
    own = contributions(career, paid)
    employer = [s * career.density * rate_at(reform.employer, start + t) for t, s in enumerate(paid)]
    n = len(months)
    bond = sum(s * career.density * rate_at(reform.bond, start + t) * (1 + reform.bond_rate) ** ((n - t) / 12) for t, s in enumerate(paid))
    return own, employer, bond, paid[-1]


def layered(paths: DataFrame, sex: str, factor: float, career: Career = Career(), reform: Reform = Reform(), path: Glidepath = Glidepath(), names: tuple = (DEFAULT, LIFECYCLE)) -> DataFrame:
    """(path_id, strategy, own, employer, bond, flat, total, last_salary): the layers of every path's pension."""
    own, employer, bond, last = layer_contributions(career, sex, reform)
    mixes = strategies(ages(career, sex), sex, path)

    def layers(name):
        # One pass over the path grows a unit paid in each month; both layers are sums over it.
        returns = portfolio(F.col("path"), mixes[name])
        grown = [accumulated(returns, literal(a)) / factor for a in (own, employer)]
        return F.struct(F.lit(name).alias("strategy"), grown[0].alias("own"), grown[1].alias("employer"))

    rows = paths.select("path_id", F.inline(F.array(*[layers(n) for n in names]))).withColumn("bond", F.lit(bond / factor))
    rows = rows.withColumn("flat", flat_benefit(F.col("own") + F.col("employer") + F.col("bond"), reform))
    return rows.withColumn("total", F.col("own") + F.col("employer") + F.col("bond") + F.col("flat")).withColumn("last_salary", F.lit(last))


def layer_table(rows: DataFrame, goal: float) -> DataFrame:
    """Percentiles of the layers added up one by one, and the chance of the goal."""
    sums = [("1 own", "own"), ("2 with employer", "own + employer"), ("3 with bond", "own + employer + bond"), ("4 total", "total")]
    long = rows.select("strategy", "last_salary", F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.expr(e).alias("value")) for n, e in sums])))
    reach = F.avg((F.col("value") / F.col("last_salary") >= goal).cast("double"))
    q = [F.percentile("value", F.lit(p)).alias(n) for n, p in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))]
    replacement = F.percentile(F.col("value") / F.col("last_salary"), F.lit(0.5))
    return long.groupBy("strategy", "layer").agg(*q, replacement.alias("replacement"), reach.alias("reach"))


def income_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per income, the layers of the path nearest to the median total, so that they add up."""
    return nearest_to_median(rows, keys, "total", "path_id", ["own", "employer", "bond", "flat", "last_salary"])


def target_returns(market: dict, path: Glidepath = Glidepath()) -> list[float]:
    """Expected real return of each fund: its growth share of one return, the rest of the other."""
    return [g * market["growth"] + (1 - g) * market["protected"] for g in path.fund_growth]


def family_share(age: float, g0: float, a1: float, g1: float, retire_at: int) -> float:
    """Growth g0 up to age a1, then in a line to g1 at retirement."""
    done = min(max((age - a1) / max(retire_at - a1, 1e-9), 0.0), 1.0)
    return g0 + (g1 - g0) * done
