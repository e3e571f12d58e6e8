"""Recursions over an array within one row, so that a path never leaves its partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: lambdas of higher-order functions have no names of their own."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(values) -> Column:
    """A constant array of doubles, or of arrays of doubles.

    It is parsed from text: one call to the JVM instead of one for each number.
    """

    def text(v):
        return f"array({', '.join(map(text, v))})" if isinstance(v, (list, tuple)) else f"{float(v)!r}D"

    return F.expr(text(values))


def paired(a: Column, b: Column, names: tuple[str, str]) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1])))


def accumulated(returns: Column, contributions: Column) -> Column:
    """Final balance when each contribution comes in before its month's return."""
    return F.aggregate(paired(returns, contributions, ("r", "a")), F.lit(0.0), lambda s, x: (s + x["a"]) * (1 + x["r"]))


def conditional_variance(returns: Column, omega: float, alpha: float, beta: float, start: Column) -> Column:
    """GARCH(1,1) variances, the first one given, as an array as long as the returns."""
    step = lambda s, r: F.concat(s, F.array(omega + alpha * r * r + beta * F.element_at(s, -1)))
    return F.aggregate(F.slice(returns, F.lit(1), F.size(returns) - 1), F.array(start), step)


def filtered_regimes(densities: Column, start: list[float], moves: list[list[float]]) -> Column:
    """(loglik, probs) of a hidden Markov chain with fixed parameters, by the scaled forward pass.

    densities: array over time of arrays over states of emission densities.
    """
    k = range(len(start))

    def step(state, b):
        reach = F.array(*[sum((state["probs"][i] * moves[i][j] for i in k[1:]), state["probs"][0] * moves[0][j]) * b[j] for j in k])
        raw = F.when(state["t"] == 0, F.array(*[b[j] * start[j] for j in k])).otherwise(reach)

        def scaled(x):
            total = sum((x[j] for j in k[1:]), x[0])
            return F.struct((state["t"] + 1).alias("t"), (state["loglik"] + F.ln(total)).alias("loglik"), F.array(*[x[j] / total for j in k]).alias("probs"))

        return let(raw, scaled)

    zero = F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("loglik"), literal([0.0] * len(start)).alias("probs"))
    return F.aggregate(densities, zero, step)


def smoothed_regimes(densities: Column, start: list[float], moves: list[list[float]]) -> Column:
    """Probabilities of the states at each time given the whole series: an array over time, by both scaled passes."""
    k = range(len(start))
    added = lambda cells: sum(cells[1:], cells[0])

    def scaled(cells):
        return let(F.array(*cells), lambda x: F.array(*[x[j] / added([x[i] for i in k]) for j in k]))

    def onward(done, b):
        last = F.element_at(done, -1)
        return F.concat(done, F.array(scaled([added([last[i] * moves[i][j] for i in k]) * b[j] for j in k])))

    def backward(done, b):
        last = F.element_at(done, -1)
        return F.concat(done, F.array(scaled([added([last[j] * b[j] * moves[i][j] for j in k]) for i in k])))

    rest = F.size(densities) - 1
    ahead = F.aggregate(F.slice(densities, F.lit(2), rest), F.array(scaled([F.get(densities, 0)[j] * start[j] for j in k])), onward)
    behind = F.aggregate(F.slice(F.reverse(densities), F.lit(1), rest), F.array(literal([1.0] * len(start))), backward)
    return F.zip_with(ahead, F.reverse(behind), lambda a, b: scaled([a[j] * b[j] for j in k]))


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]
