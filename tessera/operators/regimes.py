"""Gaussian hidden Markov models: fits from many starts, selection, smoothing, summaries.

A fit is small (some hundred months of five funds) and sequential in time, so it is not
split; what is spread over the cluster is starts, numbers of regimes and replicas. Within
a task all starts are iterated together as one array with a leading axis.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numerics import best_assignment

FLOOR = 1e-12
RIDGE = 1e-6


@dataclass
class Regimes:
    """Start probabilities, transitions, means and covariances of k regimes, and the fit's measures."""

    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = np.nan
    bic: float = np.nan
    posterior: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.start)

    def reordered(self, order) -> Regimes:
        order = np.asarray(order)
        after = None if self.posterior is None else self.posterior[:, order]
        return Regimes(self.start[order], self.moves[np.ix_(order, order)], self.means[order], self.covs[order], self.loglik, self.bic, after)


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Normal log densities: x (T, d), means (..., k, d) -> (..., T, k). Raises if a covariance isn't definite."""
    d = x.shape[1]
    root = np.linalg.cholesky(covs)
    gap = x[..., None, :, :] - means[..., :, None, :]
    z = np.linalg.solve(root, np.swapaxes(gap, -1, -2))
    half_det = np.log(np.diagonal(root, axis1=-2, axis2=-1)).sum(-1)
    out = -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(-2)) - half_det[..., None]
    return np.swapaxes(out, -1, -2)


def smooth(logb: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Scaled forward-backward over (..., T, k), with moves (..., k, k) or one per step (..., T-1, k, k).

    Returns the log-likelihood, the posterior, and the expected transitions of each step.
    """
    steps = logb.shape[-2]
    top = logb.max(-1, keepdims=True)
    b = np.exp(logb - top)
    each = moves if moves.ndim == logb.ndim + 1 else np.broadcast_to(moves[..., None, :, :], (*logb.shape[:-2], steps - 1, *moves.shape[-2:]))
    ahead, scale, back = np.empty_like(b), np.empty(b.shape[:-1]), np.ones_like(b)
    now = start * b[..., 0, :]
    for t in range(steps):
        if t:
            now = np.einsum("...i,...ij->...j", now, each[..., t - 1, :, :]) * b[..., t, :]
        scale[..., t] = now.sum(-1)
        now = now / scale[..., t, None]
        ahead[..., t, :] = now
    for t in range(steps - 2, -1, -1):
        back[..., t, :] = np.einsum("...ij,...j->...i", each[..., t, :, :], b[..., t + 1, :] * back[..., t + 1, :]) / scale[..., t + 1, None]
    joint = ahead[..., :-1, :, None] * each * (b * back)[..., 1:, None, :] / scale[..., 1:, None, None]
    return np.log(scale).sum(-1) + top.sum((-1, -2)), ahead * back, joint


def moments(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and covariances of x by (..., T, k) weights; the covariances get a small ridge."""
    mass = weight.sum(-2)
    means = np.einsum("...tk,td->...kd", weight, x) / mass[..., None]
    second = np.einsum("...tk,td,te->...kde", weight, x, x) / mass[..., None, None]
    return means, second - means[..., :, None] * means[..., None, :] + RIDGE * np.eye(x.shape[1])


def random_starts(x: np.ndarray, k: int, n: int, seed: int):
    """n random (start, moves, means, covs): some rows as means, the covariance at a random scale."""
    rng = np.random.default_rng(seed)
    t, d = x.shape
    rows = np.argsort(rng.random((n, t)), axis=1)[:, :k]
    means = x[rows] + rng.normal(size=(n, k, d)) * x.std(0) * 0.1
    base = np.atleast_2d(np.cov(x.T))
    covs = base * rng.uniform(0.5, 1.5, (n, k, 1, 1)) + RIDGE * np.eye(d)
    moves = np.full((n, k, k), 0.1 / max(k - 1, 1)) if k > 1 else np.ones((n, 1, 1))
    if k > 1:
        moves[:, range(k), range(k)] = 0.9
    return np.full((n, k), 1 / k), moves, means, covs


def em(x: np.ndarray, starts, rounds: int = 500, tol: float = 1e-7) -> Regimes:
    """The best end of all starts: each is iterated until its likelihood gains less than tol, or falls."""
    start, moves, means, covs = (np.array(a, float) for a in starts)
    n = len(start)
    before = np.full(n, -np.inf)
    alive = np.arange(n)
    for _ in range(rounds):
        try:
            logb = log_density(x, means[alive], covs[alive])
        except np.linalg.LinAlgError:
            alive = np.array([i for i in alive if _definite(covs[i])], int)
            if not len(alive):
                break
            continue
        ll, post, joint = smooth(logb, start[alive], moves[alive])
        start[alive] = (post[:, 0] + FLOOR) / (post[:, 0] + FLOOR).sum(-1, keepdims=True)
        flow = joint.sum(1)
        out = flow.sum(-1, keepdims=True)
        kept = np.where(out > 0, flow / np.where(out > 0, out, 1), moves[alive]) + FLOOR
        moves[alive] = kept / kept.sum(-1, keepdims=True)
        means[alive], covs[alive] = moments(x, post)
        gain = ll - before[alive]
        before[alive] = ll
        alive = alive[gain >= tol]
        if not len(alive):
            break
    good = [i for i in range(n) if np.isfinite(before[i]) and _definite(covs[i])]
    if not good:
        raise np.linalg.LinAlgError("no start led to definite covariances")
    ll, post, _ = smooth(log_density(x, means[good], covs[good]), start[good], moves[good])
    w = int(np.argmax(np.where(np.isfinite(ll), ll, -np.inf)))
    i = good[w]
    model = Regimes(start[i], moves[i], means[i], covs[i], float(ll[w]), posterior=post[w])
    model = model.reordered(np.argsort([np.trace(c) for c in model.covs], kind="stable"))
    k, (t, d) = model.k, x.shape
    model.bic = -2 * model.loglik + ((k - 1) + k * (k - 1) + k * d + k * d * (d + 1) / 2) * np.log(t)
    return model


def _definite(covs: np.ndarray) -> bool:
    try:
        return bool(np.isfinite(np.linalg.cholesky(covs)).all())
    except np.linalg.LinAlgError:
        return False


def fit(x: np.ndarray, k: int, starts: int = 20, seed: int = 0, warm: Regimes | None = None) -> Regimes:
    made = random_starts(x, k, starts, seed) if starts else tuple(np.empty((0, *s)) for s in ((k,), (k, k), (k, x.shape[1]), (k, x.shape[1], x.shape[1])))
    if warm is not None:
        made = tuple(np.concatenate([a[None], b]) for a, b in zip((warm.start, warm.moves, warm.means, warm.covs), made, strict=True))
    return em(x, made)


def posterior(x: np.ndarray, model: Regimes) -> np.ndarray:
    return smooth(log_density(x, model.means, model.covs), model.start, model.moves)[1]


def simulate(model: Regimes, steps: int, rng: np.random.Generator) -> np.ndarray:
    """A series of the model."""
    sums = np.cumsum(model.moves, axis=1)
    u = rng.random(steps)
    states = np.empty(steps, int)
    states[0] = min(int(np.searchsorted(np.cumsum(model.start / model.start.sum()), u[0])), model.k - 1)
    for t in range(1, steps):
        states[t] = min(int(np.searchsorted(sums[states[t - 1]], u[t])), model.k - 1)
    root = np.linalg.cholesky(model.covs)[states]
    return model.means[states] + (root @ rng.standard_normal((steps, model.means.shape[1], 1)))[..., 0]


def stationary(moves: np.ndarray) -> np.ndarray:
    """Long-run shares: the solution of p = p A with sum 1."""
    k = len(moves)
    system = np.vstack([(moves.T - np.eye(k)), np.ones(k)])
    return np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0]


def aligned(model: Regimes, reference: Regimes) -> Regimes:
    """The model with its regimes in the order that is nearest to the reference's.

    Near is the squared distance of each fund's log volatility and standardised mean.
    """
    variances = lambda m: np.diagonal(m.covs, axis1=1, axis2=2)
    gaps = [0.5 * np.log(variances(reference)[:, None] / variances(model)[None]), (reference.means[:, None] - model.means[None]) / np.sqrt(variances(reference)).mean(0)]
    return model.reordered(best_assignment(sum(np.square(g).sum(-1) for g in gaps)))


def regime_rows(model: Regimes, funds: list[str], per_year: int = 12) -> list[tuple]:
    """(regime, fund, annual_return, annual_vol, months, share) of each regime and fund."""
    share, out = stationary(model.moves), []
    for r in range(model.k):
        stay = model.moves[r, r]
        for j, fund in enumerate(funds):
            out.append((r, fund, float((1 + model.means[r, j]) ** per_year - 1), float(np.sqrt(model.covs[r, j, j] * per_year)), float(1 / (1 - stay)) if stay < 1 else float("inf"), float(share[r])))
    return out


# ---- over the cluster -------------------------------------------------------------------

MODEL = "k int, loglik double, bic double, start array<double>, moves array<double>, means array<double>, covs array<double>, posterior array<double>"


def packed(model: Regimes) -> dict:
    flat = lambda a: np.asarray(a, float).ravel().tolist()
    return {"k": model.k, "loglik": model.loglik, "bic": model.bic, "start": flat(model.start), "moves": flat(model.moves), "means": flat(model.means), "covs": flat(model.covs), "posterior": flat(model.posterior)}


def unpacked(row) -> Regimes:
    k = row["k"]
    means = np.array(row["means"]).reshape(k, -1)
    d = means.shape[1]
    return Regimes(np.array(row["start"]), np.array(row["moves"]).reshape(k, k), means, np.array(row["covs"]).reshape(k, d, d), row["loglik"], row["bic"], np.array(row["posterior"]).reshape(-1, k))


def matrix(history: DataFrame) -> np.ndarray:
    """The months of a history (i, ret) as an array; one row per month, so it fits anywhere."""
    return np.array([r["ret"] for r in history.select("i", "ret").orderBy("i").collect()], float)


def select_regimes(spark: SparkSession, x: np.ndarray, ks=(1, 2, 3), starts: int = 25, per_task: int = 5, seed: int = 11) -> DataFrame:
    """The best fit for each number of regimes, as rows of MODEL; the least bic is the choice."""
    tasks = [(k, seed * 10_007 + s, min(per_task, starts - s)) for k in ks for s in range(0, starts, per_task)]
    shared = spark.sparkContext.broadcast(x)

    def run(key, pdf):
        row = pdf.iloc[0]
        return pd.DataFrame([packed(fit(shared.value, int(row["k"]), int(row["n"]), int(row["seed"])))])

    grid = spark.createDataFrame(tasks, "k int, seed long, n int")
    made = grid.repartition(len(tasks), "k", "seed").groupBy("k", "seed").applyInPandas(run, MODEL)
    names = [c.split()[0] for c in MODEL.split(", ") if not c.startswith("k ")]
    return made.groupBy("k").agg(F.max_by(F.struct(*names), "loglik").alias("m")).select("k", "m.*")


def replicas(spark: SparkSession, n: int, run, schema: str) -> DataFrame:
    """run(replica number) -> list of dicts, for n replicas spread over the cluster; a replica seeds itself."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(key, pdf):
        rows = run(int(key[0]))
        return pd.DataFrame([{"replica": int(key[0]), **r} for r in rows], columns=["replica", *names])

    ids = spark.range(n).withColumnRenamed("id", "replica")
    return ids.repartition(n, "replica").groupBy("replica").applyInPandas(one, f"replica long, {schema}")


def bootstrap(spark: SparkSession, x: np.ndarray, model: Regimes, funds: list[str], n: int, seed: int = 1) -> DataFrame:
    """(replica, regime, stay, months, share, vol_*): refits of series that the model makes; failed replicas are left out."""
    shared = spark.sparkContext.broadcast((x, model))
    names = [f"vol_{f.lower()}" for f in funds]

    def run(replica):
        x, base = shared.value
        rng = np.random.default_rng([seed, replica])
        try:
            made = aligned(fit(simulate(base, len(x), rng), base.k, 1, int(rng.integers(2**31)), base), base)
        except np.linalg.LinAlgError:
            return []
        share = stationary(made.moves)
        vols = np.sqrt(np.diagonal(made.covs, axis1=1, axis2=2) * 12)
        return [{"regime": r, "stay": made.moves[r, r], "months": 1 / (1 - made.moves[r, r]), "share": share[r]} | dict(zip(names, vols[r], strict=True)) for r in range(base.k)]

    return replicas(spark, n, run, "regime int, stay double, months double, share double, " + ", ".join(f"{v} double" for v in names))
