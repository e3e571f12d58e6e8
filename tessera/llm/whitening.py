"""Operator 13: whitening of embeddings by a two-pass covariance.

The first pass adds up whole numbers, so the mean is exact; the second adds up outer products
of centred vectors, a matrix product for each batch. Each task hands on one matrix, and
treeAggregate merges them. LAPACK decomposes the sum on the driver, where only a matrix of
dimensions x dimensions arrives, and a broadcast projection whitens all rows in one pass that
shuffles nothing. How white the result is gets measured by the same two passes.

Shape at scale: the distinct vectors are shuffled once, after each task has merged its own
repeats, and written to the shared folder; the passes read that table. A lost executor costs the
batches it was adding up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove, written

#: Entries are counted in so many steps a unit, from this zero point.
STEPS, ZERO = 64, 1_000_000
COMPONENTS = 16
#: Entries of more steps than this either way count as so many; beyond it doubles skip whole numbers.
MOST_STEPS = 2**52
#: Components whose eigenvalue is a smaller share of the trace than this are rounding errors.
LEAST_SHARE = 1e-12


def whole_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector can be used, with ``x``: whole numbers of steps.

    A null or empty vector, and one with a null, infinite or not-a-number entry, is dropped. So
    is one whose length is not the most frequent one (of equally frequent ones the longest).
    """
    entry = lambda c: c.cast("double")
    unfit = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    rows = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, unfit))
    lengths = rows.groupBy(F.size(vector_col).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    clipped = lambda c: F.greatest(F.least(F.lit(float(STEPS)) * entry(c), F.lit(float(MOST_STEPS))), F.lit(-float(MOST_STEPS)))
    steps = F.transform(vector_col, lambda c: F.floor(clipped(c)) + F.lit(ZERO).cast("bigint"))
    return rows.where(F.size(vector_col) == (lengths["length"] if lengths else 0)).withColumn("x", steps)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(vectors: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of_batch`` over all batches of ``x``: one array of each task, merged in a tree. None without rows."""

    def of_task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([list(total.shape)], pa.list_(pa.int64())), pa.array([_packed(total)], pa.binary())], ["shape", "total"])

    parts = vectors.select("x").mapInArrow(of_task, "shape array<bigint>, total binary").rdd
    merged = parts.treeAggregate(None, lambda a, r: _plus(a, _unpacked(r["shape"], r["total"])), _plus, depth=2)
    return merged


def _plus(a, b):
    return b if a is None else a if b is None else a + b


def _packed(total: np.ndarray) -> bytes:
    """Doubles as they are; whole numbers of any size as text."""
    return b"d" + total.tobytes() if total.dtype == np.float64 else b"i" + " ".join(map(str, total.ravel())).encode()


def _unpacked(shape: list[int], raw: bytes) -> np.ndarray:
    if raw[:1] == b"d":
        return np.frombuffer(raw, np.float64, offset=1).reshape(shape)
    return np.array([int(v) for v in raw[1:].split()], object).reshape(shape)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The number of vectors and the sum of each dimension, as whole numbers without a bound."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return np.array([len(x), *(int(h) * 2**32 + int(v) for h, v in zip(high, low, strict=True))], object)


class Centre:
    """The exact mean S / n, as the whole number below it and the rest in n-ths."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.below = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.below) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 over the dimensions; null where it is beyond 64 bits."""
        c = x - self.below
        if float(max(np.abs(c).max(initial=0), 1) + 1) * self.n * math.sqrt(x.shape[1]) < 2.0**31:
            return ((c * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((c.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def covariance(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], mean: np.ndarray | float, n: int) -> np.ndarray:
    """The covariance, divisor n, of ``of`` the vectors, which have that mean."""

    def outer(x: np.ndarray) -> np.ndarray:
        centred = of(x) - mean
        return centred.T @ centred

    return _summed(vectors, outer) / n


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit vectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > LEAST_SHARE * max(np.trace(v), 0.0)
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs


OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector's entries c become x = floor(64 c) + 1000000; entries beyond 2^52 steps count as
    2^52. The fit list holds each distinct x once: n of them, with sums S and covariance V.
    Components are unit eigenvectors of V by falling eigenvalue e, at most ``components`` of them;
    those without variance (a constant dimension, fewer vectors than dimensions) are left out.
    ``deviation`` is the sum of (n x - S)^2, null where it exceeds 64 bits; ``whitened`` is x - S/n
    on the component over sqrt(e), ``explained`` is e over the trace, and ``identity_error`` is
    the largest entry of the whitened fit list's covariance minus the identity.

    Vectors that are null, empty or have null or non-finite entries are dropped, as are those of
    another length than most have. Repeated rows and ids are each returned, a null id too. Without
    usable rows, or if all vectors are equal, no rows are returned. Other columns are ignored. The
    driver and each task hold a few matrices of dimensions x dimensions, whatever the rows.
    """
    spark = rows.sparkSession
    usable = whole_vectors(rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("_vector")), "_vector").select("id", "x")
    distinct, path = written(usable.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).select("x"), "fit-list")
    try:
        fitted = _fit(distinct, components)
    finally:
        remove(spark, path)
    if fitted is None:
        return spark.createDataFrame([], f"{id_col} bigint, {OUT}")
    return _project(spark, usable, fitted, id_col)


def _fit(distinct: DataFrame, components: int):
    """(centre, projection, explained, identity error) of the fit list; None if it has no variance."""
    sums = _summed(distinct, exact_sums)
    if sums is None:
        return None
    centre = Centre(int(sums[0]), [int(s) for s in sums[1:]])
    v = covariance(distinct, centre.centred, 0.0, centre.n)
    values, vectors = principal(v, components)
    if not len(values):
        return None
    projection = vectors / np.sqrt(values)
    whitened = lambda x: centre.centred(x) @ projection
    mean = _summed(distinct, lambda x: whitened(x).sum(axis=0)) / centre.n
    error = np.abs(covariance(distinct, whitened, mean, centre.n) - np.eye(len(values))).max()
    return centre, projection, values / np.trace(v), float(error)


def _project(spark: SparkSession, usable: DataFrame, fitted, id_col: str) -> DataFrame:
    held = spark.sparkContext.broadcast(fitted)

    def project(batches):
        centre, projection, explained, error = held.value
        k = len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1)), batch.num_rows
            spread = np.repeat(np.arange(rows), k)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(spread)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, centre.n, np.int64)),
                    pa.array(centre.deviation(x), pa.int64()).take(pa.array(spread)),
                    pa.array((centre.centred(x) @ projection).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(project, f"{id_col} bigint, {OUT}")
