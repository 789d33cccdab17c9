"""Embedding whitening.

The covariance of the distinct vectors is summed by tasks from centred rows and reaches the driver as one matrix, whose size is
the square of the dimension and does not grow with the rows. There it is brought to tridiagonal form by Householder
reflections; Sturm counts bisect for the leading eigenvalues, inverse iteration finds their vectors, orthogonalised again inside
clusters of near eigenvalues, and the reflections carry them back. Every task then projects its rows on those few vectors.

Defined results: rows are left out whose vector is null or empty, holds null or non-finite entries, or has another length than
most distinct vectors have (ties: the greater length), because one covariance needs one length. An entry c counts as
floor(64 * c) + 1000000. Repeated vectors count once for the fit, and every row gets its result, a null id too. Only directions
with variance are components: eigenvalues up to 1e-12 of the largest are none, so fewer than ``components`` come back where
the vectors span less, and no row at all from an empty table or a single distinct vector. A deviation beyond a long is null.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from postlake.llm.common import drop_path, materialize

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Eigenvalues up to this part of the largest are rounding errors of a direction without variance.
NO_VARIANCE = 1e-12
#: Eigenvalues nearer than this part of the largest make a cluster; steps of inverse iteration.
CLUSTER, STEPS = 1e-3, 4


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the rows whose vector is finite: x has the entries as longs."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    x = F.transform(v, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col(f"`{key}`").alias("id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _summed(rows: DataFrame, d: int, width: int, term: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of ``term`` over all vectors: a task adds up its own rows, Spark the tasks; ``width`` values reach the driver."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width, dtype=dtype), False
        for batch in batches:
            if batch.num_rows:
                total += term(_matrix(batch, d)).reshape(-1)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["at", "value"])

    sums = rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width, dtype=dtype)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    beside = np.zeros(max(0, d - 1))
    mirrors = []
    for k in range(d - 1):
        x = a[k + 1 :, k].copy()
        beside[k] = -np.copysign(np.linalg.norm(x), x[0]) if np.any(x[1:]) else x[0]
        x[0] -= beside[k]
        length = np.linalg.norm(x)
        v = x / length if length else x
        mirrors.append(v)
        if length:
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
    return a.diagonal().copy(), beside, mirrors


def from_tridiagonal(vector: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix in the coordinates of the first one."""
    y = vector.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        y[k + 1 :] -= 2 * (mirrors[k] @ y[k + 1 :]) * mirrors[k]
    return y


def sturm_counts(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny * 4
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[k] - at - beside[k - 1] * (beside[k - 1] / pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[1:] += np.abs(beside)
    reach[:-1] += np.abs(beside)
    low = np.full(n, (diagonal - reach).min())
    high = np.full(n, np.nextafter((diagonal + reach).max(), np.inf))
    order = d - np.arange(1, n + 1)  # so many eigenvalues are smaller, in rising order
    for _ in range(2000):
        middle = low + (high - low) / 2
        if not np.any((middle > low) & (middle < high)):
            break
        above = sturm_counts(diagonal, beside, middle) > order
        high = np.where(above, middle, high)
        low = np.where(above, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, beside: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b; elimination with row exchanges, so that a nearly singular matrix does no harm."""
    d = len(diagonal)
    pivot, next1, next2 = (np.zeros(d) for _ in range(3))
    factor, swapped = np.zeros(d), np.zeros(d, dtype=bool)
    row = [diagonal[0] - shift, beside[0] if d > 1 else 0.0, 0.0]
    for k in range(d - 1):
        below = [beside[k], diagonal[k + 1] - shift, beside[k + 1] if k + 2 < d else 0.0]
        swapped[k] = abs(below[0]) > abs(row[0])
        if swapped[k]:
            row, below = below, row
        if abs(row[0]) < least:
            row[0] = least
        factor[k] = below[0] / row[0]
        pivot[k], next1[k], next2[k] = row
        row = [below[1] - factor[k] * row[1], below[2] - factor[k] * row[2], 0.0]
    pivot[-1] = row[0] if abs(row[0]) >= least else least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k in range(d - 1):
            if swapped[k]:
                y[k], y[k + 1] = y[k + 1], y[k]
            y[k + 1] -= factor[k] * y[k]
        for k in range(d - 1, -1, -1):
            if k + 1 < d:
                y[k] -= next1[k] * y[k + 1]
            if k + 2 < d:
                y[k] -= next2[k] * y[k + 2]
            y[k] /= pivot[k]
        return y

    return solve


def leading_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one per row, by inverse iteration; near eigenvalues are orthogonalised again in every step."""
    rng = np.random.default_rng(20250117)
    scale = max(np.abs(diagonal).max(), np.abs(beside).max() if len(beside) else 0.0)
    least = max(scale * np.finfo(np.float64).eps, np.finfo(np.float64).tiny)
    out = np.zeros((len(values), len(diagonal)))
    for j, value in enumerate(values):
        near = [k for k in range(j) if values[k] - value <= CLUSTER * scale]
        solve = _solver(diagonal, beside, value, least)
        y = rng.standard_normal(len(diagonal))
        for _ in range(STEPS):
            y = solve(y / np.linalg.norm(y))
            y /= np.abs(y).max()
            for _ in range(2):
                for k in near:
                    y -= (out[k] @ y) * out[k]
        out[j] = y / np.linalg.norm(y)
    return out


def leading_components(matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``n`` largest eigenvalues with variance, falling, and their unit vectors, one per row."""
    scale = np.abs(matrix).max()
    if not scale > 0:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, beside, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, beside, min(n, len(matrix)))
    values = values[values > NO_VARIANCE * values[0]]
    vectors = leading_vectors(diagonal, beside, values)
    return values * scale, np.stack([from_tridiagonal(v, mirrors) for v in vectors])


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every whole vector and component."""
    schema = StructType([
        StructField("vec_id", rows.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()),
        StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
        StructField("identity_error", DoubleType()),
    ])
    empty = rows.sparkSession.createDataFrame([], schema)
    whole = whole_vectors(rows, vector, key)
    fit, path = materialize(whole.select("x").distinct(), "whitening-fit")
    most = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return empty
    d, n = most
    fit = fit.where(F.size("x") == d)
    total = _summed(fit, d, d, lambda x: x.sum(axis=0), "long")

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - total) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = centred(x)
        return z.T @ z

    covariance = _summed(fit, d, d * d, products, "double").reshape(d, d) / n
    values, vectors = leading_components((covariance + covariance.T) / 2, components)
    k = len(values)
    if not k:
        return empty
    explained = values / np.trace(covariance)
    onto = (vectors / np.sqrt(values)[:, None]).T

    # whether the projection does what it should, measured on the fit list itself
    mean = _summed(fit, d, k, lambda x: (centred(x) @ onto).sum(axis=0), "double") / n

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ onto - mean
        return w.T @ w

    left = _summed(fit, d, k * k, whitened_products, "double").reshape(k, k) / n - np.eye(k)
    error = float(np.abs(left).max())
    drop_path(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch, d)
            off = n * x - total
            if float(np.abs(off).max()) ** 2 * d < 2.0**62:
                deviation = (off * off).sum(axis=1).tolist()
            else:
                exact = [sum(int(c) ** 2 for c in row) for row in off]
                deviation = [e if e < 1 << 63 else None for e in exact]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array((off / n @ onto).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                schema.names,
            )

    return whole.where(F.size("x") == d).mapInArrow(run, schema)
