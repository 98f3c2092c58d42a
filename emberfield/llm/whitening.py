"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Embeddings become integer vectors; each distinct one counts once. Counts and sums are exact, the scatter is summed over
centred rows. With P' L L' P the pivoted factorisation of the scatter, plane rotations from the right make the columns
of L orthogonal; their squared norms are the eigenvalues of the scatter and the normalised columns its eigenvectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.cluster import map_arrow
from emberfield.llm.integers import TOTAL, exact_total, matrices, scaled, written

SCALE = 256
COMPONENTS = 4
SWEEPS = 60
_LONG = 2**63


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with scatter[order][:, order] = L L', L lower trapezoidal of the numerical rank."""
    a = np.array(scatter, dtype=np.float64)
    d = len(a)
    order = np.arange(d)
    least = d * np.finfo(float).eps * max(0.0, a.diagonal().max(initial=0.0))
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return np.tril(a)[:, :k], order
        a[[k, p]], order[[k, p]] = a[[p, k]], order[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        a[k, k] = math.sqrt(a[k, k])
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k])
    return np.tril(a), order


def orthogonal_columns(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal to working precision.

    A sweep meets every pair of columns once, in rounds of disjoint pairs (a round robin), which are rotated together.
    """
    g = np.array(factor, dtype=np.float64)
    r = g.shape[1]
    seats = [*range(r), *([-1] if r % 2 else [])]
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], seats[:half - 1 : -1], strict=True) if a >= 0 and b >= 0]
            p, q = np.array(pairs, dtype=int).T
            alpha, beta, gamma = (g[:, p] ** 2).sum(axis=0), (g[:, q] ** 2).sum(axis=0), (g[:, p] * g[:, q]).sum(axis=0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-16 * size
            worst = max(worst, float(np.max(np.abs(gamma[turn]) / size[turn], initial=0.0)))
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * g[:, p] - c * t * g[:, q], c * t * g[:, p] + c * g[:, q]
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 1e-15:
            break
    return g


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a positive semidefinite matrix, up to its numerical rank."""
    factor, order = pivoted_cholesky(scatter)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(scatter), 0))
    turned = orthogonal_columns(factor)
    norm = np.sqrt((turned**2).sum(axis=0))
    falling = np.argsort(-norm, kind="stable")
    vectors = np.empty_like(turned)
    vectors[order] = turned / norm
    return norm[falling] ** 2, vectors[:, falling]


class Centre:
    """The fit list's count and sums: exact deviations n * x - S, and x - S / n from them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.peak = max((abs(s) for s in sums), default=0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        if self.n * int(np.abs(x).max(initial=0)) + self.peak < _LONG:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> list[int]:
        """Each row's exact sum of squared deviations: in two limbs of 28 bits where 64 bits would not hold it."""
        z = self.deviations(x)
        if z.dtype == object:
            return [int(s) for s in (z * z).sum(axis=1)]
        peak, dims = int(np.abs(z).max(initial=0)), x.shape[1]
        if peak * peak * dims < _LONG:
            return (z * z).sum(axis=1).tolist()
        if peak >= 2**56 or dims >= 2**6 + 1:
            return [int(s) for s in (z.astype(object) ** 2).sum(axis=1)]
        high, low = z >> 28, z & (2**28 - 1)
        terms = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(a << 56) + (b << 29) + c for a, b, c in zip(*(t.tolist() for t in terms), strict=True)]


def _sums(dims: int):
    """A task's exact count (dim -1) and sums per dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * (dims + 1)
        for part, x in matrices(batches):
            wide = int(np.abs(x).max(initial=0)) * len(x) >= _LONG
            sums = (x.astype(object) if wide else x).sum(axis=0)
            totals = [t + int(s) for t, s in zip(totals, [part.num_rows, *sums], strict=True)]
        yield exact_total({"dim": [*range(-1, dims)]}, totals)

    return work


def _products(size: int, columns):
    """A task's sums of products of the columns of ``columns(x)``, as (cell of the upper triangle, value)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in matrices(batches):
            y = columns(x)
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((i * size + j).astype(np.int32)), pa.array(total[i, j])], ["cell", "value"])

    return work


def _scatter(fit: DataFrame, size: int, columns) -> np.ndarray:
    """The summed products as a symmetric matrix; size * (size + 1) / 2 numbers reach the driver."""
    cells = map_arrow(fit, _products(size, columns), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    for r in cells.collect():
        out[divmod(r["cell"], size)] = r["value"]
    return out + np.triu(out, 1).T


def _projected(centre: Centre, basis: np.ndarray, wanted: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches):
            n = part.num_rows
            squares = centre.squares(x)
            white = np.full((n, wanted), np.nan)
            white[:, : basis.shape[1]] = centre.centred(x) @ basis
            ids = part.column(part.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(n), wanted)))
            exact = pa.array([Decimal(s) for s in squares], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(n), wanted)))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), n)), exact, pa.array(flat, mask=np.isnan(flat))], ["vec_id", "component", "deviation", "whitened"])

    return work


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry); the fit list is each distinct x once. Left out are null and empty vectors,
    those with null, non-finite or unscalable entries (2^62 and more scaled), and those of another length than the
    table's most frequent one (the smaller of equally frequent ones), since one covariance needs one length. Repeated
    rows are returned each but fitted once; null ids are kept. Components beyond the covariance's numerical rank have
    explained 0 (null where all x are equal) and a null whitened; of equal eigenvalues any basis may come. A deviation
    beyond a long is null and can be read from deviation_exact. An empty table gives an empty table.

    Numbers on the driver: sums, scatter and components of the dimensions, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, scale, vec_id, vector)
    usual = rows.groupBy(F.size("x").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return spark.createDataFrame([], f"vec_id long, component int, n long, deviation long, deviation_exact {TOTAL}, whitened double, explained double, identity_error double")
    dims = usual["dims"]
    rows = written(rows.filter(F.size("x") == dims), "whitening")
    fit = written(rows.select("x").distinct(), "whitening-fit")
    totals = map_arrow(fit, _sums(dims), f"dim int, total {TOTAL}").groupBy("dim").agg(F.sum("total").alias("total"))
    total = {r["dim"]: int(r["total"]) for r in totals.collect()}
    n = total[-1]
    centre = Centre(n, [total[d] for d in range(dims)])
    scatter = _scatter(fit, dims, centre.centred)
    values, basis = eigen(scatter)
    wanted = min(components, dims)
    kept = min(wanted, len(values))
    basis = basis[:, :kept] / np.sqrt(values[:kept] / n)
    trace = float(np.trace(scatter))
    shares = [float(v) / trace for v in values[:kept]] + [0.0 if trace else None] * (wanted - kept)
    error = None
    if kept:
        error = float(np.abs(_scatter(fit, kept, lambda x: centre.centred(x) @ basis) / n - np.eye(kept)).max())
    out = map_arrow(rows, _projected(centre, basis, wanted), f"vec_id long, component int, deviation {TOTAL}, whitened double")
    return out.select(
        "vec_id",
        "component",
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        F.col("deviation").alias("deviation_exact"),
        "whitened",
        F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
