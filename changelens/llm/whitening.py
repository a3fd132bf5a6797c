"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Spark sums the vectors, then the products of the centred vectors: what reaches the driver is one matrix of dim x dim, whatever the number of rows.
There P'CP = LL' is factored with the largest remaining diagonal as pivot, and L's columns are rotated in pairs until all are orthogonal.
Their squared norms are then the eigenvalues of C and their directions its eigenvectors; C itself is never multiplied again, so small eigenvalues keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import cut

#: x = floor(SCALE * c) + SHIFT, with SCALE * c held within what a double counts exactly.
SCALE, SHIFT, WIDEST = 64, 1_000_000, 2.0**52
#: Vectors handled together in a task.
ROWS = 4096


def pivoted_cholesky(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): L has a column for each pivot above rounding and L L' is c[order][:, order].

    Columns end where the largest remaining diagonal is below dim x 2^-52 of the first one.
    """
    dim = len(c)
    order, left = np.arange(dim), c.diagonal().astype(float).copy()
    factor = np.zeros((dim, dim))
    stop = dim * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(dim):
        best = k + int(left[order[k:]].argmax())
        if left[order[best]] <= stop:
            return factor[:, :k], order
        order[[k, best]] = order[[best, k]]
        factor[[k, best]] = factor[[best, k]]
        factor[k, k] = math.sqrt(left[order[k]])
        rest = order[k + 1 :]
        factor[k + 1 :, k] = (c[rest, order[k]] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[rest] -= factor[k + 1 :, k] ** 2
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` times an orthogonal matrix so that its columns are orthogonal to double precision (Hestenes; cyclic, the longer column first)."""
    a = np.array(factor, float, order="F")
    small = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p in range(a.shape[1] - 1):
            for q in range(p + 1, a.shape[1]):
                x, y = a[:, p], a[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= small * math.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = math.copysign(1.0, zeta) / (abs(zeta) + math.hypot(1.0, zeta))
                cos = 1 / math.hypot(1.0, t)
                a[:, p], a[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            break
    return a


def eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a positive semidefinite matrix; as many as its rank.  The largest entry of each is positive."""
    factor, order = pivoted_cholesky(c)
    turned = jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned / norms
    vectors, norms = vectors[:, by_size], norms[by_size]
    if vectors.shape[1]:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return norms**2, vectors


@dataclass
class Whitening:
    """What the fit list says: n vectors, per-dimension sums S, eigenvalues of the covariance (falling), components as columns, its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without rounding x first: whole numbers are subtracted, then a part below 1."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(float) - np.array([(s % self.n) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null above a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        if (float(np.abs(near).max(initial=0)) + 1) ** 2 * float(self.n) ** 2 * max(1, x.shape[1]) < 2.0**62:
            return ((self.n * near - rest) ** 2).sum(axis=1).tolist()
        told = [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in near]
        return [t if t < 2**63 else None for t in told]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows of the fit list."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = F.transform("v", lambda c: (F.greatest(F.least(F.floor(c * SCALE).cast("double"), F.lit(WIDEST)), F.lit(-WIDEST)).cast("long") + SHIFT))
    rows = rows.select("id", x.alias("x"))
    dims = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return cut(rows.where(F.size("x") == (dims["dim"] if dims else 0)))


def _taken(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield np.asarray(part.column(column).flatten()).reshape(part.num_rows, -1)


def _summed(rows: DataFrame, task, size: int) -> np.ndarray:
    """The sum of the square matrices of `size` that the tasks make, line by line; only that sum reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for x in _taken(batches, 0):
            y = task(x)
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size, dtype=np.int32), size)), pa.array(np.tile(np.arange(size, dtype=np.int32), size)), pa.array(total.ravel())], ["i", "j", "v"])

    got = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return (out + out.T) / 2


def _fit(rows: DataFrame) -> Whitening | None:
    counted = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not counted:
        return None
    start = Whitening(counted[0]["n"], [int(r["s"]) for r in counted], np.zeros(0), np.zeros((0, 0)), 0.0)
    scatter = _summed(rows, start.centred, len(counted))
    values, components = eigen(scatter)
    return Whitening(start.n, start.sums, values / start.n, components, float(np.trace(scatter)) / start.n)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable rows; None without any."""
    return _fit(_usable(vectors, id_col, vector_col))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, the first `components` of them.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; so are vectors of another length than most rows have (of
    equally frequent lengths the larger counts).  Entries beyond 2^52 / 64 count as that.  Repeated rows and equal ids each keep their rows, a row without an id
    too.  Components of eigenvalue zero, as far as doubles tell, are left out: of a single vector, or of equal ones, nothing comes back, as of an empty table.
    Equal eigenvalues leave their components in one space, any basis of which is right.  Columns beside the two named are not read.
    """
    rows = _usable(vectors, id_col, vector_col)
    model = _fit(rows)
    shape = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], shape)
    kept = min(components, len(model.values))
    explained = (model.values[:kept] / model.trace).tolist()
    model = Whitening(model.n, model.sums, model.values[:kept], model.components[:, :kept], model.trace)
    # centred already, so that the mean of the products is the covariance
    error = float(np.abs(_summed(rows, model.whiten, kept) / model.n - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                y = model.whiten(x)
                ends = pa.array(np.arange(0, y.size + 1, kept, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["id", "deviation", "y"])

    told = rows.mapInArrow(run, "id long, deviation long, y array<double>").select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(v) for v in explained]), F.col("at") + 1)
    return told.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       share.alias("explained"), F.lit(error).alias("identity_error"))
