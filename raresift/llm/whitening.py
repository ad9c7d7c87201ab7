"""Whitening of embeddings by polarisation: covariances are differences of exact variances of dimensions and of sums of two dimensions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096  # rows handled together
LARGEST = 1 << 40  # scaled entries beyond are an error, so that whole numbers stay exact


@dataclass
class Fit:
    """n, per-dimension sums, n^2 times the covariance (whole numbers), eigenvalues falling, unit eigenvectors as columns."""

    n: int
    sums: list[int]
    moments: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return np.array([[x / (self.n * self.n) for x in row] for row in self.moments])

    @property
    def trace(self) -> float:
        return sum(self.moments[i][i] for i in range(len(self.sums))) / (self.n * self.n)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is there and holds finite numbers only; vectors without entries have no component and go too."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)


def _whole(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """Rows of the list column as whole numbers floor(scale * c) + shift."""
    width = len(column[0])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError("vectors differ in length")
    scaled = np.floor(scale * flat)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"an entry times {scale} is beyond 2^40")
    return scaled.astype(np.int64).reshape(len(column), width) + shift


def _blocks(batches, scale: int, shift: int):
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            part = batch.slice(i, BLOCK)
            if len(part):
                yield part, _whole(part.column("vector"), scale, shift)


def _exact(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(38,0)"))


def _sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""
    def run(batches):
        total, n = None, 0
        for _, x in _blocks(batches, scale, shift):
            total = [0] * x.shape[1] if total is None else total
            if len(total) != x.shape[1]:
                raise ValueError("vectors differ in length")
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), pa.array([str(t) for t in total])],
                                             names=["i", "n", "total"])

    found = rows.select("vector").mapInArrow(run, "i int, n long, total string").groupBy("i").agg(F.sum("n").alias("n"), _exact("total").alias("total"))
    found = sorted(found.collect(), key=lambda r: r.i)  # a row per dimension
    if len({r.n for r in found}) > 1:
        raise ValueError("vectors differ in length")
    return (found[0].n if found else 0), [int(r.total) for r in found]


def squares(rows: DataFrame, centre: list[int], scale: int, shift: int) -> DataFrame:
    """(i, j, total), i <= j: the exact sum of (y_i + y_j)^2 over all rows, and of y_i^2 for i = j, where y = x - centre.

    A task adds up a block of rows in 64-bit numbers, or in Python's where they could overflow, and sends d * (d + 1) / 2 sums, whatever its rows.
    """
    d = len(centre)

    def run(batches):
        total = [[0] * (d - i) for i in range(d)]
        some = False
        for _, x in _blocks(batches, scale, shift):
            some = True
            y = x - np.array(centre, np.int64)
            largest = int(np.abs(y).max())
            if 4 * largest * largest * len(y) >= 1 << 63:
                y = y.astype(object)
            for i in range(d):
                pair = y[:, i:] + y[:, i:i + 1]
                pair[:, 0] = y[:, i]
                total[i] = [a + int(b) for a, b in zip(total[i], (pair * pair).sum(axis=0))]
        if some:
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array([str(t) for t in total[i]])],
                                                 names=["i", "j", "total"])

    return rows.select("vector").mapInArrow(run, "i int, j int, total string").groupBy("i", "j").agg(_exact("total").alias("total"))


def fit(rows: DataFrame, scale: int = 64, shift: int = 1_000_000) -> Fit | None:
    """Exact covariance by polarisation, cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, and its eigenvectors; None without rows.

    Values are centred before they are squared, by the whole number next to the mean; what that is off the mean is taken out exactly in
    Python's whole numbers. d * (d + 1) / 2 sums reach the driver, whatever the rows.
    """
    n, sums = _sums(rows, scale, shift)
    if not n:
        return None
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]  # sums of y
    found = {(r.i, r.j): int(r.total) for r in squares(rows, centre, scale, shift).collect()}
    # n^2 times the variance of a sum of values y is n * sum of squares - square of their sum
    var = [n * found[i, i] - rest[i] ** 2 for i in range(d)]
    moments = [[0] * d for _ in range(d)]
    for i in range(d):
        moments[i][i] = var[i]
        for j in range(i + 1, d):
            both = n * found[i, j] - (rest[i] + rest[j]) ** 2
            moments[i][j] = moments[j][i] = (both - var[i] - var[j]) // 2  # even: the same products counted twice
    out = Fit(n, sums, moments, np.zeros(0), np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(out.covariance)
    out.values, out.vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    low = out.vectors[np.abs(out.vectors).argmax(axis=0), np.arange(d)] < 0
    out.vectors[:, low] *= -1  # the entry of largest size is positive
    return out


def components(found: Fit, most: int, tiny: float = 1e-10) -> int:
    """Number of components to project on: ``most`` at most, none whose eigenvalue is beyond what doubles can tell from 0."""
    return int(min(most, (found.values > tiny * max(found.values[0], 0.0)).sum())) if found.values[0] > 0 else 0


def _project(x: np.ndarray, found: tuple) -> np.ndarray:
    n, sums, matrix = found
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return ((x - centre).astype(np.float64) - rest) @ matrix


def identity_error(rows: DataFrame, found: Fit, k: int, scale: int = 64, shift: int = 1_000_000) -> float:
    """Largest absolute entry of the projections' covariance minus the identity, measured over all rows."""
    small = (found.n, found.sums, found.vectors[:, :k] / np.sqrt(found.values[:k]))

    def run(batches):
        products, total = np.zeros((k, k)), np.zeros(k)
        for _, x in _blocks(batches, scale, shift):
            z = _project(x, small)
            products += z.T @ z
            total += z.sum(axis=0)
        names = [f"{i},{j}" for i in range(k) for j in range(i, k)] + [f"{i}" for i in range(k)]
        values = [products[i, j] for i in range(k) for j in range(i, k)] + total.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values)], names=["name", "v"])

    sums = {r.name: r.v for r in rows.select("vector").mapInArrow(run, "name string, v double").groupBy("name").agg(F.sum("v").alias("v")).collect()}
    n, worst = found.n, 0.0
    for i in range(k):
        for j in range(i, k):
            worst = max(worst, abs(sums[f"{i},{j}"] / n - sums[f"{i}"] / n * (sums[f"{j}"] / n) - (i == j)))
    return worst


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, most: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row and component up to ``most``: vec_id, component (from 1 by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Entries become the whole numbers x = floor(scale * c) + shift. ``deviation`` is the sum over dimensions of (n * x - sum)^2, exact; ``whitened`` the
    centred row projected on the unit eigenvector, over the root of the eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error``
    one measured value. Four scans of the vectors, no shuffle of them: only d * (d + 1) / 2 sums a task are shuffled, and a d x ``most`` matrix goes out.

    Rows with a null vector, or one with null or non-finite entries, are dropped, and vectors without entries have no component; null ids stay; repeated
    rows count each; an eigenvalue under 1e-10 of the largest gives no component, so equal vectors throughout, like an empty table, give no row; among equal
    eigenvalues the order is the solver's. Vectors of different length, or an entry beyond 2^40 after scaling, are an error. Other columns are ignored.
    """
    rows = usable(df, id_col, vector_col)
    found = fit(rows, scale, shift)
    k = components(found, most) if found else 0
    if not k:
        return df.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, found, k, scale, shift)
    small = (found.n, found.sums, found.vectors[:, :k] / np.sqrt(found.values[:k]))
    n, sums = found.n, found.sums
    explained = (found.values[:k] / found.trace).tolist()

    def run(batches):
        from decimal import Decimal

        for part, x in _blocks(batches, scale, shift):
            z = _project(x, small)
            # (n x - s)^2 in whole numbers: n x - s = n (x - c) - (s - n c), c next to the mean
            centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
            rest = [s - n * int(c) for s, c in zip(sums, centre)]
            y = x - centre
            largest = n * int(np.abs(y).max(initial=0)) + n
            kind = np.int64 if largest * largest * len(sums) < 1 << 63 else object
            dev = n * y.astype(kind) - np.array(rest, kind)
            dev = (dev * dev).sum(axis=1)
            exact = pa.array([Decimal(int(v)) for v in dev], pa.decimal128(38, 0))
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                 exact.take(row), pa.array(z.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
