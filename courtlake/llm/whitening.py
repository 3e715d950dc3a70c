"""Whitening components of integer vectors by shifted CholeskyQR.

The rows, centred, are orthogonalised without ever meeting in one place: a pass adds up the Gram matrix of the rows as they
stand, its Cholesky factor R becomes one more triangular solve that each task applies to its own rows, and the next pass
measures what is left. The first factor is of a shifted Gram matrix, so that it exists however ill-conditioned the rows are;
later ones are shifted only by rounding, and only where directions are still missing. Passes end when the Gram matrix
is the identity on all directions that the rows have. The product of the factors is the R of the centred rows; its singular
values and right singular vectors are those of the rows, without their squares ever being taken apart.

The driver holds matrices of the vectors' dimension only. A task holds one batch of rows and one such matrix; tasks'
matrices are added up row by row of the matrix, in two steps, so no task meets all of them.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is left out, and so is one whose length is not the most
frequent one (ties: the longest); equal vectors count once for the fit and give a row each in the result; a null id is an id like any
other; entries beyond the range of long are cut to it; fewer directions than asked for give fewer components, no vector or one distinct vector none;
a deviation beyond 38 digits is null; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SALTS = 64              # groups in which the tasks' rows of a Gram matrix are added up first
MOST_PASSES = 8
LEVEL = 256             # of an entry: x = floor(LEVEL * c)
_EPS = float(np.finfo(np.float64).eps)
_EXACT = 1 << 52


@dataclass(frozen=True)
class Model:
    n: int                      # distinct vectors
    sums: tuple[int, ...]       # of their entries, by dimension
    components: np.ndarray      # unit rows, by falling eigenvalue, only of directions that the vectors have
    eigenvalues: np.ndarray
    trace: float
    passes: int


def usable(vec: Column) -> Column:
    broken = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~broken


def integers(vec: Column) -> Column:
    return F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(LEVEL))) + F.lit(0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n: the whole part is taken off exactly, the fraction in double."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    part = np.array([r / n for r in rest])
    small = len(x) == 0 or max(abs(int(x.min())), abs(int(x.max())), *map(abs, whole)) < _EXACT
    left = (x - np.array(whole, np.int64)).astype(np.float64) if small else x.astype(np.float64) - np.array(whole, np.float64)
    return left - part


def solve_upper(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _total(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices, given as rows ``i, part, line``."""

    def add(by: list[str]):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("part")                        # one order of summation, however the rows arrive
            lines = np.frombuffer(b"".join(group.column("line").to_pylist()), np.float64).reshape(-1, width)
            return pa.table({"i": group.column("i")[:1], "part": pa.array([group.column("part")[0].as_py()], pa.int64()), "line": pa.array([lines.sum(0).tobytes()], pa.binary())})

        return lambda d: d.groupBy(*by).applyInArrow(run, "i int, part long, line binary")

    salted = add(["i", "salt"])(parts.withColumn("salt", F.pmod("part", F.lit(SALTS))))
    rows = add(["i"])(salted).select("i", "line").collect()      # as many as the matrix has
    out = np.zeros((max((r.i for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r.i] = np.frombuffer(r.line, np.float64)
    return out


def _gram(fit: DataFrame, n: int, sums: tuple[int, ...], transform, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                q = transform(_centred(_matrix(batch.column(0)), n, sums))
                g += q.T @ q
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([part] * width, pa.int64()), pa.array([row.tobytes() for row in g], pa.binary())], ["i", "part", "line"])

    return _total(fit.mapInArrow(run, "i int, part long, line binary"), width)


def _sums(fit: DataFrame, d: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums of their entries, added in halves so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], ["i", "high", "low", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = fit.mapInArrow(run, "i int, high long, low long, n long").groupBy("i").agg(exact("high"), exact("low"), F.sum("n").alias("n")).orderBy("i").collect()
    return (rows[0].n, tuple((int(r.high) << 32) + int(r.low) for r in rows)) if rows and rows[0].n else (0, ())


def fit_list(rows: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """Stored: each distinct integer vector ``x`` once; and their length."""
    x = rows.where(usable(F.col(vec_col))).select(integers(F.col(vec_col)).alias("x"))
    most = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return stored(x.where(F.size("x") == d).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit"), d


def fit(vectors: DataFrame, d: int) -> Model:
    """The components of a stored list of distinct integer vectors."""
    n, sums = _sums(vectors, d)
    if not n:
        return Model(0, (), np.zeros((0, d)), np.zeros(0), 0.0, 0)
    factors: list[np.ndarray] = []

    def orthogonalised(a: np.ndarray) -> np.ndarray:
        for r in factors:
            a = solve_upper(a, r)
        return a

    whole = np.eye(d)
    for step in range(MOST_PASSES):
        g = _gram(vectors, n, sums, orthogonalised, d)
        values = np.linalg.eigvalsh(g)
        top = float(values[-1])
        if top <= 0 or step and bool(np.all((np.abs(values - 1) < 1e-12 * d) | (values < 1e-8))):
            break
        if step == 0:
            shift = 11 * (n * d + d * (d + 1)) * _EPS * top
        else:
            shift = 0.0 if values[0] > 1e-3 else 11 * d * (d + 1) * _EPS * top
        r = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors.append(r)
        whole = r @ whole
    if not factors:
        return Model(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, 0)
    _, s, vt = np.linalg.svd(whole)
    found = int((s > s[0] * 64 * d * _EPS).sum())
    return Model(n, sums, vt[:found], s[:found] ** 2 / n, float((s**2).sum() / n), len(factors))


def _weights(model: Model, k: int) -> np.ndarray:
    return (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T


def identity_error(vectors: DataFrame, model: Model, k: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity: one more pass."""
    k = min(k, len(model.eigenvalues))
    if not k:
        return 0.0
    w = _weights(model, k)
    return float(np.abs(_gram(vectors, model.n, model.sums, lambda a: a @ w, k) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, model: Model, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, deviation, whitened`` of every usable row: the exact sum of (n * x - sums)^2 and up to ``k`` whitened values."""
    d, kind = len(model.sums), rows.schema[id_col].dataType.simpleString()
    w, n, sums = _weights(model, k), model.n, model.sums
    squares, most = sum(s * s for s in sums), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, d), np.int64)
            high = max(abs(int(x.min())), abs(int(x.max()))) if len(x) else 0
            y = x if high * max(high, *map(abs, sums)) * d < 1 << 62 else x.astype(object)
            own, cross = (y * y).sum(1).tolist(), (y @ np.array(sums, y.dtype)).tolist()
            exact = [n * n * a - 2 * n * b + squares for a, b in zip(own, cross)]
            values = _centred(x, n, sums) @ w
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([Decimal(v) if v < most else None for v in exact], pa.decimal128(38, 0)), pa.array(list(values), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    x = rows.where(usable(F.col(vec_col)) & (F.size(vec_col) == d)).select(id_col, integers(F.col(vec_col)).alias("x"))
    return x.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")
