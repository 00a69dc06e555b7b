"""Whitening of embeddings by the cyclic Jacobi method.

Vectors become whole numbers (see ``vectors``).  The fit list holds each distinct vector once.  One distributed pass
over it gives the exact sums, a second the scatter matrix of the centred vectors: each task sends on one
matrix of sums, ``dim x dim`` numbers whatever its rows.  The driver then rotates pairs of rows and columns, round
after round through all pairs, until every off-diagonal entry is negligible beside its own two diagonal
entries; that relative bound keeps small eigenvalues accurate.  Components are sorted by falling
eigenvalue, the sign makes the largest weight positive, and the whitening matrix is broadcast
(``dim x components`` numbers).  A last pass over the fit list measures the covariance of the whitened vectors.

``n x - S`` and its squares are whole numbers, exact at any size (beyond 64 bits by Python's integers); a
``deviation`` that doesn't fit a long is null.

Edge cases: vectors as in ``vectors``; a component without variance whitens to 0 and explains 0, and is
left out of the identity's error, which is 0 where nothing is left; repeated and null ids keep a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import scaled, unpacked

#: Partial sums come from this many tasks at most.
MOST_PARTIALS = 1024


def pairs_by_turns(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below ``size`` in rounds whose pairs are disjoint, as a tournament is drawn up."""
    seats = list(range(size + size % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        drawn = [(min(a, b), max(a, b)) for a, b in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :])) if max(a, b) < size]
        rounds.append(tuple(np.array(x, int) for x in zip(*drawn)))
        seats[1:] = [seats[-1], *seats[1:-1]]
    return rounds


def jacobi(matrix: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix that has no negative eigenvalue."""
    a, size = (matrix + matrix.T) / 2, len(matrix)
    vectors = np.eye(size)
    rounds = pairs_by_turns(size) if size > 1 else []
    floor = np.finfo(float).eps ** 2 * np.abs(np.diag(a)).max(initial=0)  # where a variance is zero, the relative bound would be too
    for _ in range(sweeps):
        rotated = False
        for p, q in rounds:
            off = a[p, q]
            diagonal = np.abs(a[p, p] * a[q, q])
            go = np.abs(off) > np.maximum(tolerance * np.sqrt(diagonal), floor)
            if not go.any():
                continue
            rotated = True
            p, q, off = p[go], q[go], off[go]
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            app, aqq = a[p, p] - t * off, a[q, q] + t * off
            for m, by in ((a, 0), (a, 1), (vectors, 1)):
                view = m.T if by else m
                x, y = view[p].copy(), view[q].copy()
                view[p], view[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
        if not rotated:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)]) if size else np.empty(0)
    return values, vectors * np.where(signs == 0, 1, signs)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: ``n`` vectors with sums ``total``, eigenvalues (all) and the matrix of the first components."""

    n: int
    total: np.ndarray
    values: np.ndarray
    matrix: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S`` in whole numbers: 64 bits where they are sure to hold it, else Python's."""
        bound = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.total).max(initial=0))
        kind = np.int64 if bound < 1 << 62 else object
        return x.astype(kind) * self.n - self.total.astype(kind)

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of a vector's squared deviations, exactly; None where a long can't hold it."""
        y = self.deviations(x)
        with np.errstate(over="ignore"):
            out = list((y * y).sum(axis=1)) if x.shape[1] else [0] * len(x)
        for i in np.flatnonzero((y.astype(float) ** 2).sum(axis=1) > float(1 << 62)):
            out[i] = sum(int(v) ** 2 for v in y[i])
        return [int(v) if v < 1 << 63 else None for v in out]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float) @ self.matrix

    @property
    def live(self) -> np.ndarray:
        """Which of the matrix's components have any variance."""
        return (self.matrix != 0).any(axis=0)


def _summed(fit: DataFrame, dim: int, of, shape: tuple[int, int], kind: type) -> np.ndarray:
    """The sum over all vectors of the matrix that ``of`` makes of a batch of them.

    A task sends on its matrix row by row, and the rows of one place are added up together, ``MOST_PARTIALS`` at most; in order
    of size, so that it doesn't matter which came first.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            total += of(unpacked(b.column("__x"), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["place", "s"])

    def added(rows: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(rows.column("s").to_pylist()), kind).reshape(len(rows), shape[1])
        return pa.table({"place": rows.column("place").slice(0, 1), "s": pa.array([np.sort(values, axis=0).sum(axis=0).tobytes()], pa.binary())})

    schema = "place long, s binary"
    sums = fit.coalesce(MOST_PARTIALS).mapInArrow(partial, schema).groupBy("place").applyInArrow(added, schema)
    out = np.zeros(shape, kind)
    for r in sums.collect():  # one matrix
        out[r["place"]] = np.frombuffer(bytes(r["s"]), kind)
    return out


def fit_whitening(fit: DataFrame, dim: int, components: int) -> tuple[Whitening, float]:
    """The whitening of the distinct vectors ``fit(__x)`` and the largest entry by which their whitened covariance differs from the identity."""
    sums = _summed(fit, dim, lambda x: np.append(x.sum(axis=0), len(x))[None, :], (1, dim + 1), np.int64)[0]
    n, total = int(sums[-1]), sums[:-1]
    if not n:
        return Whitening(0, total, np.zeros(dim), np.zeros((dim, min(components, dim)))), 0.0
    centred = Whitening(n, total, np.zeros(dim), np.eye(dim)).apply

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    values, vectors = jacobi(_summed(fit, dim, scatter, (dim, dim), np.float64) / n)
    kept = min(components, dim)
    live = values[:kept] > np.finfo(float).eps * dim * values.max(initial=0)
    matrix = np.where(live, vectors[:, :kept] / np.sqrt(np.where(live, values[:kept], 1)), 0.0)
    made = Whitening(n, total, values, matrix)

    def moments(x: np.ndarray) -> np.ndarray:
        y = np.column_stack([made.apply(x), np.ones(len(x))])
        return y.T @ y

    second = _summed(fit, dim, moments, (kept + 1, kept + 1), np.float64) / n
    mean = second[-1, :-1]  # the matrix is applied to centred vectors, so this is rounding only
    covariance = second[:-1, :-1] - np.outer(mean, mean)
    error = np.abs(covariance - np.eye(kept))[np.ix_(made.live, made.live)]
    return made, float(error.max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, a row for each vector and component."""
    spark = vectors.sparkSession
    rows, dim = scaled(vectors.select(id_col, vector_col), vector_col, (id_col,))
    schema = rows.drop("__x").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    made, error = fit_whitening(cut(rows.select("__x").distinct()), dim, components)
    if not made.n:
        return spark.createDataFrame([], schema)
    kept, trace = made.matrix.shape[1], float(made.values.sum())
    explained = np.where(made.live, made.values[:kept] / (trace or 1.0), 0.0)
    shared = spark.sparkContext.broadcast(made)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x = unpacked(b.column("__x"), dim)
            deviation = pa.array(own.squares(x), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), kept))
            number = np.tile(np.arange(kept), len(x))
            columns = [b.column(id_col).take(each), pa.array(number + 1, pa.int32()), pa.array(np.full(len(each), own.n)), deviation.take(each)]
            columns += [pa.array(own.apply(x).reshape(-1)), pa.array(explained[number]), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(apply, schema)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "embeddings")
    return whiten(docs.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
