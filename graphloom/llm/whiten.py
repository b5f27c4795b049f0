"""Whitening by the leading eigenvectors of the covariance, found by LOBPCG.

Vectors become whole numbers x = floor(64 c) + 1000000.  Their count and sums are exact.  One
pass over the rows multiplies the covariance with a block of directions, row by row as
centred row times its projection: the covariance itself is never built.  Each round makes the
Rayleigh-Ritz step on the span of iterate, residuals and previous directions, until the
residuals of all wanted pairs are certified; then rows are projected and scaled.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry go; so do
those of another length than most have (of equally many the shortest), and those with an entry
beyond 2**46; a null id is kept, and repeated rows count as often as they occur; components without
variance (of constant dimensions, or more than there are rows) have no rows, so equal vectors
alone give an empty result, as an empty table does; a deviation beyond 64 bits is null; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..partitions import spread

COMPONENTS = 32
GUARD = 8  # directions iterated beside the wanted ones
SCALE, SHIFT, MOST_ENTRY = 64.0, 1_000_000, float(1 << 46)
RESIDUAL = 1e-13  # of the trace: a pair is certified below it
MOST_ROUNDS = 500
FLAT = 1e-12  # of the trace: less variance is none
ROWS = 4096  # multiplied at once
SHORT = 1 << 24  # half-words of sums


def usable(vectors: pa.Array, dims: int) -> np.ndarray:
    """Which vectors are taken."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(good)).flatten()
    values = np.abs(pc.fill_null(pc.cast(flat, pa.float64()), np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dims)
    return good[(values <= MOST_ENTRY).all(axis=1)]


def whole_numbers(vectors: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    flat = vectors.take(pa.array(rows)).flatten()
    c = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


class Fit(NamedTuple):
    """Count and exact sums; the whole and the broken part of each mean."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    fraction: np.ndarray

    @classmethod
    def of(cls, n: int, sums: tuple[int, ...]) -> Fit:
        return cls(n, sums, np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) - self.fraction


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, taken rows, their whole numbers), ROWS at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            rows = usable(part.column(1), dims)
            if len(rows):
                yield part, rows, whole_numbers(part.column(1), rows, dims)


def fit(vectors: DataFrame, dims: int) -> Fit | None:
    """Counts and sums as half-words, which Spark adds as decimals: exact for any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, x in blocks(batches, dims):
            high = (x // SHORT).sum(axis=0)
            low = (x % SHORT).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, len(rows))), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "dim long, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = sorted(parts.groupBy("dim").agg(*(exact(c) for c in ("n", "high", "low"))).collect())  # a row a dimension
    if not found:
        return None
    return Fit.of(int(found[0].n), tuple(int(r.high) * SHORT + int(r.low) for r in found))


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial matrices, one a task, entry by entry on Spark; what comes back has the size of one."""
    out = np.zeros(shape[0] * shape[1])
    total = parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    for at, x in total.collect():
        out[at] = x
    return out.reshape(shape)


def covariance_times(vectors: DataFrame, own: Fit, directions: np.ndarray) -> np.ndarray:
    """V B for a block B of directions, as the sum of (row (row B)) over centred rows, by n."""
    shared = vectors.sparkSession.sparkContext.broadcast((own, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = shared.value
        total = np.zeros(block.shape)
        for _, _, x in blocks(batches, len(block)):
            y = known.centred(x)
            total += y.T @ (y @ block)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    return _added(vectors.mapInArrow(run, "part array<double>"), directions.shape) / own.n


def trace(vectors: DataFrame, own: Fit) -> float:
    dims = len(own.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float((own.centred(x) ** 2).sum()) for _, _, x in blocks(batches, dims))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], ["part"])

    return vectors.mapInArrow(run, "part double").agg(F.sum("part")).first()[0] / own.n


def independent(*directions: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the span; later directions lose what earlier ones have, and go if nothing is left."""
    basis = np.empty((len(directions[0]), 0))
    for block in directions:
        for _ in range(2):  # twice is enough
            block = block - basis @ (basis.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 1e-300] / size[size > 1e-300]
            if not block.shape[1]:
                break
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-10 * s[0]]
        basis = np.hstack([basis, block])[:, : len(basis)]
    return basis


def lobpcg(times, dims: int, wanted: int, total: float, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual) of the ``wanted`` greatest eigenpairs; ``times`` gives V B.

    Every round multiplies one orthonormal basis of at most three blocks.  Raises if residuals are
    not certified within ``most_rounds``.
    """
    width = min(dims, wanted + GUARD)
    basis = independent(np.random.default_rng(0).standard_normal((dims, width)))
    previous = np.empty((dims, 0))
    for _ in range(most_rounds):
        product = times(basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        vectors, image = basis @ turn, product @ turn
        residual = image - vectors * values
        worst = float(np.linalg.norm(residual[:, :wanted], axis=0).max())
        if worst <= RESIDUAL * total:
            return values[:wanted], vectors[:, :wanted], worst
        turn[:width] = 0  # what the step added from beyond the last iterate
        previous = basis @ turn
        basis = independent(vectors, residual, previous)
    raise ArithmeticError(f"residual {worst} of trace {total} after {most_rounds} rounds")


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def deviations(x: np.ndarray, own: Fit) -> list[int | None]:
    """Sum of (n x - S)**2 of each row, exact; None beyond 64 bits."""
    rest = [s % own.n for s in own.sums]
    y = x - own.mean
    if len(y) and (int(np.abs(y).max()) + 1) ** 2 * own.n**2 * x.shape[1] < 1 << 63:
        return ((y * own.n - np.array(rest)) ** 2).sum(axis=1).tolist()
    exact = [sum((own.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row a vector and component.

    The driver holds the directions alone, dims by three blocks; sums of tasks are added on Spark.
    Every pass is a map over the stored rows, so a lost executor costs a re-read.
    """
    spark = rows.sparkSession
    source = spread(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector")))
    empty = spark.createDataFrame([], SCHEMA + ", identity_error double")
    clean = source.where(F.size("vector") > 0).where(~F.exists("vector", lambda c: c.isNull() | ~(F.abs(c) <= MOST_ENTRY)))
    common = clean.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return empty
    dims = common.dims
    own = fit(source, dims)
    total = trace(source, own)
    if not total:
        return empty
    values, vectors, _ = lobpcg(lambda b: covariance_times(source, own, b), dims, min(dims, components), total)
    varied = values > FLAT * total
    values, vectors = values[varied], vectors[:, varied]
    k = len(values)
    shared = spark.sparkContext.broadcast((own, vectors / np.sqrt(values)))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scaled = shared.value
        both = np.zeros((k + 1, k))
        for _, _, x in blocks(batches, dims):
            w = known.centred(x) @ scaled
            both[:k] += w.T @ w
            both[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([both.ravel()], pa.list_(pa.float64()))], ["part"])

    both = _added(source.mapInArrow(moments, "part array<double>"), (k + 1, k)) / own.n
    error = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())
    explained = values / total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scaled = shared.value
        for part, taken, x in blocks(batches, dims):
            w = known.centred(x) @ scaled
            m = len(taken)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(taken, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, known.n)),
                pa.array(deviations(x, known), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return source.mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(error))
