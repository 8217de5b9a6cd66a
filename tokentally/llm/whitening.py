"""Operator 11: whitening of vectors by the eigenvectors of their covariance, refined in mixed precision.

1. Every entry c becomes the whole number x = floor(64 * c) + 1000000. Sums of x are exact.
2. The covariance is added up by tasks from centred vectors: n * x - S is a whole number, so centring
   loses nothing, whatever the offset. What reaches the driver are matrices of dimension x dimension.
3. Eigenvectors are computed in 32 bits and then corrected by iterations of matrix products only (Ogita
   and Aishima): from the departures of X'X from the identity and of X'AX from a diagonal follows a
   correction E, and X + XE is about twice as exact. First in 64 bits, then in extended precision.
   Where eigenvalues are closer than the present error, E cannot tell their vectors apart: these
   clusters are solved by themselves, as small eigenproblems within the space they span.
4. Each vector's components are its centred entries projected on the eigenvectors, over the root of
   the eigenvalue. How far their covariance is from the identity is measured on all of them.

Vectors are read from the source in each of the four passes; nothing of their size is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .vectors import finite_by_width, finite_vectors, summed

COMPONENTS = 32
STEPS = 64
OFFSET = 1_000_000
#: Vectors with an entry beyond this are taken as non-finite.
LARGEST = 2.0**25
#: Vectors handled at once.
ROWS = 4096
#: Refinements at most; three or four are the rule.
ITERATIONS = 12
#: Departures, against the largest eigenvalue, at which the vectors are exact in double precision.
EXACT = 2.0**-56
#: Eigenvalues closer than this, against the largest, are always solved as a cluster: the rounding of the
#: products, divided by such a gap, would be too large a correction.
CLOSE = 2.0**-30


def whole(matrix: np.ndarray) -> np.ndarray:
    """x of each entry."""
    return np.floor(STEPS * matrix).astype(np.int64) + OFFSET


def _usable(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x-vectors) of a column, so many at once."""
    for first in range(0, len(column), ROWS):
        rows, matrix = finite_vectors(column.slice(first, ROWS), width)
        near = (np.abs(matrix) <= LARGEST).all(axis=1)
        if near.any():
            yield rows[near] + first, whole(matrix[near])


def _solved(symmetric: np.ndarray) -> np.ndarray:
    """Eigenvectors of a small matrix: found in 64 bits, orthogonal in the precision of the matrix."""
    scale = np.abs(symmetric).max()
    if not scale:
        return np.eye(len(symmetric), dtype=symmetric.dtype)
    turn = np.linalg.eigh(((symmetric + symmetric.T) / (2 * scale)).astype(np.float64))[1].astype(symmetric.dtype)
    return turn + turn @ (np.eye(len(turn), dtype=turn.dtype) - turn.T @ turn) / 2


def _clusters(values: np.ndarray, distance: float) -> Iterator[np.ndarray]:
    """Groups of two or more places whose values are linked by steps of at most this distance."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > distance) + 1
    for group in np.split(order, cuts):
        if len(group) > 1:
            yield group


def refined(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors of a symmetric matrix, in the precision of the vectors:
    eigenvalues, better vectors, and how far the given ones were from right angles and from a diagonal."""
    kind = vectors.dtype
    identity = np.eye(len(matrix), dtype=kind)
    gram = identity - vectors.T @ vectors
    image = vectors.T @ (matrix @ vectors)
    # Exactly symmetric, or the rounding of both halves, divided by a small gap, would spoil right angles.
    gram, image = (gram + gram.T) / 2, (image + image.T) / 2
    values = np.diag(image) / (1 - np.diag(gram))
    off = image - np.diag(values)
    norm = float(np.abs(values).max())
    distance = 2 * (float(np.linalg.norm(off.astype(np.float64))) + norm * float(np.linalg.norm(gram.astype(np.float64))))
    distance = max(distance, CLOSE * norm)
    gaps = values[None, :] - values[:, None]
    far = np.abs(gaps) > distance
    step = np.where(far, (image + values[None, :] * gram) / np.where(far, gaps, 1), gram / 2)
    better = vectors + vectors @ step
    away = max(float(np.abs(gram).max()), float(np.abs(off).max()) / norm)
    for group in _clusters(values, distance):
        own = better[:, group]
        middle = values[group].mean()
        # Shifted, so that what tells the cluster's members apart is not lost beside its size.
        better[:, group] = own @ _solved(own.T @ (matrix @ own - middle * own))
    return values, better, away


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not scale:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    unit = (matrix + matrix.T) / (2 * scale)
    _, start = np.linalg.eigh(unit.astype(np.float32))
    vectors = start.astype(np.float64)
    for turn in range(ITERATIONS):
        if turn == 1:
            unit, vectors = unit.astype(np.longdouble), vectors.astype(np.longdouble)
        values, vectors, away = refined(unit, vectors)
        if turn > 1 and away <= EXACT:
            break
    values = np.einsum("ij,ij->j", vectors, unit @ vectors) / np.einsum("ij,ij->j", vectors, vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(axis=0))
    # Either sign would do; the largest entry is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))])
    return (values[order] * scale).astype(np.float64), (vectors * signs).astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the vectors; all eigenvalues, falling, and the eigenvectors in use, as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def used(self) -> int:
        """Components whose variance is more than rounding."""
        least = self.width * np.finfo(np.float64).eps * max(float(self.values[0]), 0.0) if self.width else 0.0
        return int((self.values[: self.vectors.shape[1]] > least).sum())

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        fits = self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
        return x * self.n - self.sums if fits else x.astype(object) * self.n - self.sums.astype(object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares; null beyond 64 bits."""
        largest = int(np.abs(centred).max(initial=0))
        if centred.dtype != object and largest**2 * self.width < 1 << 63:
            return (centred**2).sum(axis=1).tolist()
        sums = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """The components in use of each vector; null ones are NaN."""
        out = np.full((len(centred), self.vectors.shape[1]), np.nan)
        k = self.used
        if k:
            out[:, :k] = (centred / self.n).astype(np.float64) @ self.vectors[:, :k] / np.sqrt(self.values[:k])
        return out


def _totals(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """The length that most usable vectors have (of equals the larger one), their number and their sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                for _, matrix in finite_by_width(batch.column(0).slice(first, ROWS)):
                    x = whole(matrix[(np.abs(matrix) <= LARGEST).all(axis=1)])
                    n, total = held.get(matrix.shape[1], (0, 0))
                    held[matrix.shape[1]] = n + len(x), total + x.sum(axis=0)
        rows = [(width, n, total.tolist()) for width, (n, total) in held.items() if n]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = pa.int32(), pa.int64(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["width", "n", "sums"]
        )

    parts = written(vectors.mapInArrow(scan, "width int, n long, sums array<long>"), "sums")
    best = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return 0, 0, np.empty(0, np.int64)
    sums = parts.where(F.col("width") == best["width"]).select(F.posexplode("sums").alias("place", "x"))
    rows = sums.groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()  # one row a dimension
    return best["width"], best["n"], np.array([r["x"] for r in rows], dtype=np.int64)


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors of a table."""
    vectors = embeddings.select("embedding")
    width, n, sums = _totals(vectors)
    if not n:
        return Whitening(0, sums, np.empty(0), np.empty((0, 0)))
    plain = Whitening(n, sums, np.empty(0), np.empty((0, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, x in _usable(batch.column(0), width):
                z = (plain.centred(x) / n).astype(np.float64)
                yield z.T @ z

    values, columns = eigen(summed(vectors, products, (width, width)) / n)
    return Whitening(n, sums, values, columns[:, : min(components, width)])


def identity_error(embeddings: DataFrame, model: Whitening) -> float | None:
    """The largest entry, in size, of the components' covariance less the identity; null without any.

    The components come from centred vectors, so their sums are 0 up to rounding; what remains of them
    is taken off, too.
    """
    k = model.used
    if not k:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for _, x in _usable(batch.column(0), model.width):
                w = model.project(model.centred(x))[:, :k]
                yield np.vstack([w.T @ w, w.sum(axis=0)])

    total = summed(embeddings.select("embedding"), products, (k + 1, k)) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an array with a number for each component) of all usable vectors."""
    shared = embeddings.sparkSession.sparkContext.broadcast(model)  # dimension x components

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, x in _usable(batch.column(1), model.width):
                centred = model.centred(x)
                own = model.project(centred)
                places = np.arange(len(rows) + 1, dtype=np.int32) * own.shape[1]
                cells = pa.array(own.ravel(), mask=np.isnan(own.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(model.deviations(centred), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(places), cells),
                    ],
                    ["vec_id", "deviation", "whitened"],
                )

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(scan, "vec_id long, deviation long, whitened array<double>")


def component_table(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector
    and component.

    Usable are vectors that are not null, not empty, and hold neither nulls nor non-finite entries (nor
    any beyond LARGEST). All have one length: those of another length than most have (of equally frequent
    ones the larger) take no part. A component without variance has null as its whitened value; if none
    has any, explained and identity_error are null. deviation is null beyond 64 bits. Repeated rows
    count each, a null vec_id stays null, labels and other columns are not looked at. An empty table
    gives an empty one.
    """
    model = fit(embeddings, components)
    trace = float(model.values.sum())
    error = identity_error(embeddings, model)
    shares = [float(v) / trace if trace > 0 else None for v in model.values[: model.vectors.shape[1]]]
    share = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares)).cast("array<double>"), F.col("component"))
    rows = whitened(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "deviation", "whitened").select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        (share if shares else F.lit(None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
