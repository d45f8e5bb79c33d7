"""Whitened embeddings by Chebyshev-filtered subspace iteration.

Only a few columns Q, as long as a vector, and products XᵀXQ of their size reach the driver. Each pass sums
Xᵀ(XQ) of centred rows per partition, and cell by cell over partitions. A polynomial of such passes damps the
directions below the wanted ones; QR and Rayleigh-Ritz follow, until residuals certify the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumora.llm.shared import written

#: Whole numbers that stand for an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from this magnitude on have no whole number that a double holds, and count as not finite.
LARGEST = float(1 << 42)
COMPONENTS = 8
#: Columns besides the wanted ones, degree of the filter, and rounds after which more columns are taken.
GUARDS, DEGREE, PATIENCE = 12, 8, 3
#: A component stands if its residual is below this share of the largest eigenvalue; eigenvalues below FLAT of the largest are none.
CERTAIN, FLAT = 2e-14, 1e-11


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the usable rows.

    Rows go whose vector is null, empty, or holds null, non-finite or very large entries, or has another
    length than most of the usable vectors (of equally frequent lengths the larger one counts).
    """
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT
    usable = F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(usable & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda c: ~F.isnan(c.cast("double"))))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (size["d"] if size else 0))
    return rows.select("vec_id", F.transform("v", entry).alias("x"))


class Spectrum(NamedTuple):
    """Moments of the fit list, and its leading components as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    passes: int


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of a list column of long."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, size), np.int64), *[p.flatten().to_numpy().reshape(-1, size) for p in parts]])


def _cells(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of `of(x)`, a matrix of `shape`: one matrix per partition, then one sum per cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + of(_matrix(batch.column(0), size)), True
        if seen:
            yield pa.record_batch({"at": pa.array(np.arange(total.size, dtype=np.int32)), "v": pa.array(total.ravel())})

    made = np.zeros(shape[0] * shape[1])
    for r in rows.select("x").mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        made[r["at"]] = r["v"]
    return made.reshape(shape)


def moments(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """Number of rows, and per dimension the exact sums of x and x²; one row per dimension reaches the driver."""
    square = F.col("c").cast("decimal(20,0)") * F.col("c").cast("decimal(18,0)")
    cells = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.count("c").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.sum(square).alias("q"))
    found = sorted(cells.collect(), key=lambda r: r["at"])
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found], [int(r["q"]) for r in found]


def leading_components(rows: DataFrame, count: int = COMPONENTS, seed: int = 7) -> Spectrum:
    """The `count` leading eigenvectors of the covariance (divisor n) of whole-number vectors `x` of one length.

    Fewer are returned where the covariance has a lower rank. Equal eigenvalues have any orthonormal basis.
    """
    n, sums, squares = moments(rows)
    d = len(sums)
    if not n:
        return Spectrum(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), 0)
    trace = sum(n * q - s * s for s, q in zip(sums, squares)) / n / n
    mean = np.array([s / n for s in sums])
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times q, by one pass over all rows."""
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _cells(rows, d, of, q.shape) / n

    if trace <= 0:
        return Spectrum(n, sums, trace, np.zeros(0), np.zeros((d, 0)), 0)
    rng = np.random.default_rng(seed)
    wanted, width = min(count, d), min(d, count + GUARDS)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    last, rounds = np.inf, 0
    while True:
        vq = times(q)
        small = q.T @ vq
        theta, w = np.linalg.eigh((small + small.T) / 2)
        theta, w = theta[::-1], w[:, ::-1]
        q, vq = q @ w, vq @ w
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0).max()
        rounds += 1
        # with all directions in the block the small problem is the whole one; else a residual at rounding level is asked for
        if width == d or residual <= CERTAIN * theta[0] * np.sqrt(d):
            break
        if rounds == 1 or rounds % PATIENCE == 0:
            width = min(d, 2 * width) if residual > last * 1e-5 and rounds > 1 else width
            last = residual
        low, top = max(theta[-1], 0.0), theta[0]
        q = _filtered(times, q, vq, low, top)
        # one column anew in each round, and more when progress is slow, so that no direction is missed
        fresh = rng.standard_normal((d, width - q.shape[1] + 1))
        q = np.linalg.qr(np.column_stack([q[:, : width - fresh.shape[1]], fresh]))[0]
    there = theta[:wanted] > FLAT * theta[0]
    return Spectrum(n, sums, trace, theta[:wanted][there], q[:, :wanted][:, there], passes)


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times q: small on [0, low], one at `top`."""
    half = max(low / 2, 1e-12 * top)
    ratio = half / (top - half)  # of the scaled recurrence
    start = ratio
    before, now = q, (vq - half * q) * (start / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / start - ratio)
        before, now = now, (times(now) - half * now) * (2 * following / half) - before * (ratio * following)
        ratio = following
    return now / np.maximum(np.linalg.norm(now, axis=0), 1e-300)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n·x − S)², exact; None where it needs over 63 bits."""
    width = max(1, x.shape[1])
    bound = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if bound < 1 << 62:
        y = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(y).max(initial=0)) ** 2 * width < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, found: Spectrum, with_deviation: bool = True) -> DataFrame:
    """Per row of `rows` (vec_id, x) one row for each component: its number, n, deviation, and the whitened value."""
    n, sums, size = found.n, found.sums, len(found.sums)
    count = len(found.values)
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)
    scaled = found.components / np.sqrt(found.values) if count else found.components
    explained = found.values / found.trace if count else found.values
    ids = rows.schema["vec_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            if not len(x) or not count:
                continue
            deviation = pa.array(_deviation(x, n, sums) if with_deviation else [None] * len(x), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.record_batch({
                "vec_id": batch.column(0).take(each), "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), "n": pa.array(np.full(len(each), n)),
                "deviation": deviation.take(each), "whitened": pa.array(((x - mean) @ scaled).ravel()), "explained": pa.array(np.tile(explained, len(x))),
            })

    return rows.select("vec_id", "x").mapInArrow(made, f"vec_id {ids}, component int, n long, deviation long, whitened double, explained double")


def identity_error(rows: DataFrame, found: Spectrum) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity, by one more pass."""
    count, size = len(found.values), len(found.sums)
    if not count:
        return 0.0
    mean, scaled = np.array([s / found.n for s in found.sums]), found.components / np.sqrt(found.values)

    def of(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - mean) @ scaled])
        return z.T @ z

    products = _cells(rows, size, of, (count + 1, count + 1))
    centre = products[0, 1:] / found.n
    covariance = products[1:, 1:] / found.n - np.outer(centre, centre)
    return float(np.abs(covariance - np.eye(count)).max())


def whitened_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """All usable vectors, whitened on their leading components, with the share of variance and the identity error.

    One row per usable row and component; repeated rows and null ids give rows of their own. Without usable rows, or where
    all are equal, there is no component and so no row. Other columns are not read.
    """
    rows = written(whole_vectors(vectors, id_col, vector_col), "vectors")
    found = leading_components(rows, count)
    return whiten(rows, found).withColumn("identity_error", F.lit(identity_error(rows, found)))
