"""Whitens vectors: exact sums and a centred scatter matrix summed by Spark, cyclic Jacobi rotations on the driver.

The driver holds matrices of the dimension's square and nothing that grows with the rows. Each pass reads the vectors
anew and keeps no state, so lost executors cost their own tasks alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import lean, packed, summed

#: x = floor(SCALE * entry) + SHIFT. Rows with an entry of MOST or more don't fit and are left out.
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 34)
#: Sweeps of rotations at most; some ten are enough for any matrix.
SWEEPS = 60


class Whitening(NamedTuple):
    n: int
    #: Sums by dimension, of x.
    sums: np.ndarray
    #: Eigenvalues of the covariance, falling, and its unit eigenvectors, one a column.
    values: np.ndarray
    vectors: np.ndarray


def integers(lists: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of vectors: which are whole and finite, their lengths, and the x of those of length `dim`, in order."""
    lists = lists.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    entries = lists.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~(np.abs(entries) < MOST))])
    sizes = np.diff(offsets)
    good = np.asarray(lists.is_valid()) & (sizes > 0) & (odd[offsets[1:]] == odd[offsets[:-1]])
    if dim is None:
        return good, sizes, entries
    good &= sizes == dim
    own = entries[offsets[:-1][good][:, None] + np.arange(dim)]
    return good, sizes, np.floor(SCALE * own).astype(np.int64) + SHIFT


def totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of usable vectors of the most frequent length (of those, the largest), and their exact sums by dimension."""

    @lean
    def run(batches):
        for batch in batches:
            good, sizes, entries = integers(batch.column("vector"))
            for dim in np.unique(sizes[good]):
                own, _, x = integers(batch.column("vector"), int(dim))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([own.sum()], pa.int64()), "sums": pa.array([x.sum(axis=0)], pa.list_(pa.int64()))})

    parts = vectors.select("vector").mapInArrow(run, "dim int, n long, sums array<long>")
    sums = parts.select("dim", "n", F.posexplode("sums").alias("at", "x")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("s"))
    best = sums.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("dim")).first()  # one struct a dimension
    return (best["n"], np.array([x["s"] for x in best["sums"]], np.int64)) if best else (0, np.zeros(0, np.int64))


def centre(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the rest, so that x less the mean loses no digits."""
    whole = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    return whole, np.array([(int(s) - n * int(w)) / n for s, w in zip(sums, whole, strict=True)])


def scatter(vectors: DataFrame, n: int, sums: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance of x, or of x projected `onto` columns, centred before multiplying, with divisor n."""
    dim, (whole, rest) = len(sums), centre(n, sums)
    size = dim if onto is None else onto.shape[1]

    @lean
    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            d = integers(batch.column("vector"), dim)[2] - whole - rest
            d = d if onto is None else d @ onto
            d = np.column_stack([d, np.ones(len(d))])
            total += d.T @ d
        yield packed(total.ravel())

    total = summed(vectors.select("vector").mapInArrow(run, "sums binary"), (size + 1) ** 2).reshape(size + 1, size + 1) / n
    mean = total[:-1, -1]
    return total[:-1, :-1] - np.outer(mean, mean)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix.

    A sweep meets each pair of dimensions once, in rounds of pairs that share none, so a round's rotations are one step
    on arrays. It ends when every off-diagonal entry is nothing beside its two diagonal ones, which keeps small
    eigenvalues accurate to their own size. Signs: the largest entry of each vector is positive.
    """
    size = len(matrix)
    a, u = matrix.astype(float), np.eye(size)
    order = np.arange(size + size % 2)  # an odd dimension sits out one round
    for _ in range(SWEEPS):
        still = True
        for _ in range(max(0, len(order) - 1)):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < size], q[q < size]
            off, low, high = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > 1e-17 * np.sqrt(np.abs(low * high))
            p, q, off, low, high = p[turn], q[turn], off[turn], low[turn], high[turn]
            still &= not (np.abs(off) > 1e-15 * np.sqrt(np.abs(low * high))).any()
            if len(p):
                slope = (high - low) / (2 * off)
                t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(1.0, slope))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
                a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
                u[:, p], u[:, q] = u[:, p] * c - u[:, q] * s, u[:, p] * s + u[:, q] * c
                a[p, q] = a[q, p] = 0
                a[p, p], a[q, q] = low - t * off, high + t * off
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if still:
            break
    values = np.diag(a)
    by = np.argsort(-values, kind="stable")
    u = u[:, by] / np.linalg.norm(u[:, by], axis=0)
    return values[by], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)


def fit_whitening(vectors: DataFrame) -> Whitening | None:
    """The whitening of a column `vector`; None if it has no usable vector."""
    n, sums = totals(vectors)
    return Whitening(n, sums, *jacobi(scatter(vectors, n, sums))) if n else None


def projection(fit: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that whiten, and which components vary; the others, of no variance, become 0."""
    values, vectors = fit.values[:components], fit.vectors[:, :components]
    varies = values > max(fit.values[0], 0) * 1e-13
    return vectors * np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), 0), varies


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each usable row: id, n, deviation, whitened (array), explained (array), identity_error.

    Rows whose vector is null or empty, holds null, non-finite or too large entries (MOST), or isn't as long as most
    vectors are left out. `deviation` is null where it doesn't fit 64 bits. Components without variance (constant
    dimensions, one row, fewer rows than dimensions) are 0 in every row, have `explained` 0, and stay out of
    `identity_error`. Repeated rows and ids, null ids and ties are rows like any other; extra columns are not read; an
    empty table gives no rows.
    """
    vectors = rows.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    schema = vectors.schema["id"].dataType
    fit = fit_whitening(vectors)
    if fit is None:
        return vectors.filter(F.lit(False)).selectExpr("id", "0L n", "0L deviation", "array(0D) whitened", "array(0D) explained", "0D identity_error")
    n, sums, dim = fit.n, fit.sums, len(fit.sums)
    (whole, rest), (onto, varies) = centre(n, sums), projection(fit, components)
    explained = np.where(varies, fit.values[: len(varies)] / max(fit.values.sum(), 1e-300), 0)
    error = float(np.abs(scatter(vectors, n, sums, onto[:, varies]) - np.eye(varies.sum())).max(initial=0))

    @lean
    def run(batches):
        for batch in batches:
            good, _, x = integers(batch.column("vector"), dim)
            far = n * x - sums
            fits = (far.astype(float) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            deviation = pa.array((far * far).sum(axis=1), pa.int64(), mask=~fits)
            z = (x - whole - rest) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), deviation, lists], names=["id", "deviation", "whitened"])

    found = vectors.mapInArrow(run, f"id {schema.simpleString()}, deviation long, whitened array<double>")
    return found.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*(F.lit(float(x)) for x in explained)).alias("explained"), F.lit(error).alias("identity_error"))
