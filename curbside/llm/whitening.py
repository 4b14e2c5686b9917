"""Whitening of vectors by shifted Cholesky QR.

Entries become whole numbers, so counts, sums and deviations are exact and rows are centred before anything is
multiplied. Each pass over the rows multiplies the centred rows by the inverse of the triangle known so far (a
triangular solve per batch), and adds up their Gram matrix. Its Cholesky factor is the next triangle: the first one is
taken of a shifted Gram matrix, so that it exists however badly the columns depend on each other, the following ones
bring the rows to orthonormality in double precision. The product of the triangles is the R of a QR factorisation of all
rows, and its singular value decomposition gives the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from curbside.llm.tables import read

#: fixed values: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this are held at it, far outside of what whole doubles can tell apart.
LIMIT = 2.0**52
#: Rows of one step inside a task.
ROWS = 4096
#: Further passes end when the rows' Gram matrix differs from the identity by no more than this.
CLOSE, PASSES = 1e-12, 6

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """Count, sums and triangle of the rows; ``axes`` has a column per component."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def to_white(self) -> np.ndarray:
        return self.axes / np.sqrt(self.variances)


def whole(batch: pa.RecordBatch, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that take part, and their entries as whole numbers in a matrix of ``dims`` columns.

    A vector takes part if it isn't null and has neither null nor non-finite entries. One shorter than others counts as
    zero beyond its end.
    """
    lists = batch.column("embedding")
    present = ~lists.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(present, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry is NaN here
    owner = np.repeat(np.arange(len(sizes)), sizes)
    present[owner[~np.isfinite(flat)]] = False
    rows = np.flatnonzero(present)
    taken = present[owner]
    width = int(sizes[rows].max(initial=0)) if dims is None else dims
    entries = np.clip(np.floor(SCALE * flat[taken]), -LIMIT, LIMIT).astype(np.int64) + OFFSET
    out = np.full((len(rows), width), OFFSET, np.int64)
    begins = np.cumsum(sizes[rows]) - sizes[rows]
    out[np.repeat(np.arange(len(rows)), sizes[rows]), np.arange(len(entries)) - np.repeat(begins, sizes[rows])] = entries
    return rows, out


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows that take part and their exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for part in parts(batches):
            _, x = whole(part)
            # what lies beyond the end of a vector is OFFSET, which the driver adds for rows that didn't see the place
            sums = np.pad(sums, (0, max(0, x.shape[1] - len(sums))))
            n += len(x)
            sums[: x.shape[1]] += (x - OFFSET).sum(axis=0)
            if len(sums) and np.abs(sums).max() > 1 << 61:
                yield _sums(n, sums)
                n, sums = 0, np.zeros(0, np.int64)
        yield _sums(n, sums)

    # one row per dimension is collected, and one for the count
    found = rows.mapInArrow(add, "place int, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = {row["place"]: int(row["total"]) for row in found.collect()}
    n = sums.pop(-1, 0)
    return n, np.array([sums[place] + n * OFFSET for place in sorted(sums)], object)


def _sums(n: int, sums: np.ndarray) -> pa.RecordBatch:
    place = np.arange(-1, len(sums), dtype=np.int32)
    return pa.RecordBatch.from_pydict({"place": place, "total": np.concatenate([[n], sums]).astype(np.int64)})


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` exactly (whole numbers; Python's where 64 bits may not do) and divided by ``n`` as doubles."""
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    exact = x * n - sums.astype(np.int64) if reach < 1 << 62 else x.astype(object) * n - sums
    return exact, (exact / n).astype(np.float64)


def gram(rows: DataFrame, n: int, sums: np.ndarray, turn: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the centred rows after ``turn``, which gives ``width`` columns.

    Every task adds up its own rows; the tasks' matrices are added up by place, and one matrix comes to the driver.
    """
    dims = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for part in parts(batches):
            _, x = whole(part, dims)
            q = turn(centred(x, n, sums)[1])
            total[:width] += q.T @ q
            total[width] += q.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size, dtype=np.int32), "total": total.ravel()})

    found = rows.mapInArrow(add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    out = np.zeros((width + 1, width))
    for row in found.toArrow().to_pylist():
        out.flat[row["place"]] = row["total"]
    return (out[:width] + out[:width].T) / 2, out[width]


def solve(upper: np.ndarray, a: np.ndarray) -> np.ndarray:
    """``a @ inv(upper)`` by substitution, column after column."""
    q = np.empty_like(a)
    for j in range(len(upper)):
        q[:, j] = (a[:, j] - q[:, :j] @ upper[:j, j]) / upper[j, j]
    return q


def cholesky(g: np.ndarray, rows: int, force: bool) -> np.ndarray:
    """Upper triangle R with R'R = g, shifted where ``force`` says so or without a shift there is none."""
    dims = len(g)
    # the shift of shifted Cholesky QR: 11 (mn + n (n + 1)) u |A|^2
    shift = 11 * (rows * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * max(np.trace(g), np.finfo(float).tiny)
    shift = min(shift, np.trace(g) / dims * 1e-3) or 1.0
    for own in ([0.0] if not force else []) + [shift * 100.0**k for k in range(12)]:
        try:
            return np.linalg.cholesky(g + own * np.eye(dims)).T
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("no triangle, the Gram matrix holds non-finite numbers")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of all rows of ``vectors`` that take part; None if there are none, or no two differ.

    The driver holds matrices of dimensions x dimensions. Directions in which the rows don't differ (their variance is
    lost in the rounding of the largest) are no components.
    """
    rows = vectors.select("embedding")
    n, sums = totals(rows)
    dims = len(sums)
    if not n or not dims:
        return None
    triangles: list[np.ndarray] = []

    def turned(a: np.ndarray) -> np.ndarray:
        for upper in triangles:
            a = solve(upper, a)
        return a

    rest = np.eye(dims)
    for number in range(PASSES):
        g, _ = gram(rows, n, sums, turned, dims)
        if not number and not np.trace(g) > 0:
            return None
        if number and np.abs(g - np.eye(dims)).max() < CLOSE:
            rest = g
            break
        if number >= 3 and np.abs(g - rest).max() < CLOSE:  # dependent columns: what is left can't be made orthonormal
            rest = g
            break
        rest = g
        if number < PASSES - 1:
            triangles.append(cholesky(g, n, force=not number))
    r = np.eye(dims)
    for upper in triangles:
        r = upper @ r
    # rows = Q R with Q'Q = rest, the identity up to rounding unless columns depend on each other: its root joins R
    values, turn = np.linalg.eigh(rest)
    r = np.sqrt(np.maximum(values, 0))[:, None] * (turn.T @ r)
    _, singular, axes = np.linalg.svd(r)
    variances = singular**2 / n
    kept = np.flatnonzero(variances > variances[0] * (dims * np.finfo(float).eps) ** 2 * 1e4)[:components]
    found = Fit(n, sums, axes[kept].T, variances[kept], float(variances.sum()))
    white = found.to_white
    g, total = gram(rows, n, sums, lambda a: a @ white, len(kept))
    mean = total / n
    found.identity_error = float(np.abs(g / n - np.outer(mean, mean) - np.eye(len(kept))).max(initial=0))
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    Vectors that are null or hold null or non-finite entries are left out, one shorter than others is zero beyond its
    end, entries beyond 2 ** 52 are held there. A repeated row counts and comes as often as it is there, a null
    ``vec_id`` stays. There are as many components as dimensions in which the vectors differ, at most ``components``;
    equal variances keep the order the decomposition gives them. No rows without vectors or if all of them are equal. A
    deviation beyond 64 bits is null. Other columns play no part.
    """
    held = vectors.schema["embedding"].dataType
    numbers = F.col("embedding")
    if not isinstance(getattr(held, "elementType", None), (FloatType, DoubleType)):
        numbers = numbers.cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding"))
    found = fit(rows, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], OUT)
    white, explained = found.to_white, found.variances / found.trace
    width = len(explained)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            taken, x = whole(part, len(found.sums))
            if not len(taken):
                continue
            exact, a = centred(x, found.n, found.sums)
            largest = int(np.abs(exact).max(initial=0))
            if exact.dtype == object or largest * largest * max(1, x.shape[1]) >= 1 << 63:
                deviation = [int(d) for d in (exact.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            else:
                deviation = pa.array((exact * exact).sum(axis=1))
            each = pa.array(np.repeat(np.arange(len(taken)), width))
            size = len(each)
            yield pa.RecordBatch.from_pydict({
                "vec_id": part.column("vec_id").take(pa.array(taken)).take(each),
                "component": np.tile(np.arange(1, width + 1, dtype=np.int32), len(taken)),
                "n": np.full(size, found.n, np.int64), "deviation": deviation.take(each),
                "whitened": (a @ white).ravel(), "explained": np.tile(explained, len(taken)),
                "identity_error": np.full(size, found.identity_error),
            })

    return rows.mapInArrow(apply, OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
