"""Embedding whitening: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Each entry c of a vector becomes the whole number floor(64 c) + 1000000. The
fit list holds every distinct vector of such numbers once (a distributed
group, combined map-side, so copies cost nothing). Sums per dimension are exact. The centred fit
list is reduced to one triangle R by QR of Arrow batches, one triangle a
task, and triangles are merged ``MERGE`` at a time, level by level through
written tables; R'R is n times the covariance, but that product is never
formed. ``bidiagonal.right_singular`` takes R apart. R is as wide as a vector
however many rows there are; only it, the sums and the components are on the
driver. The covariance of the whitened fit list is measured by one more pass.

Defined cases: rows whose vector is null, or holds a null, a non-finite entry
or one of 2^40 and more in size (its numbers would not be exact), are left
out, and so are rows of another width than the commonest (among ties the
largest; an empty vector has none); components whose variance is not above
rounding level have no direction and are left out, so there may be fewer than
asked for, or no rows at all; a deviation beyond 2^63 is null; null ids and
repeated rows are kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penprint.llm.bidiagonal import right_singular
from penprint.llm.tables import stored

COMPONENTS = 16
STEPS = 64
SHIFT = 1_000_000
LARGEST = float(1 << 40)
# Triangles merged by one task.
MERGE = 16


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): whole-number vectors of the valid rows, of the commonest width."""
    vector = F.col(vector_col).cast("array<double>")
    valid = rows.select(F.col(id_col).alias("id"), vector.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    # In this order a comparison with NaN or null is false or null, so such rows go.
    valid = valid.where(F.coalesce(F.forall("v", lambda c: (c > -LARGEST) & (c < LARGEST)), F.lit(False)))
    widths = valid.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 1
    return (valid.where(F.size("v") == width)
            .select("id", F.transform("v", lambda c: F.floor(c * STEPS) + SHIFT).alias("x")))


def _block(column: pa.Array) -> np.ndarray:
    """The int64 matrix of a list column whose lists are equally long."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


class _Centre:
    """Mean of the fit list, as whole numbers: n, and S = n * base + rest with 0 <= rest < n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.fraction = self.rest / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None beyond 2^63."""
        apart = x - self.base
        size = ((apart * float(self.n) - self.rest) ** 2).sum(axis=1)
        fits = size < 2.0 ** 62
        exact = np.zeros(len(x), np.int64)
        d = apart[fits] * self.n - self.rest
        exact[fits] = (d * d).sum(axis=1)
        out = exact.tolist()
        for i in np.flatnonzero(~fits).tolist():
            whole = sum((a * self.n - r) ** 2 for a, r in zip(apart[i].tolist(), self.rest.tolist(), strict=True))
            out[i] = whole if whole < 1 << 63 else None
        return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, total) of a task's vectors; dimension -1 holds their number."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _block(batch.column(0))
            n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()),
                                          pa.array([n, *total.tolist()], pa.int64())], ["dimension", "total"])


def _triangle(upper: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if upper is None else np.vstack([upper, rows]), mode="r")


def _triangle_batch(part: int, upper: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([upper.ravel().tolist()], pa.list_(pa.float64()))],
                                      ["part", "triangle"])


_TRIANGLE = "part int, triangle array<double>"


def fit_triangle(fit: DataFrame, centre: _Centre) -> np.ndarray:
    """R of the QR factorisation of the centred fit list."""
    width = len(centre.base)

    def reduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = None
        for batch in batches:
            if batch.num_rows:
                upper = _triangle(upper, centre.centred(_block(batch.column(0))))
        if upper is not None:
            yield _triangle_batch(TaskContext.get().partitionId(), upper)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, part = None, 0
        for batch in batches:
            for part, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                upper = _triangle(upper, np.array(flat).reshape(-1, width))
        if upper is not None:
            yield _triangle_batch(part // MERGE, upper)

    level = stored(fit.mapInArrow(reduce_task, _TRIANGLE), "triangles")
    while level.agg(F.max("part")).first()[0] > 0:
        groups = level.groupBy(F.expr(f"part div {MERGE}").alias("group"))
        level = stored(groups.applyInArrow(lambda parts: merge_group(parts, merge), _TRIANGLE), "triangles")
    upper = np.array(level.first()["triangle"]).reshape(-1, width)
    return np.vstack([upper, np.zeros((width - len(upper), width))])


def merge_group(table: pa.Table, merge) -> pa.Table:
    """One group of triangles, in order of their numbers, as one."""
    return pa.Table.from_batches(list(merge(iter(table.sort_by("part").to_batches()))))


def _products(directions: np.ndarray, centre: _Centre):
    """Task-wise sums of the products of every two whitened components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = centre.centred(_block(batch.column(0))) @ directions
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            at = np.arange(total.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["cell", "total"])
    return run


_ROWS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every valid row and component."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col)
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {_ROWS}"
    fit = stored(vectors.select("x").distinct(), "fit")
    sums = {r.dimension: int(r.total) for r in fit.mapInArrow(_sums, "dimension int, total bigint")
            .groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    if not sums:
        return spark.createDataFrame([], schema)
    n = sums.pop(-1)
    centre = _Centre(n, [sums[k] for k in range(len(sums))])
    squares, vectors_out = right_singular(fit_triangle(fit, centre), components)
    eigenvalues = squares[:vectors_out.shape[1]] / n
    directions = vectors_out / np.sqrt(eigenvalues)
    explained = squares[:len(eigenvalues)] / squares.sum() if len(eigenvalues) else eigenvalues
    k = len(eigenvalues)
    if not k:
        return spark.createDataFrame([], schema)
    cells = fit.mapInArrow(_products(directions, centre), "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    covariance = np.zeros(k * k)
    for r in cells.collect():
        covariance[r.cell] = r.total / n
    error = float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _block(batch.column(1))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), pa.array(centre.deviations(x), pa.int64()).take(each),
                pa.array((centre.centred(x) @ directions).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names)

    return vectors.mapInArrow(project, schema)
