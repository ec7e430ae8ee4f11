"""Whitening of embeddings by principal components, from a covariance in two passes.

The fit list is each distinct integer vector once. A first pass adds up exact integers, which give the mean; a second adds
the outer products of the centred vectors, a matrix product a batch, merged by treeAggregate; LAPACK's symmetric eigensolver
gives the components, which are broadcast (their size is the width of a vector by their number). A third pass measures how
far the whitened fit list's covariance is from the identity. Its mean is the projection of the mean itself, zero but for
rounding, so these vectors are centred as they are.

Copies are made one by a distributed distinct, which drops them before its shuffle. The driver holds one matrix, of the
square of a vector's width.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does one of another width
than the most frequent (of equally frequent ones the smallest above zero); rows that repeat an id or a vector are each
returned; a row without an id is fitted and returned; a component without variance, to double precision, has a null whitened
value and is left out of the error; explained is null where nothing varies; a deviation beyond a long is null; an empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import table, written
from eventloom.llm.integer_vectors import integers, matrix

COMPONENTS = 4
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def total(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray | None:
    """The sum of of_batch(matrix) over all batches of column x: one partial sum a task, merged in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                new = of_batch(matrix(b.column("x"), width))
                found = new if found is None else found + new
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    def merge(a, b):
        return b if a is None else a if b is None else a + b

    parts = rows.select("x").mapInArrow(partial, "part binary").rdd
    return parts.treeAggregate(None, lambda acc, row: merge(acc, pickle.loads(row["part"])), merge, depth=3)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns and the number of rows, as Python integers of any size."""
    low = (1 << 20) - 1
    sums = (x >> 20).sum(axis=0).astype(object) * (low + 1) + (x & low).sum(axis=0).astype(object)
    return np.append(sums, len(x))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit where that holds it, else Python integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return n * x - np.array(sums, np.int64) if 0 <= most < 1 << 62 and x.min(initial=0) > -(1 << 62) else n * x.astype(object) - np.array(sums, object)


def deviations(z: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null beyond a long."""
    most = max((abs(int(v)) for v in (z.min(initial=0), z.max(initial=0))), default=0)
    if z.dtype != object and z.shape[1] * most**2 < 1 << 63:
        return np.einsum("ij,ij->i", z, z).tolist()
    found = (z.astype(object) ** 2).sum(axis=1).tolist()
    return [int(d) if d < 1 << 63 else None for d in found]


@dataclass
class Whitening:
    """n and sums of the fit list; axes [width, component]: unit eigenvectors; variance and explained share of each."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """nan where a component has no variance."""
        y = centred(x, self.n, self.sums) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, y.astype(float) @ self.axes / np.sqrt(self.variance), np.nan)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The components of the distinct vectors in column x, all of one width, at least one."""
    *sums, n = total(distinct, exact_sums, width)

    def outer(x: np.ndarray) -> np.ndarray:
        y = (centred(x, n, sums) / n).astype(float)
        return y.T @ y

    covariance = total(distinct, outer, width) / n
    variance, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    variance, axes = variance[::-1][:components].copy(), axes[:, ::-1][:, :components]
    variance[variance <= width * np.finfo(float).eps * max(variance[0], 0)] = 0
    trace = float(np.trace(covariance))
    out = Whitening(n, sums, axes, variance, variance / trace if trace > 0 else np.full(len(variance), np.nan))
    vary = np.flatnonzero(variance > 0)
    if len(vary):
        product = total(distinct, lambda x: (w := out.whitened(x)[:, vary]).T @ w, width)
        out.identity_error = float(np.abs(product / n - np.eye(len(vary))).max())
    return out


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = 256) -> DataFrame:
    """A row for each remaining row of vectors and component, with SCHEMA's columns."""
    spark = vectors.sparkSession
    rows = integers(vectors.filter(F.size("embedding") > 0), scale)
    frequent = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if frequent is None:
        return spark.createDataFrame([], SCHEMA)
    width = frequent["width"]
    rows = written(rows.filter(F.size("x") == width), "whitening_rows")
    fitted = fit(written(rows.select("x").distinct(), "whitening_fit"), width, components)
    sent = spark.sparkContext.broadcast(fitted)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        c = len(w.variance)
        for b in parts:
            x, m = matrix(b.column("x"), width), b.num_rows * c
            told = deviations(centred(x, w.n, w.sums))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(b.num_rows), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, w.n)),
                pa.array([d for d in told for _ in range(c)], pa.int64()), pa.array(w.whitened(x).ravel(), from_pandas=True),
                pa.array(np.tile(w.explained, b.num_rows), from_pandas=True), pa.array([w.identity_error] * m, pa.float64())], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return rows.mapInArrow(batches, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
