"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR.

Entries are put on a lattice, x = floor(64 * c) + 1000000, and the model is fitted on the distinct lattice vectors.

* Sums: exact integers per dimension, summed in each task first.
* TSQR: every task compresses its centred rows to one triangle R, block after block, and triangles are merged FAN at a time
  until one is left.  No product of rows is ever formed, so small deviations keep their relative accuracy.
* Jacobi: plane rotations make R's columns orthogonal, a round of disjoint pairs at a time.  The columns' lengths are the
  singular values and the accumulated rotations the components.  R is as wide as the vectors are long, whatever their number.
* Whitening: centred rows times components over standard deviations, where the rows lie.

Nulls and edges: rows with a NULL vector or an entry that is NULL, not finite or over LARGEST in size are dropped, as are
vectors of another length than most distinct vectors have (of equally many the longer); NULL ids and repeated rows are
whitened row by row and repeated vectors fitted once; directions of no variance (standard deviation under FLAT of the
largest) are no components, so a table of one distinct vector, like an empty table, gives an empty result; deviation is NULL
where it doesn't fit a long.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import durable, one_chunk, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST, FLAT = 2.0**40, 1e-10
#: Triangles that a task merges.
FAN = 64


def lattice(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x of the rows whose vector can be used."""
    entries = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).filter("size(e) > 0")
    whole = F.forall("e", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))  # NaN is greater than any number
    return entries.filter(whole).select("id", F.transform("e", lambda c: F.floor(SCALE * c) + F.lit(SHIFT).cast("long")).alias("x"))


def matrix(column, dims: int) -> np.ndarray:
    return one_chunk(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Whitening:
    """Mean in integers (n * mean = n * whole + rest), components as columns, their standard deviations and shares."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.deviations

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Per row the sum of (n * x - S) ** 2, exact."""
        off = x - self.whole
        most = self.n * int(np.abs(off).max(initial=0)) + int(self.rest.max(initial=0))
        if most * most * max(1, x.shape[1]) < 2**63:
            return pa.array(((self.n * off - self.rest) ** 2).sum(axis=1))
        exact = [sum((self.n * int(c) - int(r)) ** 2 for c, r in zip(row, self.rest, strict=True)) for row in off]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def jacobi(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by one-sided plane rotations."""
    d = triangle.shape[1]
    size = d + d % 2
    columns, turned = np.zeros((size, triangle.shape[0])), np.eye(size)  # columns of R and of the rotations as rows
    columns[:d] = triangle.T
    ring = np.arange(size)
    for _ in range(60):
        worst = 0.0
        for _ in range(size - 1):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            a, b = columns[p], columns[q]
            aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            scale = np.sqrt(aa * bb)
            cosine = np.divide(np.abs(ab), scale, out=np.zeros_like(ab), where=scale > 0)
            worst = max(worst, cosine.max(initial=0.0))
            tilt = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=ab != 0)
            t = np.where(cosine > 1e-16, np.where(tilt >= 0, 1.0, -1.0) / (np.abs(tilt) + np.hypot(1.0, tilt)), 0.0)
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            columns[p], columns[q] = c * a - s * b, s * a + c * b
            u, v = turned[p], turned[q]
            turned[p], turned[q] = c * u - s * v, s * u + c * v
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])  # every pair meets once a sweep
        if worst <= 4e-16 * size:
            break
    lengths = np.sqrt((columns[:d] ** 2).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], turned[:d, :d][order].T


def _stacked(triangles: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(triangles), mode="r")


def triangle_of(fitted: DataFrame, centred, dims: int) -> np.ndarray:
    """R of the centred rows' QR decomposition."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, dims))
        for batch in batches:
            held = _stacked([held, centred(matrix(batch["x"], dims))])
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["r"])

    def merge(some: pa.Table) -> pa.Table:
        some = some.sort_by("id")  # the same result in whatever order they come
        whole = _stacked([np.frombuffer(r, np.float64).reshape(-1, dims) for r in some["r"].to_pylist()])
        return pa.table({"id": pa.array([some["id"][0].as_py() // FAN], pa.int64()), "r": pa.array([whole.tobytes()], pa.binary())})

    found = durable(fitted.select("x").mapInArrow(compress, "r binary").select(F.spark_partition_id().cast("long").alias("id"), "r"))
    last = found.agg(F.max("id")).first()[0] or 0
    while last:
        found = found.groupBy(F.expr(f"id div {FAN}")).applyInArrow(merge, "id long, r binary")
        last //= FAN
    return np.frombuffer(found.first()["r"], np.float64).reshape(-1, dims)


def fit(fitted: DataFrame, dims: int, components: int) -> Whitening | None:
    """From the distinct lattice vectors of length ``dims``; None without variance."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], dims)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(x.sum(axis=0)), pa.array(np.full(dims, len(x)))], names=["dim", "s", "n"])

    total = fitted.select("x").mapInArrow(add, "dim long, s long, n long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    if not total:
        return None
    n = int(total[0]["n"])
    parts = [divmod(int(r["s"]), n) for r in total]
    model = Whitening(n, np.array([w for w, _ in parts], np.int64), np.array([r for _, r in parts], np.int64), np.empty((dims, 0)), np.empty(0), np.empty(0))
    lengths, vectors = jacobi(triangle_of(fitted, model.centred, dims))
    used = min(components, int((lengths > FLAT * lengths[0]).sum()))
    if not used:
        return None
    model.components, model.deviations = np.ascontiguousarray(vectors[:, :used]), lengths[:used] / np.sqrt(n)
    model.explained = lengths[:used] ** 2 / (lengths**2).sum()
    return model


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    dims, k = model.components.shape

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model(matrix(batch["x"], dims))
            mean = y.mean(axis=0) if len(y) else np.zeros(k)
            spread = (y - mean).T @ (y - mean) + len(y) * np.outer(mean, mean)
            values = np.concatenate([len(y) * mean, spread.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    rows = fitted.select("x").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    values = np.array([r["value"] for r in rows]) / model.n
    return float(np.abs(values[k:].reshape(k, k) - np.outer(values[:k], values[:k]) - np.eye(k)).max())


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every row that can be used."""
    held = lattice(rows, key, vector)
    fitted = durable(held.select("x").distinct())
    lengths = fitted.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 0
    fitted, held = (x.filter(F.size("x") == dims) for x in (fitted, held))
    model = fit(fitted, dims, components) if dims else None
    if model is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], dims)
            y = model(x)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], model.deviation(x), values], names=["id", "deviation", "y"])

    each = held.mapInArrow(project, "id long, deviation long, y array<double>").select("id", "deviation", F.posexplode("y").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("at"))
    error = F.lit(identity_error(fitted, model))
    return each.select("id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), error.alias("identity_error"))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


SQL = None
