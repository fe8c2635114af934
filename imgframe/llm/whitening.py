"""Whitening of vectors from a QR decomposition of tall matrices in a tree, without forming a covariance.

Rows are centred by exact integer sums, each partition keeps the R factor of its rows (batch after batch), the factors
are merged a few at a time until one is left, and the singular values and right vectors of that one are those of all
centred rows. So nothing is squared before the singular values are known, and small variances beside a large mean
survive. A task holds one batch and some factors of dimensions x dimensions; only the last factor comes to the driver.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Factors that one step of the tree merges.
FAN_IN = 8
#: Entries of an Arrow batch that a task takes to numbers at a time.
STEP_ENTRIES = 1 << 20
#: Entries beyond it have no exact whole number as doubles, and count as not finite.
LARGEST = 2.0**52


@dataclass(frozen=True)
class Whitening:
    """n rows with exact sums by dimension; components (rows) with their variances, largest first, and the sum of all variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def scales(self) -> np.ndarray:
        """1 / standard deviation of each component; NaN where rows do not differ along it but by rounding."""
        least = self.variances[:1].max(initial=0.0) * (len(self.sums) * np.finfo(float).eps) ** 2
        with np.errstate(divide="ignore"):
            return np.where(self.variances > least, 1 / np.sqrt(self.variances), np.nan)


def _vectors(batches: Iterator[pa.RecordBatch], scale: float, offset: int, length: int | None = None) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(other columns, length, whole numbers as rows) of usable vectors, those of one length at a time."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for size in [length] if length else np.unique(sizes[sizes > 0]).tolist():
            places = np.flatnonzero(sizes == size)
            rows = max(1, STEP_ENTRIES // size)
            for part in (places[i : i + rows] for i in range(0, len(places), rows)):
                entries = pc.fill_null(vectors.take(pa.array(part)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(-1, size)
                values = np.floor(entries * scale)
                good = (np.abs(values) < LARGEST).all(axis=1)  # NaN is not
                yield batch.column("vec_id").take(pa.array(part[good])), size, values[good].astype(np.int64) + offset


def _sums(vectors: DataFrame, scale: float, offset: int) -> DataFrame:
    """(length, dimension, n, total), exact, of the usable vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, size, x in _vectors(batches, scale, offset):
            n, total = found.get(size, (0, 0))
            # halves of 26 bits, so that no sum of a batch overflows
            found[size] = n + len(x), total + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        for size, (n, total) in found.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array([n] * size, pa.int64()), pa.array([decimal.Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["length", "dimension", "n", "total"])

    partial = vectors.mapInArrow(run, "length long, dimension long, n long, total decimal(38,0)")
    return partial.groupBy("length", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: as long numbers, or as Python's where these do not suffice."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor of ``rows``, filled up with zeros to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _factor(vectors: DataFrame, scale: float, offset: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """The R factor of all centred rows."""
    d, kind = len(sums), "node long, r array<double>"

    def rows(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["node", "r"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for _, _, x in _vectors(batches, scale, offset, d):
            r = triangle(np.vstack([r, _differences(x, n, sums).astype(float) / n]))
        if len(r):
            yield rows(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        node, found = table.column("up")[0].as_py(), sorted(zip(table.column("node").to_pylist(), table.column("r"), strict=True), key=lambda t: t[0])
        return pa.Table.from_batches([rows(node, triangle(np.vstack([r.values.to_numpy().reshape(d, d) for _, r in found])))])

    tree, nodes = vectors.mapInArrow(leaf, kind), vectors.rdd.getNumPartitions()
    while nodes > 1:
        tree = tree.withColumn("up", F.floor(F.col("node") / FAN_IN)).groupBy("up").applyInArrow(merge, kind)
        nodes = -(-nodes // FAN_IN)
    return triangle(np.vstack([np.array(r).reshape(d, d) for (r,) in tree.select("r").collect()]))  # one row


def fit_whitening(vectors: DataFrame, components: int = 8, scale: float = 1.0, offset: int = 0) -> Whitening | None:
    """The leading components of vectors (vec_id, vector) as whole numbers floor(scale * entry) + offset; None without usable vectors.

    Vectors that are null or empty, or hold null or not finite entries (or such of 2^52 and more), are left out, and so
    are those of another length than most (of several such, the greatest length counts).
    """
    by_length = _sums(vectors, scale, offset)
    most = by_length.where("dimension = 0").orderBy(F.desc("n"), F.desc("length")).select("length").first()
    if most is None:
        return None
    rows = by_length.where(F.col("length") == most[0]).orderBy("dimension").collect()  # one for each dimension
    n, sums = rows[0]["n"], tuple(int(r["total"]) for r in rows)
    _, singular, right = np.linalg.svd(_factor(vectors, scale, offset, n, sums))
    variances = singular**2 / n
    return Whitening(n, sums, right[:components], variances[:components], float(variances.sum()))


def whiten(vectors: DataFrame, model: Whitening, scale: float = 1.0, offset: int = 0) -> DataFrame:
    """(vec_id, deviation, whitened) of each vector that the fit counts, repeated ones each.

    ``deviation`` is the sum over dimensions of (n * x - sum)^2, exact; ``whitened`` has a number for each component, null
    where the rows do not differ along it.
    """
    d, scales = len(model.sums), model.scales

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, x in _vectors(batches, scale, offset, d):
            apart = _differences(x, model.n, model.sums)
            if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * d >= 1 << 63:
                squares = (apart.astype(object) ** 2).sum(axis=1)
            else:
                squares = (apart * apart).sum(axis=1)
            z = (apart.astype(float) / model.n) @ model.components.T * scales
            deviation = pa.array([decimal.Decimal(int(s)) for s in squares], pa.decimal128(38, 0))
            flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
            yield pa.RecordBatch.from_arrays([ids, deviation, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over components along which rows differ; 0 without any."""
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = pc.fill_null(batch.column("whitened").flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, k)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["entry", "total"])

    rows = whitened.select("whitened").mapInArrow(run, "entry long, total double").groupBy("entry").agg(F.sum("total").alias("total")).collect()  # k * k
    covariance, known = np.zeros(k * k), ~np.isnan(model.scales)
    for entry, total in rows:
        covariance[entry] = total / model.n
    error = np.abs(covariance.reshape(k, k) - np.eye(k))[np.ix_(known, known)]
    return float(error.max(initial=0.0))


def whitened_components(vectors: DataFrame, vector: Column, components: int = 8, scale: float = 1.0, offset: int = 0) -> DataFrame:
    """For each usable row of ``vectors`` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Defined cases: see ``fit_whitening`` for what is left out; a row without vec_id stays, with a null one; rows that
    repeat count and stay each; whitened is null along components without variance, explained is null where rows do not
    differ at all; other columns are ignored; no usable rows give no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    model = fit_whitening(vectors, components, scale, offset)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = materialize(whiten(vectors, model, scale, offset), "whitened")
    explained = F.array(*(F.lit(float(v / model.total) if model.total else None).cast("double") for v in model.variances))
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"))
