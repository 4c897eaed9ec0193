"""Whitening by TSQR: rows centred by exact sums, a QR of each partition, R factors merged in a tree.

An entry c counts as the integer floor(64 c) + 1,000,000, so that sums are exact. A row is centred as
(n x - S) / n, worked out in integers and divided once. Tasks fold what they read into one R factor;
factors meet eight at a time, round by round, until one is left. The right vectors of its singular
value decomposition are the principal axes: the covariance itself is never formed. What the driver
gets is that one factor and the sums of the dimensions, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .store import dropped, saved

#: Factors that meet in a task of the tree; size of an integer beyond which entries count as just this.
FAN, LARGEST = 8, 2**60
_EXACT = pa.list_(pa.decimal128(38, 0))


def _sound(vector: Column) -> Column:
    """Not null, without entries that are null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """floor(64 c) as rows of equal length, shorter vectors filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * 64), -LARGEST, LARGEST).astype(np.int64)
    dims = int(sizes.max(initial=0)) if dims is None else dims
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _vectors(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("vector"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, []
    for batch in batches:
        x = integers(_vectors(batch))
        n += len(x)
        exact = np.abs(x).max(initial=0) * len(x) < 2**62
        own = [int(s) for s in (x if exact else x.astype(object)).sum(axis=0)]
        sums = [a + b for a, b in zip(sums + [0] * (len(own) - len(sums)), own + [0] * (len(sums) - len(own)), strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], _EXACT)], ["n", "sums"])


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``axes`` has a row for each component; components without variance have an ``explained`` of 0, null if nothing varies."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    explained: tuple[float | None, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: in 64 bits where sums of squares fit as well, else in Python's integers."""
        sums = np.array(self.sums, dtype=object)
        most = self.n * float(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if len(self.sums) * most * most < 2**62:
            return x * self.n - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float) if self.n else x.astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows on the components, over their standard deviations; 0 where a component has no variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), 0.0)
        return self.centred(x) @ (self.axes * scale[:, None]).T

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The id, whitened vector and squared deviation of each row."""
        void = self.variances <= 0
        for batch in batches:
            x = integers(_vectors(batch), len(self.sums))
            z, apart = self.whitened(x), self.deviations(x)
            squares = [int(s) for s in (apart * apart).sum(axis=1)]
            flat = pa.array(z.ravel(), mask=np.tile(void, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([s if s < 2**63 else None for s in squares], pa.int64())], ["id", "whitened", "deviation"])


def _factors(fit: Whitening) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(fit.sums)))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, fit.centred(integers(_vectors(batch), len(fit.sums)))]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], ["part", "values"])

    return of


def _products(fit: Whitening) -> Callable:
    """Of each task: the number of rows, their sums on each component, and their sums of products."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = fit.whitened(integers(_vectors(batch), len(fit.sums)))
            own = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tolist()])], ["part", "values"])

    return of


def _tree(leaves: DataFrame, merge: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray | None:
    """All ``leaves`` (part, values) merged, ``FAN`` at a time; None without any. ``merge`` takes rows of ``width`` values."""

    def met(parts: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.asarray(v, float).reshape(-1, width) for v in parts.sort_values("part")["values"]])
        return pd.DataFrame({"part": [int(parts["part"].min()) // FAN], "values": [merge(rows).ravel().tolist()]})

    parts = saved(leaves)
    last = parts.agg(F.max("part")).first()[0]
    while last:
        new = saved(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(met, "part long, values array<double>"))
        dropped(parts)
        parts, last = new, last // FAN
    one = parts.first()
    return None if one is None else np.array(one["values"], float).reshape(-1, width)


def fit(vectors: DataFrame, components: int = 32) -> Whitening:
    """Fitted on all of ``vectors`` (id, vector)."""
    parts = saved(vectors.mapInArrow(_summed, "n long, sums array<decimal(38,0)>"))
    n = parts.agg(F.sum("n")).first()[0] or 0
    by_dim = parts.select(F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("s").alias("s")).orderBy("dim").collect()  # a row for each dimension
    start = Whitening(n, tuple(int(r["s"]) for r in by_dim), np.zeros((0, 0)), np.zeros(0), ())
    dims = len(start.sums)
    r = _tree(vectors.mapInArrow(_factors(start), "part long, values array<double>"), lambda rows: np.linalg.qr(rows, mode="r"), dims) if n and dims else None
    if r is None:
        return start
    _, s, axes = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(dims - len(s))])
    s[s <= s[0] * dims * np.finfo(float).eps] = 0
    k = min(components, dims)
    axes = axes[:k] * np.where(np.take_along_axis(axes[:k], np.abs(axes[:k]).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    total = math.fsum(s * s)
    return Whitening(n, start.sums, axes, (s[:k] ** 2) / n, tuple(float(x) for x in s[:k] ** 2 / total) if total else (None,) * k)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance; None without any."""
    k, some = len(fitted.variances), fitted.variances > 0
    if not some.any():
        return None
    total = _tree(vectors.mapInArrow(_products(fitted), "part long, values array<double>"), lambda rows: rows.sum(axis=0), 1 + k + k * k).ravel()
    means, products = total[1 : k + 1] / total[0], total[k + 1 :].reshape(k, k) / total[0]
    return float(np.abs(products - np.outer(means, means) - np.eye(k))[np.ix_(some, some)].max())


def whiten(table: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening, float | None]:
    """(rows, what was fitted, identity error): for each sound row of ``table`` its id, ``whitened`` (array<double>) and ``deviation``.

    Rows whose vector is null or holds null or non-finite entries are left out; all others are fitted on
    and returned, repeated rows and null ids too. Shorter vectors are filled up with zeros to the
    longest one's length. There are ``components`` components, or as many as there are dimensions if
    those are fewer; one without variance (rank lost, or all rows alike) is null in ``whitened``.
    deviation, the sum of (n x - S)^2, is null if it has over 63 bits; entries of over 2^54 in size count as
    that. An empty table gives no row. Other columns are not read.
    """
    rows = table.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(_sound(F.col("vector")))
    fitted = fit(rows, components)
    error = identity_error(rows, fitted)
    out = StructType([StructField("id", rows.schema["id"].dataType), StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    return rows.mapInArrow(fitted.batches, out).withColumnRenamed("id", id), fitted, error
