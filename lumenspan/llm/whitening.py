"""Whitening of embeddings: moments merged pair by pair, an eigenbasis, and a second pass that verifies.

An entry c counts as the integer x = floor(64 c) + 1,000,000. Each partition works out how many
vectors it has, their mean and the scatter about that mean; Chan's formula merges two such moments
into one, in a tree of tasks, so that what meets at the driver is a handful of matrices of
length x length however large the table is. Means are kept as exact sums of integers, so the
difference of two means is rounded once, and nothing is multiplied before it is centred. The driver takes
the covariance's eigenvectors; a second pass merges the moments of the whitened vectors in the same way and
says how far their covariance is from the identity.

Cases: vectors that are null, or hold a null or non-finite entry, or one of 2**56 or more (which x could
not hold), go; zero vectors, repeated rows and rows with a null id stay and count as often as they stand;
vectors of another length are a space of their own, with its own count (``MOST_LENGTHS`` at most, an error
beyond); an empty vector has no component. A component without variance (as all are where there is one
vector, or only copies of one) has a null whitened value, and the identity is not asked of it; where no
component has variance, the error is 0. A deviation that does not fit a long is null. Components of equal
variance may be turned within their plane. An empty table gives no rows; other columns are left behind. Vectors of a
length that was not fitted, in a table other than the fitted one, have nulls beside their id.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, vectors

#: Fixed values of the contract: scale and offset of the integers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MOST_LENGTHS = 64
#: Moments that one task of the tree merges.
FAN_IN = 8


@dataclass
class Moments:
    """Of some vectors: count, exact or double sums, and scatter about their mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """Of the rows of ``x``; integers are summed exactly."""
        exact = x.dtype.kind == "i"
        small = not exact or not x.size or int(np.abs(x).max()) * len(x) < 1 << 62
        sums = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
        centred = x - (sums / len(x)).astype(np.float64)
        return Moments(len(x), sums.astype(object) if exact else sums, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula."""
        n, weight = self.n + other.n, self.n * other.n
        apart = ((other.sums * self.n - self.sums * other.n) / weight).astype(np.float64)
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (weight / n))


@dataclass
class Space:
    """The fitted basis of vectors of one length."""

    n: int
    sums: np.ndarray
    basis: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues, falling; zero where there is no variance
    explained: np.ndarray
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return self._scaled(x) / self.n

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        most = max(int(np.abs(x).max()) * self.n, max(abs(int(s)) for s in self.sums))
        return x * self.n - self.sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """A column for each component that has variance."""
        kept = self.values > 0
        return self.centred(x).astype(np.float64) @ (self.basis[:, kept] / np.sqrt(self.values[kept]))

    def deviation(self, x: np.ndarray) -> list:
        """The sum of (n x - S)^2 for each row; None where a long can't hold it."""
        a = self._scaled(x)
        about = (a.astype(np.float64) ** 2).sum(axis=1) / 2.0**63
        out: list = [None] * len(x)
        fits = about < 1 - 1e-9
        for k, v in zip(np.flatnonzero(fits), (a[fits].astype(np.int64) ** 2).sum(axis=1)):
            out[k] = int(v)
        for k in np.flatnonzero(~fits & (about < 1 + 1e-9)):  # too near to tell in doubles
            v = sum(int(y) ** 2 for y in a[k])
            out[k] = v if v < 1 << 63 else None
        return out


def remaining(column: Column) -> Column:
    """Not null, and all entries finite and small enough for a long."""
    return F.coalesce(column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 56))), F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE).astype(np.int64) + OFFSET


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x-vectors) of each length of a batch but 0."""
    for d, rows in vectors.by_length(column.value_lengths().to_numpy(zero_copy_only=False)):
        if d:
            yield d, rows, integers(vectors.matrix(column.take(pa.array(rows))))


def _merged(a: dict, b: dict) -> dict:
    out = a | {d: a[d].merge(m) if d in a else m for d, m in b.items()}
    if len(out) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    return out


def _moments(rows: DataFrame, view) -> dict[int, Moments]:
    """The moments of ``view(length, x-vectors)`` over all rows, by length: one record for each partition, merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            found = _merged(found, {d: Moments.of(view(d, x)) for d, _, x in _by_length(b.column(0))})
        yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], names=["moments"])

    parts = rows.mapInArrow(local, "moments binary").rdd.map(lambda r: pickle.loads(r["moments"]))
    n = parts.getNumPartitions()
    return parts.treeReduce(_merged, depth=max(2, math.ceil(math.log(max(n, 2), FAN_IN)))) if n else {}


def _space(m: Moments, components: int) -> Space:
    values, basis = np.linalg.eigh(m.scatter / m.n)
    values, basis = values[::-1], basis[:, ::-1]
    values = np.where(values > len(values) * np.finfo(np.float64).eps * max(values[0], 0), values, 0.0)
    top = np.abs(basis).argmax(axis=0)
    basis = basis * np.where(basis[top, np.arange(basis.shape[1])] < 0, -1.0, 1.0)  # a sign of its own for each component
    total = np.trace(m.scatter) / m.n
    explained = values / total if total > 0 else np.zeros_like(values)
    return Space(m.n, m.sums, basis[:, :components], values[:components], explained[:components])


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length of vectors, verified: ``error`` is the largest entry of the whitened covariance less the identity."""
    spark = table.sparkSession
    common.ship_package(spark)
    rows = table.where(remaining(F.col(column))).select(F.col(column).cast("array<double>").alias("v"))
    spaces = {d: _space(m, components) for d, m in _moments(rows, lambda d, x: x).items()}
    held = spark.sparkContext.broadcast(spaces)
    for d, m in _moments(rows, lambda d, x: held.value[d].whitened(x)).items():
        spaces[d].error = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max(initial=0.0))
    return spaces


def whiten(table: DataFrame, spaces: dict[int, Space], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of each remaining row; two are lists with an entry for each component."""
    spark = table.sparkSession
    common.ship_package(spark)
    rows = table.where(remaining(F.col(column)) & (F.size(column) > 0)).select(id_col, F.col(column).cast("array<double>").alias("v"))
    held = spark.sparkContext.broadcast(spaces)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _by_length(b.column(1)):
                space = held.value.get(d)
                if space is None:
                    yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([d] * len(x), pa.int32()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.float64()))], names=[id_col, "d", "deviation", "whitened"])
                    continue
                values = np.full((len(x), len(space.values)), np.nan)
                values[:, space.values > 0] = space.whitened(x)
                flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32()), flat)
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array([d] * len(x), pa.int32()), pa.array(space.deviation(x), pa.int64()), listed], names=[id_col, "d", "deviation", "whitened"])

    shape = T.StructType([rows.schema[id_col], T.StructField("d", T.IntegerType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = rows.mapInArrow(project, shape)
    of = lambda what, empty: F.create_map(*[c for d, s in spaces.items() for c in (F.lit(d), what(s))])[F.col("d")] if spaces else F.lit(None).cast(empty)
    return out.select(
        id_col, of(lambda s: F.lit(s.n).cast("long"), "long").alias("n"), "deviation", "whitened",
        of(lambda s: F.array(*[F.lit(float(e)) for e in s.explained]), "array<double>").alias("explained"), of(lambda s: F.lit(s.error), "double").alias("identity_error"),
    )
