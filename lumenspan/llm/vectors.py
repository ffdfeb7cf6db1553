"""What the two vector operators share: valid rows, bounded samples, dealing by cell and chunk."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members, and queries, that one group of a cell gets on average at most.
CHUNK_MEMBERS, CHUNK_QUERIES = 4096, 32768


def is_valid(column: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, id_col: str, count: int, most: int) -> list[list]:
    """About ``most`` of ``count`` vectors, chosen by a hash of the id and in its order."""
    chance = F.xxhash64(F.col(id_col), F.lit(29)).bitwiseAND((1 << 30) - 1) / float(1 << 30)
    got = vectors.where(chance < min(1.0, most / max(1, count))).select(id_col, "embedding").collect()
    return [r["embedding"] for r in sorted(got, key=lambda r: r[id_col])]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(lengths: np.ndarray):
    """(length, row numbers) of each length among a batch's rows."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(lengths[rows[0]]), rows


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centres of plain k-means; an empty one moves to the point farthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
        near = d.argmin(1)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = size > 0
        centres[full] = total[full] / size[full, None]
        if not full.all():
            far = np.argsort(-d[np.arange(len(x)), near] - (x**2).sum(1))
            centres[~full] = x[far[: (~full).sum()]]
    return centres


def deal(members: DataFrame, queries: DataFrame, id_col: str, chunk: int = CHUNK_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns (cell, mc, qc) to cogroup by.

    ``members`` has a row in its own ``cell``; ``queries`` has one for each cell that it probes.
    Cells of any size are cut into chunks of members and of queries by a hash of the id, and
    each chunk of queries meets each chunk of members once. The counts of cells, of which there
    are at most as many as the fitted sample allows, come to the driver.
    """
    sizes = {r["cell"]: r["n"] for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        none = F.lit(0)
        return (x.withColumns({"mc": none, "qc": none}) for x in (members, queries))
    mc = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / chunk))])
    qc = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(max(1, asked.get(c, 0)) / CHUNK_QUERIES))])
    cell, key = F.col("cell"), F.xxhash64(F.col(id_col), F.lit(31))
    dealt = members.withColumn("mc", F.pmod(key, mc[cell]).cast("int")).withColumn("qc", F.explode(F.sequence(F.lit(0), qc[cell] - 1)))
    asks = queries.where(mc[cell].isNotNull()).withColumn("qc", F.pmod(key, qc[cell]).cast("int")).withColumn("mc", F.explode(F.sequence(F.lit(0), mc[cell] - 1)))
    return dealt, asks
