"""Embedding near-dedup by product quantisation.

Equal vectors are collapsed first. Coarse centres and, for the residuals, one small codebook
for each subspace are fitted on a bounded sample (``SAMPLE`` vectors). Each vector goes into
the inverted list of its nearest centre as subspace codes with its quantisation error.

Probes are sufficient, not a fixed number: a vector within distance r of a query that lies in
another list is on the far side of the plane between the two centres, so a list is probed
whenever the query is within r of that plane. As that holds for both vectors of a link, only the
lists from a query's own on are probed, and a link counts for both its ends. In a list,
asymmetric distances come from lookup tables; what they put within r plus the code's own error is
ranked by exact cosine in double precision. No link is lost by either step.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors link with those of their own length only, and each length has lists of its own;
very large and very small components are scaled before they are squared; repeated rows link with
each other; an empty table gives an empty result; rows without an id are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SAMPLE = 20_000
LIST_VECTORS, LEAST_LISTS = 4096, 3
SUBSPACE_DIMS, CODES = 8, 256
#: A length with fewer sampled vectors gets a single list.
LEAST_SAMPLE = 32
_ROWS = 256
_PAIRS = 50_000


def lists(n: int, sampled: int) -> int:
    """Coarse lists of ``n`` vectors: by their number, at least ``LEAST_LISTS``, each from ``LEAST_SAMPLE`` sampled ones."""
    return max(1, min(max(LEAST_LISTS, -(-n // LIST_VECTORS)), sampled // LEAST_SAMPLE))


class Codebook:
    """Coarse centres and subspace codewords of unit vectors; without a sample one list whose code is the origin."""

    def __init__(self, x: np.ndarray, dims: int, lists: int):
        self.parts = np.array_split(np.arange(dims), max(1, -(-dims // SUBSPACE_DIMS)))
        if len(x) < LEAST_SAMPLE:
            self.centres = np.zeros((1, dims), np.float32)
            self.words = [np.zeros((1, len(p)), np.float32) for p in self.parts]
        else:
            self.centres = vectors.kmeans(x, lists).astype(np.float32)
            rest = x.astype(np.float32) - self.centres[self.nearest(x)]
            self.words = [vectors.kmeans(rest[:, p], CODES, seed=5 + i) for i, p in enumerate(self.parts)]
        c = self.centres.astype(np.float64)
        square = (c**2).sum(1)
        self.gap = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 1e-12))

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        return (x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, quantisation error) of unit vectors."""
        cell = self.nearest(x)
        rest = x.astype(np.float32) - self.centres[cell]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        error = np.zeros(len(x))
        for m, p in enumerate(self.parts):
            d = (self.words[m] ** 2).sum(1)[None, :] - 2 * rest[:, p] @ self.words[m].T
            codes[:, m] = d.argmin(1)
            error += ((rest[:, p] - self.words[m][codes[:, m]]) ** 2).sum(1)
        return cell, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> np.ndarray:
        """Which lists from each row's own on may hold a vector within ``reach`` of it."""
        d = self.distances(x)
        at = np.arange(len(d))
        out = (d - d[at, cell][:, None]) / (2 * self.gap[cell]) <= reach + 1e-3
        out &= np.arange(d.shape[1])[None, :] >= cell[:, None]
        out[at, cell] = True
        return out

    def lookup(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each subspace, squared distances of each query's residual to each codeword."""
        rest = x.astype(np.float32) - self.centres[cell]
        return [(rest[:, p] ** 2).sum(1)[:, None] + (w**2).sum(1)[None, :] - 2 * rest[:, p] @ w.T for p, w in zip(self.parts, self.words)]


def _matches(book: Codebook, cell: int, q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, least: float):
    """Index pairs (query, member) with cosine >= ``least``, a few queries at a time."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    limit = (reach + error + 1e-3).astype(np.float32) ** 2
    for at in range(0, len(q), _ROWS):
        part = q[at : at + _ROWS]
        d = np.zeros((len(part), len(x)), np.float32)
        for m, t in enumerate(book.lookup(part, cell)):
            d += np.take(t, codes[:, m], axis=1)
        a, b = np.nonzero(d <= limit[None, :])
        if not len(a):
            continue
        if len(a) > 0.02 * d.size:
            cos = (part @ x.T)[a, b]
        else:
            cos = np.concatenate([(part[a[i : i + _PAIRS]] * x[b[i : i + _PAIRS]]).sum(1) for i in range(0, len(a), _PAIRS)])
        ok = cos >= least
        yield a[ok] + at, b[ok]


def near_duplicates(table: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are cosines of ``least`` or more."""
    spark = table.sparkSession
    common.ship_package(spark)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null")
    valid = rows.where(vectors.is_valid(F.col("embedding")))
    distinct = common.materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "pq-distinct")
    counts = {r["d"]: r["n"] for r in distinct.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known: dict[int, list] = {d: [] for d in counts}
    for v in vectors.sample(distinct, "rep", sum(counts.values()), SAMPLE):
        known[len(v)].append(v)
    books, first = {}, 0
    for d, n in sorted(counts.items()):
        x = vectors.unit(np.array(known[d], dtype=np.float64)) if known[d] else np.zeros((0, d))
        book = Codebook(x, d, lists(n, len(x)))
        books[d] = (book, first)
        first += len(book.centres)
    sent = spark.sparkContext.broadcast(books)
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def code(batches):
        for b in batches:
            for d, at in vectors.by_length(pc.list_value_length(b.column(0)).to_numpy()):
                part = b.take(pa.array(at))
                book, start = sent.value[d]
                x = vectors.unit(vectors.matrix(part.column(0)))
                cell, codes, error = book.encode(x)
                probes = [(start + np.flatnonzero(p)).tolist() for p in book.probes(x, cell, reach)]
                yield pa.record_batch(
                    [part.column(1), part.column(2), part.column(0), pa.array((start + cell).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                    names=["rep", "copies", "embedding", "cell", "codes", "error", "probes"],
                )

    kind = dict(distinct.dtypes)["embedding"]
    coded = common.materialize(
        distinct.select("embedding", "rep", "copies").mapInArrow(code, f"rep long, copies long, embedding {kind}, cell int, codes binary, error double, probes array<int>"), "pq-coded"
    )
    members = coded.select("cell", "rep", "copies", "embedding", "codes", "error")
    queries = coded.select(F.col("cell").alias("home"), F.explode("probes").alias("cell"), "rep", "copies", "embedding").select("cell", (F.col("home") == F.col("cell")).alias("own"), "rep", "copies", "embedding")

    def match(key, own, asks):
        none = pa.table({"edge": pa.array([], pa.bool_()), "a": common.long_array([]), "b": common.long_array([])})
        if not len(own) or not len(asks):
            return none
        x, q = vectors.unit(vectors.matrix(own.column("embedding"))), vectors.unit(vectors.matrix(asks.column("embedding")))
        book, start = sent.value[x.shape[1]]
        codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        copies, mine = own.column("copies").to_numpy(), own.column("rep").to_numpy()
        other_copies, theirs, home = asks.column("copies").to_numpy(), asks.column("rep").to_numpy(), asks.column("own").to_numpy(zero_copy_only=False)
        nodes, at = np.unique(np.concatenate([theirs, mine]), return_inverse=True)
        qi, xi = at[: len(q)], at[len(q) :]
        links, label = np.zeros(len(nodes)), np.arange(len(nodes))
        for a, b in _matches(book, key[0].as_py() - start, q, x, codes, own.column("error").to_numpy(), least):
            apart = theirs[a] != mine[b]
            a, b = a[apart], b[apart]
            links += np.bincount(qi[a], weights=copies[b], minlength=len(nodes))
            away = ~home[a]  # in its own list a pair is met from both ends, elsewhere only from this one
            links += np.bincount(xi[b[away]], weights=other_copies[a[away]], minlength=len(nodes))
            own_edges = np.flatnonzero(label != np.arange(len(nodes)))
            label = common.local_labels(len(nodes), np.concatenate([own_edges, qi[a]]), np.concatenate([label[own_edges], xi[b]]))
        n, e = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table(
            {
                "edge": pa.array(np.repeat([False, True], [len(n), len(e)])),
                "a": pa.array(np.concatenate([nodes[n], nodes[e]])),
                "b": common.long_array(np.concatenate([links[n].astype(np.int64), nodes[label[e]]])),
            }
        )

    dealt, asks = vectors.deal(members, queries, "rep")
    found = common.materialize(dealt.groupBy("cell", "mc", "qc").cogroup(asks.groupBy("cell", "mc", "qc")).applyInArrow(match, "edge boolean, a long, b long"), "pq-links")
    linked = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = common.connected_components(found.where("edge").select("a", "b"), "pq").select(F.col("node").alias("rep"), "component")
    of = distinct.select("embedding", "rep", "copies").join(linked, "rep", "left").join(parts, "rep", "left")
    of = of.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("part"))
    good = valid.join(of, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("part").alias("component_id"))
    bad = rows.where(~vectors.is_valid(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
