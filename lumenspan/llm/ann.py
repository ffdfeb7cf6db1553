"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors) a neighbour graph by inner product is cut into equal
parts, level by level, at the median of each part's second eigenvector. A small softmax
classifier learns to name a vector's part. It files every row into its most probable part, and
routes each query to several of the most probable ones, as many as the sample's own neighbours
needed for ``RECALL``; candidates there are ranked by exact inner products in double precision.
A task holds a bundle of parts next to each other in the cutting, so that a query reports its
nearest once for all of the bundle's parts that it visits, not once for each.

A table has at least ``LEAST_PARTS`` parts, however small (but each is learned from 32 sampled
vectors), so the same method answers at every size. There are at most ``MOST_PARTS`` parts, as their graph and classifier are fitted on a bounded
sample: beyond ``MOST_PARTS * PART_VECTORS`` vectors the parts grow with the table, and so does the
work for each query. No row is left out.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of each length have parts of their own, as others have no inner product with them; every
row is a candidate, and a query if its id is one, also where rows repeat an id, and only the
query's own row is left out of its answer; ties go to the smaller id; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

SAMPLE = 8192
PART_VECTORS, LEAST_PARTS, MOST_PARTS = 2048, 8, 256
GRAPH_NEIGHBOURS = 10
RECALL = 0.97
#: A bundle has two to this power of parts, and is dealt out in chunks beyond so many members.
BUNDLE_BITS, BUNDLE_MEMBERS = 2, 16384
_ROWS = 256


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row to its ``k`` largest inner products."""
    k = min(k, len(x) - 1)
    heads = []
    for at in range(0, len(x), _ROWS):
        s = x[at : at + _ROWS] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        heads.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.repeat(np.arange(len(x)), k), np.concatenate(heads).ravel()


def balanced_parts(n: int, a: np.ndarray, b: np.ndarray, levels: int, rounds: int = 60) -> np.ndarray:
    """Part of each node: the graph is halved ``levels`` times at the median of a Fiedler vector."""
    part = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(9)
    for _ in range(levels):
        inside = part[a] == part[b]
        u, v = a[inside], b[inside]
        degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n) + 1e-9
        root = np.sqrt(degree)
        y = rng.standard_normal(n)
        count = part.max() + 1
        for _ in range(rounds):
            # take out each part's first eigenvector, then one step of the normalised walk
            y -= root * (np.bincount(part, root * y, count) / np.bincount(part, degree, count))[part]
            z = y / root
            y = 0.5 * y + 0.5 * (np.bincount(u, z[v], n) + np.bincount(v, z[u], n)) / root
            y /= np.linalg.norm(y) + 1e-30
        order = np.lexsort((y / root, part))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        size = np.bincount(part, minlength=count)
        begin = np.cumsum(size) - size
        part = part * 2 + (place - begin[part] >= (size[part] + 1) // 2)
    return part


class Router:
    """Softmax regression from unit vectors to parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 300, rate: float = 4.0):
        self.w, self.b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        speed_w, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        goal = np.eye(parts)[part]
        for _ in range(rounds):
            error = (self.probabilities(x) - goal) / len(x)
            speed_w = 0.9 * speed_w - rate * (x.T @ error + 1e-5 * self.w)
            speed_b = 0.9 * speed_b - rate * error.sum(0)
            self.w, self.b = self.w + speed_w, self.b + speed_b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, count: int, k: int) -> tuple[Router, int]:
    """The router of a sample, and how many parts a query should visit."""
    levels = 0
    while (2 << levels) <= min(MOST_PARTS, len(x) // 32) and ((1 << levels) < LEAST_PARTS or (PART_VECTORS << levels) < count):
        levels += 1
    u = vectors.unit(x)
    if not levels:
        return Router(u[:1], np.zeros(1, np.int64), 1, 1), 1
    part = balanced_parts(len(x), *neighbour_graph(x, GRAPH_NEIGHBOURS), levels)
    router = Router(u, part, 1 << levels)
    # how many visits find the sample's own neighbours, as filed by the router
    chance = router.probabilities(u)
    filed = chance.argmax(1)
    asked = np.arange(0, len(x), max(1, len(x) // 2048))
    head, tail = neighbour_graph(x, min(k, len(x) - 1))
    near = tail.reshape(len(x), -1)[asked]
    rank = np.argsort(np.argsort(-chance[asked], axis=1), axis=1)
    needed = np.take_along_axis(rank, filed[near], axis=1) + 1
    visits = next(m for m in range(1, chance.shape[1] + 1) if (needed <= m).mean() >= RECALL)
    return router, visits


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row."""
    spark = table.sparkSession
    common.ship_package(spark)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null")
    rows = rows.where(vectors.is_valid(F.col("embedding"))).withColumn("row", F.monotonically_increasing_id())
    rows = common.materialize(rows.select("vec_id", "embedding", "row"), "ann-rows")
    counts = {r["d"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    known: dict[int, list] = {d: [] for d in counts}
    for v in vectors.sample(rows, "vec_id", sum(counts.values()), SAMPLE):
        known[len(v)].append(v)
    models, first, within = {}, 0, (1 << BUNDLE_BITS) - 1
    for d, n in sorted(counts.items()):
        router, visits = fit(np.array(known[d] or [[1.0] * d], dtype=np.float64), n, k)
        models[d] = (router, visits, first)
        first = (first + len(router.b) + within) & ~within  # no bundle holds parts of two lengths
    sent = spark.sparkContext.broadcast(models)
    kind = dict(rows.dtypes)["embedding"]

    def chances(batches):
        """Each batch's rows of one length, their routers' probabilities and the number of their first part."""
        for b in batches:
            for d, at in vectors.by_length(pc.list_value_length(b.column(1)).to_numpy()):
                part = b.take(pa.array(at))
                router, visits, start = sent.value[d]
                yield part, router.probabilities(vectors.unit(vectors.matrix(part.column(1)))), visits, start

    def file(batches):
        for b, p, _, start in chances(batches):
            yield pa.record_batch([*b.columns, pa.array((start + p.argmax(1)).astype(np.int32))], names=["vec_id", "embedding", "row", "cell"])

    members = common.materialize(rows.mapInArrow(file, f"vec_id long, embedding {kind}, row long, cell int"), "ann-filed")
    sizes = np.zeros(max(1, first), np.int64)
    for r in members.groupBy("cell").count().collect():  # one row for each part
        sizes[r["cell"]] = r["count"]

    def route(batches):
        for b, p, visits, start in chances(batches):
            order = np.argsort(-p, axis=1, kind="stable")
            # further parts for a query whose own ones hold too few rows
            want = np.maximum(visits, (np.cumsum(sizes[start + order], axis=1) < k + 1).sum(1) + 1)
            yield pa.record_batch([*b.columns, pa.array([(start + o[:m]).tolist() for o, m in zip(order, want)], pa.list_(pa.int32()))], names=["vec_id", "embedding", "row", "cells"])

    routed = rows.where(is_query).mapInArrow(route, f"vec_id long, embedding {kind}, row long, cells array<int>")
    bundles = F.array_distinct(F.transform("cells", lambda c: F.shiftright(c, BUNDLE_BITS)))
    queries = routed.select("vec_id", "embedding", "row", "cells", F.explode(bundles).alias("cell"))
    held = members.select("vec_id", "embedding", "row", F.col("cell").alias("part"), F.shiftright("cell", BUNDLE_BITS).alias("cell"))

    def rank(key, own, asks):
        found = [[], [], [], []]
        if len(own) and len(asks):
            x, q = vectors.matrix(own.column("embedding")), vectors.matrix(asks.column("embedding"))
            ids, who = own.column("vec_id").to_numpy(), asks.column("vec_id").to_numpy()
            mine, asking = own.column("row").to_numpy(), asks.column("row").to_numpy()
            part = own.column("part").to_numpy() & within
            cells = asks.column("cells").combine_chunks()
            visited, by = cells.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(cells).to_numpy())
            here = visited >> BUNDLE_BITS == key[0].as_py()
            visits_part = np.zeros((len(q), within + 1), bool)
            visits_part[by[here], visited[here] & within] = True
            for at in range(0, len(q), _ROWS):
                s = q[at : at + _ROWS] @ x.T
                s[(asking[at : at + _ROWS, None] == mine[None, :]) | ~visits_part[at : at + _ROWS][:, part]] = -np.inf
                top = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
                for i, row in enumerate(s):
                    # all that rounding in the product may have put below the last place
                    limit = least[i] - 1e-9 * (1 + abs(least[i])) if np.isfinite(least[i]) else least[i]
                    near = np.flatnonzero((row >= limit) & (row > -np.inf))
                    exact = (x[near] * q[at + i]).sum(1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    found[0].append(np.full(len(best), asking[at + i]))
                    found[1].append(np.full(len(best), who[at + i]))
                    found[2].append(ids[near[best]])
                    found[3].append(exact[best])
        a, b, c, d = (np.concatenate(f) if f else np.empty(0) for f in found)
        return pa.table({"row": common.long_array(a), "query_id": common.long_array(b), "vec_id": common.long_array(c), "score": pa.array(d.astype(np.float64))})

    dealt, asks = vectors.deal(held, queries, "row", BUNDLE_MEMBERS)
    hits = dealt.groupBy("cell", "mc", "qc").cogroup(asks.groupBy("cell", "mc", "qc")).applyInArrow(rank, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
