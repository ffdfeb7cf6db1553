"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common point within half that radius of both; where
the radius is odd, within half rounded up of the one and rounded down of the other. So each distinct fingerprint stands for all its variants within half the radius, the variants
are dealt out by their low bits, and those that collide in a bucket link their owners. A task
gets a bucket's fingerprints and unfolds the variants there, so the shuffle carries a
fingerprint once for each bucket that its ball touches instead of once for each variant.

A variant's owners that lie within half the radius rounded down of it are within ``radius`` of all
its owners, so links from one of them to all the others keep each link without all pairs of a group.

Cases: null or empty text has fingerprint zero and links like any other; texts of fewer words
than a shingle are one shingle; repeated rows and equal fingerprints fall in one component;
rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Variants that a bucket holds on average, and those that one step in a task unfolds at most.
BUCKET_VARIANTS = 2_000_000
STEP_VARIANTS = 4_000_000
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 4) -> int:
    """The 64-bit fingerprint of one text (UTF-8)."""
    words = text.lower().split()  # on bytes: A-Z only; white space is exactly 20, 09-0D
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    join = b" ".join
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        if len(part) <= shingle:
            hashes = [xxh(join(part), SEED)]
        else:
            hashes = [xxh(join(t), SEED) for t in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint of each row's whole text."""
    common.ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in common.text_bytes(b.column(1))], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def _masks(width: int, most: int) -> list[int]:
    """All masks of ``width`` bits with at most ``most`` of them set."""
    out = [0]
    layer = [(0, 0)]
    for _ in range(most):
        layer = [(m | 1 << i, i + 1) for m, start in layer for i in range(start, width)]
        out += [m for m, _ in layer]
    return out


def ball_collisions(fps: np.ndarray, low_bits: int, value: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all fingerprints sharing a variant whose low bits are ``value``.

    ``fps``: distinct unsigned fingerprints. Where a bucket's variants are too many for one
    step, it is unfolded by further bits, one sub-bucket after another.
    """
    half, inner = (radius + 1) // 2, radius // 2
    ones = np.uint64((1 << low_bits) - 1)
    apart = np.bitwise_count((fps ^ np.uint64(value)) & ones)
    count = sum(int((apart == p).sum()) * sum(math.comb(64 - low_bits, i) for i in range(half - p + 1)) for p in range(half + 1))
    if count > STEP_VARIANTS and low_bits < 60:
        near = np.flatnonzero(apart <= half)
        found = [ball_collisions(fps[near], low_bits + 2, value | (x << low_bits), radius) for x in range(4)]
        a = near[np.concatenate([f[0] for f in found])]
        b = near[np.concatenate([f[1] for f in found])]
        return a, b
    variants, owners, outer = [], [], []
    for p in range(half + 1):
        own = np.flatnonzero(apart == p)
        if len(own):
            flips = np.array(_masks(64 - low_bits, half - p), dtype=np.uint64)
            base = (fps[own] & ~ones) | np.uint64(value)
            variants.append((base[:, None] ^ (flips << np.uint64(low_bits))[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(flips)))
            outer.append(np.tile(np.bitwise_count(flips) + p > inner, len(own)))
    if not variants:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    v, o, far = np.concatenate(variants), np.concatenate(owners), np.concatenate(outer)
    order = np.lexsort((far, v)) if half > inner else np.argsort(v)
    v, o, far = v[order], o[order], far[order]
    begin = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    first = np.repeat(begin, np.diff(np.append(begin, len(v))))  # a variant's first owner: an inner one if it has any
    use = (first != np.arange(len(v))) & ~far[first]
    pairs = np.unique(np.stack([o[first[use]], o[use]], axis=1).astype(np.int64), axis=0)
    pairs = pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius]
    return pairs[:, 0], pairs[:, 1]


def fingerprint_links(distinct: DataFrame, count: int, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep each component whole."""
    half = (radius + 1) // 2
    ball = sum(math.comb(64, i) for i in range(half + 1))
    bits = max(0, min(32, math.ceil(math.log2(max(1, count * ball / BUCKET_VARIANTS)))))
    masks = _masks(bits, half)
    low = (1 << bits) - 1

    def run(key, table):
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        a, b = ball_collisions(fps, bits, key[0].as_py(), radius)
        label = common.local_labels(len(fps), a, b)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table({"a": pa.array(fps[own].view(np.int64)), "b": pa.array(fps[label[own]].view(np.int64))})

    dealt = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseAND(F.lit(low)).bitwiseXOR(F.lit(m)) for m in masks])).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row: components of fingerprints within ``radius`` bits."""
    spark = docs.sparkSession
    common.ship_package(spark)
    prints = common.materialize(fingerprints(docs, shingle), "simhash")
    reps = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    links = fingerprint_links(reps.select("fp"), reps.count(), radius)
    ends = (
        links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a")
        .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    found = common.connected_components(ends, "simhash")
    of = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
