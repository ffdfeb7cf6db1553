"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Each text becomes two blocks of hashed counts: its words, and its words' shapes with signs of
repetition. A truncated decomposition of a bounded labelled sample maps them to a few latent
dimensions. The sample's vectors are broadcast; each document's cosines with all of them are
computed exactly, block by block, and the labels of the nearest are weighted by similarity.

The sample holds at most about ``per_class`` rows of each label, chosen by a hash of the id;
votes are weighted back to the labels' shares among all labelled rows.

Cases: null and empty texts, and all where nothing was learned, get the share of label 1 (0.5
where there is no label); equal distances keep the sample's order; rows without an id are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS = 2000
WORD_BUCKETS, SHAPE_BUCKETS, DIMENSIONS, NEIGHBOURS = 3072, 1024, 64, 25
SIZE = WORD_BUCKETS + SHAPE_BUCKETS
#: The words' block weighs less than the shapes', which say more of quality.
WORD_WEIGHT = 0.4
SHARPNESS = 6
BLOCK = 512
CACHE_WORDS = 200_000
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"))
_CACHE: "Buckets"


def shape(word: str) -> str:
    """Letters by case, digits as one 9, other characters in runs of two at most."""
    out = _RUNS[0][0].sub(lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][:1].isupper() else "x", word)
    return re.sub(r"(.)\1{2,}", r"\1\1", _RUNS[1][0].sub("9", out))


class Buckets(dict):
    """The two feature numbers of a word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        out = (
            xxhash.xxh64_intdigest(text.strip(".,;:!?\"'()").lower().encode()) % WORD_BUCKETS,
            WORD_BUCKETS + xxhash.xxh64_intdigest(shape(text).encode(), 1) % (SHAPE_BUCKETS - 2),
        )
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_CACHE = Buckets()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of one whole text; the last two count words and lines that repeat."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    pairs = np.array(list(map(_CACHE.__getitem__, words)), dtype=np.int32)
    count = np.bincount(pairs.ravel(), minlength=SIZE)
    count[SIZE - 2] = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    count[SIZE - 1] = len(lines) - len(set(lines))
    at = np.flatnonzero(count)
    return at.astype(np.int32), count[at].astype(np.float32)


def weighted(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by idf, each block of length one (words: ``WORD_WEIGHT``)."""
    v = np.log1p(count) * idf[at]
    w = at < WORD_BUCKETS
    for own, weight in ((w, WORD_WEIGHT), (~w, 1.0)):
        n = np.sqrt((v[own] ** 2).sum())
        if n:
            v[own] *= weight / n
    return v


def fit(labelled: DataFrame, docs: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model of ``labelled`` (doc_id, label 0 or 1) and the documents that it names."""
    spark = docs.sparkSession
    common.ship_package(spark)
    rows = labelled.where("doc_id is not null and label in (0, 1)")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if not sizes:
        return {"share": share, "vectors": np.zeros((0, 1), np.float32)}
    rate = F.when(F.col("label") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    chosen = rows.where(F.xxhash64(F.col("doc_id"), F.lit(13)).bitwiseAND((1 << 30) - 1) / float(1 << 30) < rate).select("doc_id", "label")

    def extract(batches):
        for b in batches:
            got = [features(t) for t in common.text_bytes(b.column(1))]
            yield pa.record_batch(
                [b.column(0), b.column(2), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())],
                names=["doc_id", "label", "at", "count"],
            )

    # the sample's ids are bounded by per_class
    sample = common.documents_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    got = sorted(sample.mapInArrow(extract, "doc_id long, label int, at binary, count binary").collect())
    sparse = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["count"], np.float32)) for r in got]
    label = np.array([r["label"] for r in got], dtype=np.int32)
    if not len(label):
        return {"share": share, "vectors": np.zeros((0, 1), np.float32)}
    df = np.zeros(SIZE)
    for at, _ in sparse:
        df[at] += 1
    idf = (np.log1p(len(sparse)) - np.log1p(df) + 1).astype(np.float32)
    x = np.zeros((len(sparse), SIZE), np.float32)
    for i, (at, count) in enumerate(sparse):
        x[i, at] = weighted(at, count, idf)
    q = x @ np.random.default_rng(5).standard_normal((SIZE, DIMENSIONS + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x @ (x.T @ np.linalg.qr(q)[0]))
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    project = np.ascontiguousarray(vt[:DIMENSIONS].T)
    vectors = x @ project
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    weight = np.array([sizes.get(k, 0) / max(1, (label == k).sum()) for k in (0, 1)])[label]
    return {"share": share, "idf": idf, "project": project, "vectors": vectors, "label": label, "weight": weight}


def votes(vectors: np.ndarray, model: dict) -> np.ndarray:
    """The weighted share of label 1 among each vector's nearest labelled ones."""
    cos = np.maximum(vectors @ model["vectors"].T, 0)
    k = min(NEIGHBOURS, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.take_along_axis(cos, near, axis=1).astype(np.float64) ** SHARPNESS * model["weight"][near]
    total = w.sum(axis=1)
    return np.where(total > 0, (w * model["label"][near]).sum(axis=1) / np.where(total > 0, total, 1), model["share"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    spark = docs.sparkSession
    common.ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            texts = common.text_bytes(b.column(1))
            for at in range(0, len(texts), BLOCK):
                part = texts[at : at + BLOCK]
                out = np.full(len(part), m["share"])
                if len(m["vectors"]):
                    v = np.zeros((len(part), m["project"].shape[1]), np.float32)
                    for i, t in enumerate(part):
                        f, c = features(t)
                        if len(f):
                            v[i] = weighted(f, c, m["idf"]) @ m["project"][f]
                    size = np.linalg.norm(v, axis=1)
                    live = size > 0
                    if live.any():
                        out[live] = votes(v[live] / size[live, None], m)
                yield pa.record_batch([b.column(0).slice(at, len(part)), pa.array(out)], names=["doc_id", "score"])

    return common.documents_of(docs).mapInArrow(run, "doc_id long, score double")
