"""Lexical retrieval packing.

Documents are encoded, dealt into shards by a lexical key (the least of a fixed random ranking
of their tokens, so that alike documents tend to meet), and each shard builds a BM25 inverted
index over its documents' tokens with document frequencies and lengths of the whole corpus. A
shard then takes its documents one after another as seeds; a seed's query is all its distinct
tokens, and the index returns its unused neighbours, which fill the seed's window greedily. The last neighbour is cut where the
window ends and its rest stays unused, so all windows but a shard's last are full; the last
one is split into sequences whose lengths are powers of two, which need no padding.

What reaches the driver is bounded by the vocabulary (one frequency for each token id).

Cases: null and empty texts are the end id alone; documents longer than a window fill windows
of their own first; repeated rows are packed like any other; rows without an id are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

#: Tokens that a shard holds on average.
SHARD_TOKENS = 4 << 20
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Tokens in a larger part of a shard's documents have a dense row of weights, which takes at most 1/DENSE as many cells as there are postings.
DENSE = 0.25
_ENCODED = ["doc_id", "n_tokens", "key", "ids", "df"]
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ranking(size: int) -> np.ndarray:
    return np.random.default_rng(7).permutation(size).astype(np.int32)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, key, ids, df): compressed ids of each row, the end id included.

    One more row of each task, without doc_id, has in ``df`` the compressed numbers of its rows that hold each token.
    """
    common.ship_package(docs.sparkSession)

    def run(batches):
        enc, press = bpe.encoder(path), zstandard.ZstdCompressor(level=3)
        rank, end = _ranking(len(enc.tokens)), np.array([end_id], enc.dtype)
        df = np.zeros(len(enc.tokens), np.int64)
        for b in batches:
            n, key, ids = [], [], []
            for ends, flat in enc.encode_slices(b.column(1)):
                counts = _frequencies(ends, flat, len(df))
                counts[end_id] = len(ends) - 1  # a text may hold it too
                df += counts
                starts = ends[:-1][np.diff(ends) > 0]
                least = np.zeros(len(ends) - 1, np.int64)
                if len(starts):
                    least[np.diff(ends) > 0] = np.minimum.reduceat(rank[flat], starts)
                key.append(least)
                n.append(np.diff(ends) + 1)
                ids += [press.compress(flat[i:j].tobytes() + end.tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            if ids:
                columns = [b.column(0), common.long_array(np.concatenate(n)), pa.array(np.concatenate(key).astype(np.int32)), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())]
                yield pa.record_batch(columns, names=_ENCODED)
        if df.any():
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([press.compress(df.tobytes())], pa.binary())]
            yield pa.record_batch(columns, names=_ENCODED)

    return common.documents_of(docs).mapInArrow(run, "doc_id long, n_tokens long, key int, ids binary, df binary")


def _frequencies(ends: np.ndarray, flat: np.ndarray, size: int) -> np.ndarray:
    """In how many of the runs ends[k] .. ends[k + 1] of ``flat`` each token is."""
    pairs = np.repeat(np.arange(len(ends) - 1, dtype=np.int64) * size, np.diff(ends)) + flat
    if (len(ends) - 1) * size < 1 << 32:
        pairs = pairs.astype(np.uint32)  # sorted faster
    pairs.sort()
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    return np.bincount((pairs[first] % size).astype(np.int64), minlength=size)


def _plain(packed: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=dtype)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(token, df) over all rows of ``encoded``."""

    def run(batches):
        total = 0
        for b in batches:
            for packed in b.column(0).to_pylist():
                total = total + _plain(packed, np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(np.atleast_1d(total)[at], pa.int64())], names=["token", "df"])

    return rows.where("doc_id is null").select("df").mapInArrow(run, "token int, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Shard:
    """One shard's documents, its inverted index and its greedy filling."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float):
        self.ids = ids
        self.size = np.array([len(x) for x in ids], dtype=np.int64)
        self.done = np.zeros(len(ids), dtype=np.int64)
        self.mark = 0
        terms, counts, docs = [], [], []
        for d, x in enumerate(ids):
            t, c = np.unique(x, return_counts=True)
            terms.append(t)
            counts.append(c.astype(np.float32))
            docs.append(np.full(len(t), d, np.int32))
        term, tf, doc = np.concatenate(terms), np.concatenate(counts), np.concatenate(docs)
        norm = (K1 * (1 - B + B * self.size / average)).astype(np.float32)
        weight = idf[term].astype(np.float32) * tf * np.float32(K1 + 1) / (tf + norm[doc])
        self.terms = terms
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        common_terms = np.flatnonzero(np.diff(self.first) > DENSE * len(ids))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common_terms] = np.arange(len(common_terms))
        self.dense = np.zeros((len(common_terms), len(ids)), np.float32)
        for row, t in zip(self.dense, common_terms):
            a, b = self.first[t], self.first[t + 1]
            row[self.doc[a:b]] = self.weight[a:b]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for the query of all the seed's distinct tokens."""
        score, terms = np.zeros(len(self.ids), np.float32), self.terms[seed]
        row = self.row[terms]
        for r in row[row >= 0].tolist():
            score += self.dense[r]
        rare = terms[row < 0].astype(np.int64)
        for a, b in zip(self.first[rare].tolist(), self.first[rare + 1].tolist()):
            score[self.doc[a:b]] += self.weight[a:b]
        return score

    def neighbours(self, seed: int):
        """Unused documents with a token of the seed's, the highest BM25 score first."""
        score = self.scores(seed)
        score[self.done >= self.size] = 0
        some = min(32, len(score))
        top = np.argpartition(-score, some - 1)[:some]
        top = top[np.lexsort((top, -score[top]))]
        yield from top[score[top] > 0].tolist()
        score[top] = 0
        if (score > 0).any():
            rest = np.flatnonzero(score > 0)
            yield from rest[np.argsort(-score[rest], kind="stable")].tolist()

    def pack(self, window: int):
        """(sequence, doc, start, length, offset) of each piece."""
        made = 0
        for d in range(len(self.ids)):
            while self.size[d] - self.done[d] >= window:
                yield made, d, int(self.done[d]), window, 0
                self.done[d] += window
                made += 1
        for seed in range(len(self.ids)):
            while self.done[seed] < self.size[seed]:
                pieces, room = [], window
                for d in self._fillers(seed):
                    take = int(min(room, self.size[d] - self.done[d]))
                    if take:
                        pieces.append((d, int(self.done[d]), take))
                        self.done[d] += take
                        room -= take
                    if not room:
                        break
                made = yield from self._cut(pieces, window - room, window, made)

    def _fillers(self, seed: int):
        yield seed
        yield from self.neighbours(seed)
        # too few neighbours: the next unused documents; those before the mark are all used up
        self.mark = max(self.mark, seed + 1)
        while self.mark < len(self.ids):
            if self.done[self.mark] < self.size[self.mark]:
                yield self.mark
            if self.done[self.mark] < self.size[self.mark]:
                return  # the window is full
            self.mark += 1

    @staticmethod
    def _cut(pieces: list, total: int, window: int, made: int):
        """One full window, or sequences of power-of-two lengths."""
        lengths = [window] if total == window else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        at, room = 0, lengths[0]
        for d, start, n in pieces:
            while n:
                take = min(n, room)
                yield made, d, start, take, lengths[at] - room
                start, n, room = start + take, n - take, room - take
                if not room:
                    made, at = made + 1, at + 1
                    room = lengths[at] if at < len(lengths) else 0
        return made


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens; columns as in the query."""
    spark = docs.sparkSession
    table = common.materialize(encoded(docs, path, end_id), "packing-ids")
    rows = table.where("doc_id is not null")
    enc = bpe.encoder(path)
    size, dtype = len(enc.tokens), enc.dtype.str
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).first()
    n, tokens = stats["n"], stats["tokens"] or 0
    df = np.zeros(size)
    for r in document_frequencies(table).collect():  # at most one row for each token id
        df[r["token"]] = r["df"]
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    average = tokens / max(1, n)

    def run(batches):
        doc_id, key, ids = [], [], []
        for b in batches:
            doc_id += b.column(0).to_pylist()
            key += b.column(1).to_pylist()
            ids += [_plain(x, dtype) for x in b.column(2).to_pylist()]
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda i: (key[i], doc_id[i], len(ids[i])))
        doc_id, ids = [doc_id[i] for i in order], [ids[i] for i in order]
        base = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        for seq, d, start, length, offset in Shard(ids, idf.value, average).pack(window):
            crc = zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes())
            out.append((doc_id[d], start, length, crc, len(ids[d]), base + seq, offset))
        yield pa.record_batch([common.long_array(c) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    shards = max(1, -(-tokens // SHARD_TOKENS))
    return rows.select("doc_id", "key", "ids").repartitionByRange(shards, "key", "doc_id").mapInArrow(run, _COLUMNS)
