"""Substring dedup by repeated-phrase automata.

Documents are dealt into blocks of a few megabytes. Of the phrases of ``phrase`` words in a
window of ``window`` words, the one with the least hash is the window's anchor, so equal
windows have equal anchors. Three passes over the same shuffled blocks:

1. each block reports its anchors, each once and with a place where it stands, and those seen in
   two documents are confirmed as recurring;
2. the confirmed phrases come back as shards, one for each block that may hold them. A block
   compiles the words of its shard into an Aho-Corasick automaton and streams all its documents
   through it. The automaton's hits are the phrases' occurrences, and the windows anchored at a
   hit are reported, each once, by a 128-bit hash and a place, with the first document it starts in;
3. windows that start in two documents are the recurring passages. They go back to their blocks,
   which compile the passages' anchors, stream all documents through that automaton, compare the
   words of the windows at its hits with the passages' own and remove the words covered by a
   window whose first document is a smaller one.

A block reports an anchor or window once, so that one which a third of all documents share
meets in as many rows as there are blocks, not documents.

Cases: null and empty texts have no words, nothing removed and an empty kept text; repeated
rows with one id never remove each other; texts shorter than a window are kept whole; rows
without an id are left out; an empty table gives an empty result; columns to be carried along may
have any names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 4 << 20
#: Places whose words are looked at together.
_ROWS = 1 << 15
#: Odd multipliers of the two polynomial hashes, and those of the final mix (splitmix64).
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Block:
    """The words of a block's documents, end to end."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        numbers = _Numbers()
        self.doc = ids
        self.words = [t.split() for t in texts]
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.number = [list(map(numbers.__getitem__, w)) for w in self.words]
        self.flat = flat = np.fromiter((x for w in self.number for x in w), dtype=np.int32, count=int(size.sum()))
        table = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), dtype=np.uint64, count=len(numbers))
        self.hash = table[flat] if len(flat) else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(size)), size)

    def rolled(self, length: int, base: int) -> np.ndarray:
        """Hash of the ``length`` words from each position on (across document ends too)."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            out, have, power, step = None, 0, self.hash, 1
            factor = np.uint64(base)
            rest = length
            while rest:
                if rest & 1:  # append the block of ``step`` words after those had so far
                    tail = power[have:]
                    out = tail if out is None else out[: len(tail)] * factor + tail
                    have += step
                rest >>= 1
                if rest:
                    power = power[:-step] * factor + power[step:] if len(power) > step else power[:0]
                    factor, step = factor * factor, step * 2
            out = out[:n].copy()
            out ^= out >> np.uint64(30)
            out *= np.uint64(_MIX[0])
            out ^= out >> np.uint64(27)
            out *= np.uint64(_MIX[1])
            out ^= out >> np.uint64(31)
        return out

    def starts(self, length: int) -> np.ndarray:
        """Which positions begin ``length`` words of one document."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, bool)
        return np.arange(n) + length <= self.end[self.owner[:n]]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


#: A block's number, a place in it and whether two of its documents share what stands there, in one number.
_PLACE_BITS = 32


def _reference(block: int, at: np.ndarray, many: np.ndarray) -> pa.Array:
    return pa.array((np.int64(block) << (_PLACE_BITS + 1)) | (at.astype(np.int64) << 1) | many)


def _place(reference: np.ndarray) -> np.ndarray:
    return (reference >> 1) & ((1 << _PLACE_BITS) - 1)


def _once(hashes: tuple[np.ndarray, ...], at: np.ndarray, doc: np.ndarray) -> tuple:
    """Each distinct hash once: hashes, first place, smallest doc, whether there are two docs."""
    order = np.lexsort((at, doc, *hashes[::-1]))
    hashes, at, doc = tuple(h[order] for h in hashes), at[order], doc[order]
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for h in hashes:
        new[1:] |= h[1:] != h[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return tuple(h[first] for h in hashes), at[first], doc[first], doc[first] < doc[last]


def anchors(block: Block, window: int, phrase: int) -> tuple:
    """((hashes,), places, smallest doc, whether there are two docs) of the block's anchors."""
    ok = block.starts(window)
    hashes = block.rolled(phrase, _BASES[0])
    least = _sliding_min(hashes, window - phrase + 1)[: len(ok)]
    keep = ok.copy()
    keep[1:] &= (least[1:] != least[:-1]) | (block.owner[1 : len(ok)] != block.owner[: len(ok) - 1]) | ~ok[:-1]
    at = anchor_places(hashes, np.flatnonzero(keep), window, phrase)
    return _once((hashes[at],), at, block.doc[block.owner[at]])


def anchor_places(hashes: np.ndarray, at: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Where the windows at places ``at`` have their anchors."""
    reach = np.arange(window - phrase + 1)
    return np.concatenate([x + hashes[x[:, None] + reach].argmin(1) for x in np.array_split(at, len(at) // _ROWS + 1)])


def located(block: Block, places: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Places of the windows anchored at an occurrence of the phrases that stand at ``places``.

    The occurrences are the hits of an automaton over all the block's documents.
    """
    ok = block.starts(window)
    if not len(places) or not len(ok):
        return np.empty(0, np.int64)
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for i, d in zip(places.tolist(), block.owner[places].tolist()):
        k = i - int(block.begin[d])
        machine.add_word(tuple(block.number[d][k : k + phrase]))
    machine.make_automaton()
    hashes = block.rolled(phrase, _BASES[0])
    hit = np.zeros(len(hashes), bool)
    for begin, numbers in zip(block.begin.tolist(), block.number):
        if len(numbers) >= window:
            ends = np.fromiter((e for e, _ in machine.iter(tuple(numbers))), dtype=np.int64)
            hit[begin + ends - phrase + 1] = True
    width = window - phrase + 1
    least, least_hit = (_sliding_min(x, width)[: len(ok)] for x in (hashes, np.where(hit, hashes, np.iinfo(np.uint64).max)))
    return np.flatnonzero(ok & (least == least_hit))


def same_words(block: Block, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words at places ``a`` and ``b`` are the same."""
    out, step = np.ones(len(a), bool), np.arange(length)
    for k in range(0, len(a), _ROWS):
        x, y = a[k : k + _ROWS], b[k : k + _ROWS]
        out[k : k + _ROWS] = (block.flat[x[:, None] + step] == block.flat[y[:, None] + step]).all(1)
    return out


def _block_of(table: pa.Table) -> tuple[Block, pa.Table]:
    """A block's words and rows, in an order that doesn't depend on how the rows came."""
    common.let_go()
    ids, texts = table.column("doc_id").to_numpy(), common.text_bytes(table.column("text"))
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64), ids))
    return Block(ids[order], [texts[i] for i in order.tolist()]), table.take(pa.array(order))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carried) for each row; ``kept``: remaining words, joined by a space.

    ``carried`` is a struct of the columns named in ``carry``.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    if not 0 < phrase < window:
        raise ValueError("a phrase has fewer words than a window, and one at least")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES), 2 * common.shuffle_partitions(spark))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("carried")).where(F.col("doc_id").isNotNull())
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), *rows.columns)
    out = rows.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), "carried").schema

    def report_anchors(key, table):
        block, _ = _block_of(table)
        (h,), at, lo, many = anchors(block, window, phrase)
        return pa.table({"h": _signed(h), "ref": _reference(key[0].as_py(), at, many), "lo": pa.array(lo)})

    def report_windows(key, docs, phrases):
        if not len(docs) or not len(phrases):
            return pa.table({c: common.long_array([]) for c in ("w1", "w2", "ref", "lo")})
        block, _ = _block_of(docs)
        at = located(block, _place(phrases.column("ref").to_numpy()), window, phrase)
        (w1, w2), at, lo, many = _once((block.rolled(window, _BASES[0])[at], block.rolled(window, _BASES[1])[at]), at, block.doc[block.owner[at]])
        return pa.table({"w1": _signed(w1), "w2": _signed(w2), "ref": _reference(key[0].as_py(), at, many), "lo": pa.array(lo)})

    def remove(key, docs, passages):
        block, docs = _block_of(docs)
        gone = np.zeros(len(block.flat) + 1, dtype=np.int32)
        if len(passages) and len(block.flat):
            r1, r2, lo = (passages.column(c).to_numpy() for c in ("w1", "w2", "lo"))
            order = np.lexsort((r2, r1))
            r1, r2, lo, place = r1[order], r2[order], lo[order], _place(passages.column("ref").to_numpy())[order]
            at = located(block, np.unique(anchor_places(block.rolled(phrase, _BASES[0]), place, window, phrase)), window, phrase)
            w1, w2 = (block.rolled(window, b).view(np.int64)[at] for b in _BASES)
            k = np.searchsorted(r1, w1)
            which = np.full(len(at), -1)
            live = np.arange(len(at))
            while len(live):  # equal first halves lie side by side
                live = live[k[live] < len(r1)]
                live = live[r1[k[live]] == w1[live]]
                hit = r2[k[live]] == w2[live]
                which[live[hit]] = k[live[hit]]
                live = live[~hit]
                k[live] += 1
            found = np.flatnonzero(which >= 0)
            at, which = at[found], which[found]
            use = (lo[which] < block.doc[block.owner[at]]) & same_words(block, at, place[which], window)
            at = at[use]
            gone[at] += 1
            np.subtract.at(gone, at + window, 1)
        gone = np.cumsum(gone[:-1]) > 0
        kept, n_removed = [], []
        for words, a, b in zip(block.words, block.begin, block.end):
            g = gone[a:b]
            n = int(g.sum())
            n_removed.append(n)
            kept.append(b" ".join(words) if not n else b" ".join([w for w, x in zip(words, g.tolist()) if not x]))
        return pa.table(
            {"doc_id": pa.array(block.doc), "n_words": pa.array(block.end - block.begin), "n_removed": common.long_array(n_removed), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "carried": docs.column("carried")}
        )

    def recurring(reports, *by):
        """Reports of what two documents hold, without blocks that hold it in the first of them alone, each in its block."""
        of = Window.partitionBy(*by)
        first, two = F.min("lo").over(of), F.max(F.col("ref").bitwiseAND(1)).over(of) == 1
        seen = reports.withColumns({"first": first, "many": two | (F.max("lo").over(of) > first)}).where("many")
        return seen.select(F.shiftright("ref", _PLACE_BITS + 1).cast("int").alias("block"), *by, "ref", "lo", "first")

    phrases = recurring(dealt.groupBy("block").applyInArrow(report_anchors, "h long, ref long, lo long"), "h").select("block", "ref")
    passages = recurring(dealt.groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(report_windows, "w1 long, w2 long, ref long, lo long"), "w1", "w2")
    passages = passages.where((F.col("lo") > F.col("first")) | (F.col("ref").bitwiseAND(1) == 1)).select("block", "w1", "w2", "ref", F.col("first").alias("lo"))
    return dealt.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(remove, out)
