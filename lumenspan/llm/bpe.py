"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur nowhere inside a token of the vocabulary can't be merged, so
a word can be cut between them: its fragments are encoded independently and their ids are
concatenated. Only a word's last fragment carries the end-of-word suffix.

Words are the pieces between ASCII white space; no normaliser or split pattern of a word-level
vocabulary looks across it. Plain words are cut together, as columns. Each worker
keeps the ids of recent fragments (at most ``CACHE_WORDS``), so that a frequent one is merged once.

Cases: null counts as empty; empty texts have no ids and decode to an empty text; special
tokens in a text are found as the library finds them; rows without an id are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from . import common

CACHE_WORDS = 600_000
#: Ids, or characters, that one Arrow batch of results holds at most (a single document may have more).
BATCH_IDS = 1 << 20
#: Bytes of text whose words are looked up together.
LOOKUP_BYTES = 4 << 20
#: Printable ASCII and the letters of Latin-1, on which normalisation is lower-casing alone.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: What splits the letters of such a text.
_PLAIN_MARK = "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9ß-öø-ÿ]+)"
_PLAIN_NORMALIZERS = ("NFC", "Replace", "Lowercase")
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Recent(dict):
    """A cache that keeps what was used lately: entries move on to the next generation when asked for again."""

    def __init__(self, work, size: int):
        super().__init__()
        self.work, self.size, self.old = work, size // 2, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.work(key)
            if len(key) > 64:
                return out
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _places(first: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, places): runs first[c] .. first[c] + size[c] of each code c, one after another."""
    each = size[code]
    upto = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(first[code] - upto[:-1], each)
    at += np.arange(len(at))
    return upto, at


class Encoder:
    """Encodes with forced boundaries by one vocabulary file, and decodes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        # its parts are kept, not its own copy of the vocabulary and merges
        self.normalizer, self.pre_tokenizer, self.decoder = library.normalizer, library.pre_tokenizer, library.decoder
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("post_processor") or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("forced boundaries need a byte-level BPE vocabulary without unknown tokens")
        suffix = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        # no caches of their own: words come here once
        self.last = BPE(vocab, merges, end_of_word_suffix=suffix, cache_capacity=0) if suffix else BPE(vocab, merges, cache_capacity=0)
        self.inner = BPE(vocab, merges, cache_capacity=0) if suffix else self.last
        names = [t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t in vocab]
        self.joined = {t[i : i + 2] for t in names for i in range(len(t) - 1)}
        size = library.get_vocab_size(with_added_tokens=True)
        self.tokens = [library.id_to_token(i) or "" for i in range(size)]
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        added = spec.get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or re.search(r"\s", t["content"]) for t in added):
            raise ValueError("special tokens that depend on their surroundings are not supported")
        self.specials = {t["content"]: self.bytes[t["id"]] for t in added}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if added else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.plain = tuple(x["type"] for x in steps) == _PLAIN_NORMALIZERS and split.get("pattern", {}).get("Regex") == _PLAIN_SPLIT
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.joined_bytes = np.array([[a + b in self.joined for b in self.alphabet.values()] for a in self.alphabet.values()])
        self.chunks = Recent(self.chunk, CACHE_WORDS // 8)
        self.tails = Recent(lambda f: self.merged(self.last, self.shown(f)), CACHE_WORDS)
        self.inner_ids = Recent(lambda f: self.merged(self.inner, f), CACHE_WORDS // 8)
        self.last_ids = Recent(lambda f: self.merged(self.last, f), CACHE_WORDS // 8)

    def cut(self, word: str) -> list[str]:
        """The fragments of one word (in the byte alphabet) between certain cuts."""
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merged(self, model: BPE, fragment: str) -> bytes:
        """Ids of one fragment by the vocabulary's merges."""
        bytes_of = self.bytes
        return b"".join([bytes_of[t.id] for t in model.tokenize(fragment)])

    def word(self, word: str) -> bytes:
        """Ids of one word in the byte alphabet: its fragments' ids, one after another."""
        if self.joined.issuperset(map(add, word, word[1:])):
            return self.merged(self.last, word)
        *inner, last = self.cut(word)
        return b"".join([*map(self.inner_ids.__getitem__, inner), self.last_ids[last]])

    def piece(self, text: str) -> bytes:
        """Ids of a text without special tokens, by the library's own normaliser and split."""
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return b"".join([self.word(w) for w, _ in self.pre_tokenizer.pre_tokenize_str(text)])

    def chunk(self, text: str) -> bytes:
        """Ids of a piece of text between ASCII white space."""
        if self.special and "<" in text and self.special.search(text):
            return b"".join([self.specials.get(p) or self.piece(p) for p in self.special.split(text) if p])
        return self.piece(text)

    def shown(self, fragment: bytes) -> str:
        """Some bytes of printable text in the byte alphabet."""
        return fragment.decode() if fragment.isascii() else fragment.decode("latin-1").translate(self.alphabet)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids) of distinct words: word k has size[k] ids from first[k] on.

        Plain words are lower-cased, split and cut as columns; the others go by ``chunk``.
        """
        plain = pc.match_substring_regex(words, _PLAIN) if self.plain else pa.array(np.zeros(len(words), bool))
        for special in self.specials:
            plain = pc.and_not(plain, pc.match_substring(words, special))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _PLAIN_MARK, r" \1 "))
        coded = lists.flatten().dictionary_encode()
        first, size, ids = self.encode_parts(coded.dictionary)
        upto, at = _places(first, size, coded.indices.to_numpy(zero_copy_only=False))
        ends = upto[lists.offsets.to_numpy()]
        other_size, other_ids = self.joined_ids(self.chunks, words.filter(pc.invert(plain)))
        plain = plain.to_numpy(zero_copy_only=False)
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[plain], size[plain] = ends[:-1], np.diff(ends)
        first[~plain], size[~plain] = len(at) + np.cumsum(other_size) - other_size, other_size
        return first, size, np.concatenate([ids[at], other_ids])

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode_words`` of words, marks and digits of plain lower-case text, all cut into fragments at once."""
        raw = np.frombuffer(b"".join(parts.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint8)
        ends = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
        last, mark = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        last[ends] = True
        mark[1:-1] = ~self.joined_bytes[raw[:-1], raw[1:]]
        mark |= last
        mark[0] = False
        upto = np.concatenate([[0], np.cumsum(mark)[ends]])  # fragments before each part
        stops = np.flatnonzero(mark)
        fragments = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32)), pa.py_buffer(raw)])
        last = last[stops]
        tail = fragments.filter(pa.array(last)).dictionary_encode()
        inner = fragments.filter(pa.array(~last)).dictionary_encode()
        tail_size, tail_ids = self.joined_ids(self.tails, tail.dictionary)
        inner_size, inner_ids = self.joined_ids(self.inner_ids, pa.array(map(self.shown, inner.dictionary.to_pylist()), pa.string()))
        size, code = np.concatenate([tail_size, inner_size]), np.empty(len(stops), np.int64)
        code[last] = tail.indices.to_numpy(zero_copy_only=False)
        code[~last] = len(tail_size) + inner.indices.to_numpy(zero_copy_only=False)
        until, at = _places(np.cumsum(size) - size, size, code)
        ends = until[upto]
        return ends[:-1], np.diff(ends), np.concatenate([tail_ids, inner_ids])[at]

    def joined_ids(self, cache: Recent, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of some words by one cache, and the ids."""
        found = list(map(cache.__getitem__, words.to_numpy(zero_copy_only=False).tolist()))
        return np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize, np.frombuffer(b"".join(found), dtype=self.dtype)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids) of a column of texts, null as empty: text k has ids[ends[k]:ends[k + 1]].

        Each distinct word of the column is encoded once; numpy puts the ids together.
        """
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        first, size, ids = self.encode_words(coded.dictionary)
        upto, at = _places(first, size, coded.indices.to_numpy(zero_copy_only=False))
        bounds = lists.offsets.to_numpy()
        return upto[bounds - bounds[0]], ids[at]

    def encode_slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode_column`` of a column a few megabytes at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, before + LOOKUP_BYTES, side="right")))
            yield self.encode_column(texts.slice(at, stop - at))
            at = stop

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column."""
        for ends, ids in self.encode_slices(texts):
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield ids[a:b]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[1]

    def decode(self, ids) -> str:
        """The library's text of some ids, special tokens included."""
        tokens = list(map(self.tokens.__getitem__, ids))
        return self.decoder.decode(tokens) if self.decoder is not None else " ".join(tokens)


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    return common.held(("encoder", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text."""
    common.ship_package(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            at, ids, n = 0, [], 0
            for k, x in enumerate(enc.encode_all(b.column(1))):
                ids.append(x)
                n += len(x)
                if n >= BATCH_IDS or k + 1 == b.num_rows:
                    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids).astype(np.int32))
                    yield pa.record_batch([b.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])
                    at, ids, n = k + 1, [], 0

    return common.documents_of(docs, text_col=text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids (doc_id, ids)."""
    common.ship_package(encoded.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            column = b.column(1)
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            at, texts, n = 0, [], 0
            for k in range(len(ends) - 1):
                texts.append(enc.decode(flat[ends[k] : ends[k + 1]].tolist()))
                n += len(texts[-1])
                if n >= 4 * BATCH_IDS or k + 2 == len(ends):
                    yield pa.record_batch([b.column(0).slice(at, len(texts)), column.slice(at, len(texts)), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    at, texts, n = k + 1, [], 0

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
