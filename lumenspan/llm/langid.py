"""Language ID by word-first backoff.

A word that the training rows know is scored by its log frequency in each language; an unseen
word by its longest known character n-grams (4, then 3, 2, 1 characters, word ends included).
A document's score is the sum over its words, turned into a probability.

The model is fitted on a sample of labelled rows: at most about ``docs_per_language`` rows of
each language, chosen by a hash of the id; words and n-grams seen fewer than ``least_count`` times
in it are left to the backoff. That bounds it, and it is broadcast. Words are runs of letters and
of other characters of words (such as numerals and marks) with a letter among them.

Cases: null text and text without a letter get ``und`` and score 0, and so does every row where
nothing was learned; ties go to the language that sorts first; rows without an id are left out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DOCS_PER_LANGUAGE = 2000
LEAST_COUNT = 3
LONGEST = 4
UNKNOWN_WORDS = 150_000
#: Words that are looked up at once; room for that many unseen ones is made before.
CHUNK_WORDS = 100_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with both ends marked."""
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, least_count: int = LEAST_COUNT) -> dict:
    """The model of rows (doc_id, text, lang): languages, and the log-probability rows of words and n-grams."""
    common.ship_package(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"id": uuid.uuid4().hex, "languages": [], "rows": {}, "table": np.zeros((1, 0), np.float32)}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
    chance = F.xxhash64(F.col("doc_id"), F.lit(11)).bitwiseAND((1 << 30) - 1) / float(1 << 30)

    def count(batches):
        common.let_go()
        for b in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            for lang, seen in words.items():
                parts: list[Counter] = [Counter() for _ in range(LONGEST + 1)]
                seen = Counter({w: c for w, c in seen.items() if has_letter(w)})
                parts[0] = seen
                for w, c in seen.items():
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            parts[n][g] += c
                for n, part in enumerate(parts):
                    yield pa.record_batch(
                        [pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()), pa.array(list(part), pa.string()), common.long_array(list(part.values()))],
                        names=["lang", "size", "gram", "n"],
                    )

    counted = rows.where(chance < share[F.col("lang")]).select("text", "lang").mapInArrow(count, "lang string, size int, gram string, n long")
    counted = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    languages = sorted(sizes)
    at = {k: i for i, k in enumerate(languages)}
    names: dict[tuple, int] = {}
    where, which, much = [], [], []
    for b in counted.toArrow().to_batches():
        for lang, size, gram, n in zip(*(c.to_pylist() for c in b.columns)):
            where.append(names.setdefault((size, gram), len(names) + 1))
            which.append(at[lang])
            much.append(n)
    table = np.zeros((len(names) + 1, len(languages)))
    table[where, which] = much
    level = np.array([-1] + [k[0] for k in names])
    for size in range(LONGEST + 1):
        own = level == size
        if own.any():
            part = table[own] + 0.5
            part = np.log(part / part.sum(axis=0))
            table[own] = part - np.logaddexp.reduce(part, axis=1)[:, None]
    return {"id": uuid.uuid4().hex, "languages": languages, "rows": names, "table": table.astype(np.float32)}


class Scorer(dict):
    """Row numbers of words; those of unseen words are worked out by backoff when first asked for."""

    def __init__(self, model: dict):
        super().__init__({g: i for (size, g), i in model["rows"].items() if size == 0})
        self.grams = {k: i for k, i in model["rows"].items() if k[0]}
        self.languages = model["languages"]
        self.known = len(model["table"])
        self.table = np.concatenate([model["table"], np.zeros((UNKNOWN_WORDS, len(self.languages)), np.float32)])
        self.unseen: list[str] = []

    def __missing__(self, word: str) -> int:
        if not has_letter(word):
            return 0
        at = self.known + len(self.unseen)
        self.table[at] = self.backoff(word)
        self.unseen.append(word)
        self[word] = at
        return at

    def make_room(self, n: int) -> None:
        """Forget the unseen words if fewer than ``n`` more fit; row numbers taken before are void then."""
        if len(self.unseen) + n > UNKNOWN_WORDS:
            for w in self.unseen:
                del self[w]
            self.unseen = []

    def backoff(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            found = [i for g in grams(word, n) if (i := self.grams.get((n, g)))]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text and self.languages else []
        total, letters = np.zeros(len(self.languages)), False
        step = min(CHUNK_WORDS, UNKNOWN_WORDS)
        for k in range(0, len(words), step):
            chunk = words[k : k + step]
            self.make_room(len(chunk))
            at = np.fromiter(map(self.__getitem__, chunk), dtype=np.int64)
            letters |= bool(at.any())
            total += self.table[at].sum(axis=0, dtype=np.float64)
        if not letters:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _scorer(sent) -> Scorer:
    """This worker's scorer of a broadcast model."""
    return common.held(("languages", sent.value["id"]), lambda: Scorer(sent.value))


def annotate(docs: DataFrame, model: dict, text_col: str = "text", name: str = "predicted") -> DataFrame:
    """``docs`` with all its columns and, last, a struct ``name`` of lang and score; no column may have that name."""
    spark = docs.sparkSession
    common.ship_package(spark)
    if common.fresh(name, docs.columns) != name:
        raise ValueError(f"there is a column {name!r} already")
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.select("*", F.struct(F.lit("").alias("lang"), F.lit(0.0).alias("score")).alias(name)).schema

    def run(batches):
        scorer = _scorer(sent)
        for b in batches:
            out = [scorer.predict(t) for t in b.column(at).to_pylist()]
            both = pa.StructArray.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["lang", "score"])
            yield pa.record_batch([*b.columns, both], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text."""
    out = annotate(common.documents_of(docs), model)
    return out.select("doc_id", F.col("predicted.lang").alias("lang_pred"), F.col("predicted.score").alias("score"))
