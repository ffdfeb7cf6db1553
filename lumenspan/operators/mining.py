"""Template mining that no single task does alone: leaves of the prefix tree, mined by themselves and merged.

A line's leaf is its scope, its length and its first words, of which a node keeps the first ``CHILDREN``
different ones and sends all others to a wildcard. That is found by grouping and ranking distinct words, so only
a leaf's own distinct lines have to meet. In a leaf they are taken in order: a line widens the template that is
most like it, from ``SIMILARITY`` on, or makes a new one; templates that widen to the same text are one from then
on, the younger an alias of the older. A leaf of more than ``CHUNK`` lines is dealt into blocks by a hash of the line;
the blocks' templates are then mined like lines, in the order in which they were made, until one block is left.
Blocks hang on the lines alone, so results don't hang on partitions, and a task holds a block's templates and a batch.

A template's identity is the moment and log of the line that made it, and stays when its text widens. With
``most``, a scope's first templates, that many, have a name and all further lines are ``__other__``: the moment of the last one
that fits is looked for first, in each scope's first lines, then leaves are mined and make none after it. (A place that
an alias frees is not given anew.) Lines that fall under none of them are not left at that: in each leaf they are taken in
order into templates of their own, of any number, which are told apart by ``rest``. With ``most``, a leaf of more than ``CHUNK``
lines is not dealt into blocks but mined as if by one task (``_long``).
``live`` says which templates a miner that keeps the ``TENANT_TEMPLATES`` last used would hold.

``state`` saves templates and nodes; a run that starts from them goes on as if it hadn't stopped, for lines that are
new to it. Null bodies have no words; lines without a word have no template, and count as ``__other__`` where ``most`` is set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .settle import settled

#: The tree's depth, different words of a node, the least likeness, templates of a tenant's miner.
DEPTH, CHILDREN, SIMILARITY, TENANT_TEMPLATES = 4, 100, 0.4, 50_000
#: Lines, or templates, that one task takes in order.
CHUNK = 20_000
#: Rows that a task has as Python objects at once, going in and coming out.
SLICE = 500
#: Of a scope's lines so many are looked at first for the moment of the last template that fits, then ``MORE`` times as many.
FIRST, MORE = 1_000, 8
WILD, OTHER = "<*>", "__other__"
SERVICE = ["tenant_id", "service_name"]


class Leaf:
    """Templates of lines of one length, as rows of word numbers; 0 is the wildcard."""

    def __init__(self, length: int):
        self.words: dict[str, int] = {WILD: 0}
        self.texts = np.zeros((8, length), dtype=np.int32)
        self.alive = np.zeros(8, dtype=bool)
        self.made: list[tuple[int, int]] = []
        self.last: list[int] = []
        self.n: list[int] = []
        self.heir: dict[int, int] = {}
        self.changed: list[int] = []  # templates that the last line made, widened or folded

    def _row(self, words) -> np.ndarray:
        """Numbers of words, -1 of those that no template has."""
        return np.array([self.words.get(w, -1) for w in words], dtype=np.int32)

    def add(self, words, made: tuple[int, int], last: int, n: int) -> int:
        k = len(self.made)
        if k == len(self.texts):
            self.texts, self.alive = np.concatenate([self.texts, np.zeros_like(self.texts)]), np.concatenate([self.alive, np.zeros_like(self.alive)])
        self.texts[k], self.alive[k] = [self.words.setdefault(w, len(self.words)) for w in words], True
        self.made.append(made)
        self.last.append(last)
        self.n.append(n)
        return k

    def take(self, words, made: tuple[int, int], last: int, n: int, may_make: bool = True) -> int:
        """The number of the template that a line falls under, which it may widen or make; -1 if none."""
        k, row = len(self.made), self._row(words)
        self.changed.clear()
        if k:
            alike = ((self.texts[:k] == row) | (self.texts[:k] == 0)).mean(axis=1)
            alike[~self.alive[:k]] = -1
            best = int(alike.argmax())
            if alike[best] >= SIMILARITY:
                self.n[best], self.last[best] = self.n[best] + n, max(self.last[best], last)
                return self._widen(best, row)
        if not may_make:
            return -1
        self.changed.append(k)
        return self.add(words, made, last, n)

    def _widen(self, best: int, row: np.ndarray) -> int:
        wider = np.where(self.texts[best] == row, row, 0)
        if (wider == self.texts[best]).all():
            return best
        self.texts[best] = wider
        self.changed.append(best)
        same = np.flatnonzero((self.texts[: len(self.made)] == wider).all(axis=1) & self.alive[: len(self.made)])
        if len(same) < 2:
            return best
        old, young = sorted((int(k) for k in same[:2]), key=lambda k: self.made[k])
        self.n[old], self.last[old] = self.n[old] + self.n[young], max(self.last[old], self.last[young])
        self.n[young], self.alive[young], self.heir[young] = 0, False, old
        if young != best:
            self.changed.append(young)
        return old

    def results(self) -> Iterator[tuple]:
        """(words, made, last, n, made of the one it is an alias of) of each template."""
        names = list(self.words)
        for k in range(len(self.made)):
            heir = k
            while heir in self.heir:
                heir = self.heir[heir]
            yield [names[w] for w in self.texts[k]], self.made[k], self.last[k], self.n[k], self.made[heir] if heir != k else (None, None)


@dataclass
class Mined:
    """What a run found, over a scope's columns."""

    lines: DataFrame  # (scope, line, n, rest, made_at, made_log): each distinct line and the template that it fell under, null if none
    templates: DataFrame  # (scope, leaf, words, rest, made_at, made_log, last_at, n, alias_at, alias_log); rest: of lines beyond ``most`` templates
    nodes: DataFrame  # (scope, size, path, word): words that nodes know


def _distinct_lines(logs: DataFrame, scope: list[str]) -> DataFrame:
    masked = logs.select(*scope, F.unix_micros("timestamp").alias("at"), "log_id", S.mask_tokens(F.coalesce("body", F.lit(""))).alias("words"))
    rows = masked.groupBy(*scope, "words").agg(F.min(F.struct("at", "log_id")).alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    return rows.select(*scope, F.md5(F.array_join("words", " ")).alias("key"), "words", F.col("first.at").alias("at"), F.col("first.log_id").alias("log"), "last", "n")


def _leaves(lines: DataFrame, scope: list[str], known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(lines with their ``leaf``, nodes): paths are found over distinct heads of lines, level by level."""
    by = [*scope, "size", "path"]
    heads = lines.groupBy(*scope, F.size("words").alias("size"), F.slice("words", 1, DEPTH).alias("head")).agg(F.min(F.struct("at", "log")).alias("first"))
    heads = settled(heads.withColumn("path", F.expr("cast(array() as array<string>)")))
    nodes = []
    for k in range(DEPTH):
        word = F.get("head", F.lit(k))
        here = heads.withColumn("word", word).where("word is not null")
        kids = here.groupBy(*by, "word").agg(F.min("first").alias("first"))
        if known is not None:  # words of an earlier run come first, in any order
            old = known.where(F.size("path") == k).select(*by, "word", F.lit(None).cast(dict(kids.dtypes)["first"]).alias("first"))
            kids = kids.unionByName(old).groupBy(*by, "word").agg(F.when(F.max(F.col("first").isNull()), None).otherwise(F.min("first")).alias("first"))
        own = settled(kids.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("first")))).where(F.col("place") <= CHILDREN).select(*by, "word", F.lit(True).alias("own")))
        nodes.append(own.drop("own"))
        step = F.when(F.col("word").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.when(F.col("own"), F.col("word")).otherwise(WILD))))
        heads = settled(heads.withColumn("word", word).join(own, [*by, "word"], "left").withColumn("path", step).drop("own", "word"))
    leaf = F.concat_ws(" ", F.col("size").cast("string"), "path")
    placed = heads.select(*scope, "size", "head", leaf.alias("leaf"))
    keyed = lines.withColumns({"size": F.size("words"), "head": F.slice("words", 1, DEPTH)})
    return keyed.join(placed, [*scope, "size", "head"]).drop("size", "head"), reduce(DataFrame.unionByName, nodes)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def _batches(rows: Iterator[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    while out := list(islice(rows, SLICE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*out))], schema=kinds)


def _fits(at: int, log: int | None, until: int | None, until_log: int | None) -> bool:
    """Whether a line is no later than the one that made the last template."""
    return until is None or at < until or at == until and (log is None or until_log is not None and log <= until_log)


def _round(items: DataFrame, scope: list[str], most: int | None = None, rest: bool = False) -> DataFrame:
    """Mines each (scope, leaf, block) in order: a row for each item with its template, and one for each template.

    ``items``: (scope, leaf, block, old, rest, key, words, at, log, last, n, until, until_log); old ones are templates of an earlier run.
    A block makes ``most`` templates; with ``rest``, lines that fall under none of them have templates of their own.
    """
    columns = [*scope, "leaf", "key", "words", "rest", "made_at", "made_log", "last_at", "n", "alias_at", "alias_log"]

    taken = [*scope, "leaf", "block", "old", "rest", "key", "words", "at", "log", "last", "n", "until", "until_log"]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        owner, leaf, others = None, None, None

        def texts() -> Iterator[tuple]:
            for mined in (leaf, others) if leaf else ():
                yield from ((*owner[:-1], None, words, mined is others, *made, last, n, *heir) for words, made, last, n, heir in mined.results())

        for *key, old, beyond, name, words, at, log, last, n, until, until_log in _rows(batches, taken):
            if key != owner:
                yield from texts()
                owner, leaf, others = key, Leaf(len(words)), Leaf(len(words))
            if old:
                (others if beyond else leaf).add(words, (at, log), last, n)
            else:
                k, mined = leaf.take(words, (at, log), last, n, _fits(at, log, until, until_log) and (most is None or len(leaf.made) < most)), leaf
                if k < 0 and rest:
                    k, mined = others.take(words, (at, log), last, n), others
                yield (*key[:-1], name, None, mined is others, *(mined.made[k] if k >= 0 else (None, None)), last, n, None, None)
        yield from texts()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([*((c, pa.string()) for c in columns[: len(scope) + 2]), ("words", pa.list_(pa.string())), ("rest", pa.bool_()), *((c, pa.int64()) for c in columns[-6:])])
        return _batches(results(batches), kinds)

    dealt = items.repartition(*scope, "leaf", "block").sortWithinPartitions(*scope, "leaf", "block", F.desc("old"), "at", "log", "key")
    schema = "".join(f"{c} string, " for c in scope) + "leaf string, key string, words array<string>, rest boolean, made_at long, made_log long, last_at long, n long, alias_at long, alias_log long"
    return settled(dealt.mapInArrow(fold, schema))


def _outcome(out: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(each line's template, templates) of a round."""
    templates = out.where("key is null").drop("key")
    step = out.where("key is not null").select(*scope, "leaf", "key", "rest", "made_at", "made_log", "n")
    alias = templates.where("alias_at is not null").select(*scope, "leaf", "made_at", "made_log", "alias_at", "alias_log")
    step = step.join(alias, [*scope, "leaf", "made_at", "made_log"], "left").withColumns({"made_at": F.coalesce("alias_at", "made_at"), "made_log": F.coalesce("alias_log", "made_log")}).drop("alias_at", "alias_log")
    return step, templates


def _mine(lines: DataFrame, scope: list[str], old: DataFrame | None, until: DataFrame | None, most: int | None = None, rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(each line's template, templates): with ``most`` in order, else by rounds until each leaf is one block."""
    none = {"until": F.lit(None).cast("long"), "until_log": F.lit(None).cast("long")}
    items = (lines.join(until, scope, "left") if until is not None else lines.withColumns(none)).withColumns({"old": F.lit(False), "rest": F.lit(False)})
    if most is not None:
        return _capped(items, scope, old, most, rest)
    mapped, before = None, None
    while True:
        sizes = settled(items.groupBy(*scope, "leaf").agg(F.count(F.lit(1)).alias("size")))
        largest = sizes.agg(F.max("size")).first()[0] or 0
        last = largest <= CHUNK or before is not None and largest >= before  # no fewer than before: nothing left to merge in parts
        before = largest
        blocks = F.lit(1) if last else F.ceil(F.col("size") / CHUNK)
        dealt = items.join(sizes, [*scope, "leaf"]).withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).drop("size")
        if last and old is not None:
            dealt = dealt.unionByName(_kept(old, scope).withColumns({"rest": F.lit(False), "block": F.lit(0)}))
        step, templates = _outcome(_round(dealt, scope), scope)
        name = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"))
        if mapped is None:
            mapped = step
        else:
            onto = step.select(*scope, "leaf", F.col("key").alias("via"), F.col("made_at").alias("to_at"), F.col("made_log").alias("to_log"))
            mapped = mapped.withColumn("via", name("made_at", "made_log")).join(onto, [*scope, "leaf", "via"], "left").drop("via", "made_at", "made_log").withColumnsRenamed({"to_at": "made_at", "to_log": "made_log"})
        if last:
            return mapped, templates
        items = templates.where("alias_at is null").select(*scope, "leaf", name("made_at", "made_log").alias("key"), "words", F.col("made_at").alias("at"), F.col("made_log").alias("log"), F.col("last_at").alias("last"), "n")
        items = items.withColumns({**none, "old": F.lit(False), "rest": F.lit(False)})


def _kept(old: DataFrame, scope: list[str]) -> DataFrame:
    """Templates of an earlier run as rows that go before lines."""
    none = F.lit(None).cast("long")
    return old.where("alias_at is null").select(*scope, "leaf", F.lit(True).alias("old"), "rest", F.lit("").alias("key"), "words", F.col("made_at").alias("at"), F.col("made_log").alias("log"), F.col("last_at").alias("last"), "n", none.alias("until"), none.alias("until_log"))


def _capped(items: DataFrame, scope: list[str], old: DataFrame | None, most: int, rest: bool) -> tuple[DataFrame, DataFrame]:
    """(each line's template, templates) where a leaf makes ``most`` templates at most, each leaf's lines in order."""
    by = [*scope, "leaf"]
    large = settled(items.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK).select(*by))
    short, kept = large.isEmpty(), None if old is None else _kept(old, scope)
    small = items if kept is None else items.unionByName(kept)
    mapped, templates = _outcome(_round((small if short else small.join(large, by, "left_anti")).withColumn("block", F.lit(0)), scope, most, rest), scope)
    if short:
        return mapped, templates
    long, made = _long(settled(items.join(large, by, "left_semi")), scope, None if old is None else old.join(large, by, "left_semi"), most, rest)
    return mapped.unionByName(long), templates.unionByName(made)


def _noted(items: DataFrame, scope: list[str]) -> DataFrame:
    """What lines of each (scope, leaf), in order, make of its templates: a version for each one made, widened or folded, since that line.

    ``items``: (scope, leaf, old, key, words, at, log, until, until_log, room), of which old ones are templates; ``room`` more are made at most.
    """
    taken = [*scope, "leaf", "old", "key", "words", "at", "log", "until", "until_log", "room"]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        owner, leaf, known = None, None, 0
        for *key, old, name, words, at, log, until, until_log, room in _rows(batches, taken):
            if key != owner:
                owner, leaf, known = key, Leaf(len(words)), 0
            if old:
                known = leaf.add(words, (at, log), 0, 0) + 1
            else:
                leaf.take(words, (at, log), 0, 0, _fits(at, log, until, until_log) and len(leaf.made) - known < room)
                names = list(leaf.words) if leaf.changed else []
                for k in leaf.changed:
                    yield (*key, [names[w] for w in leaf.texts[k]], name, *leaf.made[k], at, log, *(leaf.made[leaf.heir[k]] if k in leaf.heir else (None, None)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([*((c, pa.string()) for c in [*scope, "leaf"]), ("words", pa.list_(pa.string())), ("line", pa.string()), *((c, pa.int64()) for c in ("made_at", "made_log", "at", "log", "alias_at", "alias_log"))])
        return _batches(results(batches), kinds)

    dealt = items.repartition(*scope, "leaf").sortWithinPartitions(*scope, "leaf", F.desc("old"), "at", "log", "key")
    schema = "".join(f"{c} string, " for c in scope) + "leaf string, words array<string>, line string, made_at long, made_log long, at long, log long, alias_at long, alias_log long"
    return dealt.mapInArrow(fold, schema).withColumn("since", F.struct("at", "log", F.col("line").alias("key"))).drop("at", "log", "line")


def _long(items: DataFrame, scope: list[str], old: DataFrame | None, most: int, rest: bool) -> tuple[DataFrame, DataFrame]:
    """(each line's template, templates) of leaves with many lines: what one task would find that takes all lines of a leaf in order, though none does.

    Templates only widen, so a line that fits one wholly changes nothing, then or later. Of a leaf's other lines only the first ``FIRST`` are
    taken in order, from the first one on that would change a template; what they change is noted with its moment. That goes on until no
    line is left that would change anything: each round changes something, and there are no more changes than words in ``most`` templates.
    Then all lines are laid beside the templates as they were at each line's moment, in any order.
    """
    by, identity, moment = [*scope, "leaf"], [*scope, "leaf", "made_at", "made_log"], F.struct("at", "log", "key")
    none = F.lit(None).cast("long")
    versions = items.limit(0).select(*by, "words", F.col("at").alias("made_at"), F.col("log").alias("made_log"), moment.alias("since"), none.alias("alias_at"), none.alias("alias_log"))
    if old is not None:
        before = F.struct(none.alias("at"), none.alias("log"), F.lit(None).cast("string").alias("key"))
        versions = versions.unionByName(old.where("alias_at is null and not rest").select(*by, "words", "made_at", "made_log", before.alias("since"), none.alias("alias_at"), none.alias("alias_log")))
    versions, left, order = settled(versions), items, Window.partitionBy(*by).orderBy("at", "log", "key")
    while True:
        last = versions.groupBy(*identity).agg(F.max_by(F.struct("words", "alias_at", "alias_log"), "since").alias("x")).select(*identity, "x.*")
        now = settled(last.groupBy(*by).agg(F.collect_list(F.when(F.col("alias_at").isNull(), F.col("words"))).alias("texts"), F.count(F.lit(1)).alias("made")))
        like = F.coalesce(F.array_max(F.transform("texts", lambda t: S.token_similarity(t, F.col("words")))), F.lit(0.0))
        fits = F.col("until").isNull() | (F.struct("at", "log") <= F.struct(F.col("until").alias("at"), F.col("until_log").alias("log")))
        others = left.join(now, by, "left").withColumns({"like": like, "room": F.lit(most) - F.coalesce("made", F.lit(0))}).where(F.col("like") < 1)
        begin = settled(others.where((F.col("like") >= SIMILARITY) | fits & (F.col("room") > 0)).groupBy(*by).agg(F.min(moment).alias("begin")))
        if begin.isEmpty():
            break
        first = others.join(begin, by).where(moment >= F.col("begin")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIRST)
        first = settled(first.select(*by, "old", "key", "words", "at", "log", "until", "until_log", "room"))
        known = last.where("alias_at is null").join(begin, by, "left_semi").select(*by, F.lit(True).alias("old"), F.lit("").alias("key"), "words", F.col("made_at").alias("at"), F.col("made_log").alias("log"), none.alias("until"), none.alias("until_log"), F.lit(0).cast("long").alias("room"))
        versions = settled(versions.unionByName(_noted(first.unionByName(known), scope)))
        left = items.join(settled(first.groupBy(*by).agg(F.max(moment).alias("end"))), by).where(moment > F.col("end")).drop("end")
    till = F.lead("since").over(Window.partitionBy(*identity).orderBy("since"))
    spans = versions.withColumn("till", till).where("alias_at is null").groupBy(*by).agg(F.collect_list(F.struct("made_at", "made_log", "words", "since", "till")).alias("spans"))
    then = F.filter("spans", lambda v: (v["since"] < moment) & (v["till"].isNull() | (moment <= v["till"])))
    likest = F.array_min(F.transform(then, lambda v: F.struct((-S.token_similarity(v["words"], F.col("words"))).alias("unlike"), v["made_at"].alias("made_at"), v["made_log"].alias("made_log"))))
    own = F.get(F.filter("spans", lambda v: v["since"] == moment), F.lit(0))
    placed = items.join(settled(spans), by, "left").withColumns({"likest": likest, "own": own})
    under = lambda c: F.when(F.col("likest.unlike") <= -SIMILARITY, F.col(f"likest.{c}")).otherwise(F.col(f"own.{c}"))
    placed = settled(placed.select(*by, "key", "last", "n", under("made_at").alias("made_at"), under("made_log").alias("made_log")))
    # aliases followed
    final = aliases(last, by)
    mapped = placed.join(final, identity, "left").select(*by, "key", F.lit(False).alias("rest"), F.col("final_at").alias("made_at"), F.col("final_log").alias("made_log"), "last", "n")
    sums = mapped.drop("rest", "key").where("made_at is not null")
    if old is not None:
        sums = sums.unionByName(old.where("alias_at is null and not rest").select(*identity, F.col("last_at").alias("last"), "n").join(final, identity).drop("made_at", "made_log").withColumnsRenamed({"final_at": "made_at", "final_log": "made_log"}))
    sums = sums.groupBy(*identity).agg(F.max("last").alias("last_at"), F.sum("n").alias("n"))
    gone = (F.col("final_at") != F.col("made_at")) | ~F.col("final_log").eqNullSafe(F.col("made_log"))
    templates = last.drop("alias_at", "alias_log").join(final, identity).join(sums, identity, "left").select(*by, "words", F.lit(False).alias("rest"), "made_at", "made_log", F.coalesce("last_at", "made_at").alias("last_at"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(gone, F.col("final_at")).alias("alias_at"), F.when(gone, F.col("final_log")).alias("alias_log"))
    mapped = mapped.drop("last")
    if not rest:
        return mapped, templates
    beyond = items.join(placed.where("made_at is null").select(*by, "key"), [*by, "key"], "left_semi").drop("until", "until_log", "old", "rest")
    more, made = _mine(beyond, scope, None if old is None else old.where("rest"), None)
    return mapped.where("made_at is not null").unionByName(more.withColumn("rest", F.lit(True))), templates.unionByName(made.withColumn("rest", F.lit(True)))


def _moments(lines: DataFrame, scope: list[str], old: DataFrame | None, most: int) -> DataFrame | None:
    """(scope, until, until_log): when, and by which log, a scope's template number ``most`` was made; none where there are fewer.

    What a line makes hangs on the lines before it, so each scope's first lines are mined by themselves, and more of them only
    where they make fewer templates and there are more.
    """
    order, made = Window.partitionBy(*scope).orderBy("at", "log"), Window.partitionBy(*scope).orderBy("made_at", "made_log")
    rest, found, size = lines, None, FIRST
    while True:
        first = settled(rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size))
        _, templates = _mine(first.drop("place"), scope, old, None, most)
        until = settled(templates.withColumn("place", F.row_number().over(made)).where(F.col("place") == most).select(*scope, F.col("made_at").alias("until"), F.col("made_log").alias("until_log")))
        found = until if found is None else found.unionByName(until.join(found, scope, "left_anti"))  # saved templates come up each time
        open_ones = first.where(F.col("place") == size).select(*scope).join(until, scope, "left_anti")
        if open_ones.isEmpty():
            return None if found.isEmpty() else found
        rest, size = rest.join(open_ones, scope, "left_semi"), size * MORE


def mine(logs: DataFrame, scope: list[str] = SERVICE, most: int | None = 10, state: Mined | None = None) -> Mined:
    """Templates of ``logs`` (scope, timestamp, log_id, body) by scope; ``most`` None: any number of them, else so many and those of the rest.

    Equal texts of different leaves are one too, the oldest.
    """
    every = settled(_distinct_lines(logs, scope))
    lines, wordless = every.where(F.size("words") > 0), every.where(F.size("words") == 0)
    placed, nodes = _leaves(lines, scope, state.nodes if state else None)
    placed, old = settled(placed), state.templates if state else None
    mapped, templates = _mine(placed, scope, old, _moments(placed, scope, old, most) if most is not None else None, most, most is not None)
    if old is not None:  # aliases of earlier runs go on
        templates = settled(templates.unionByName(old.where("alias_at is not null").select(*templates.columns)))
    # equal texts of several leaves
    named = templates.where("alias_at is null").select(*scope, "rest", F.md5(F.array_join("words", " ")).alias("text"), F.struct("made_at", "made_log").alias("own"))
    first = named.groupBy(*scope, "rest", "text").agg(F.min("own").alias("heir"))
    later = settled(named.join(first, [*scope, "rest", "text"]).where("heir <> own").select(*scope, "own.*", F.col("heir.made_at").alias("heir_at"), F.col("heir.made_log").alias("heir_log")))
    templates = templates.join(later, [*scope, "made_at", "made_log"], "left").withColumns({"alias_at": F.coalesce("alias_at", "heir_at"), "alias_log": F.coalesce("alias_log", "heir_log")}).drop("heir_at", "heir_log")
    if most is not None:
        none = F.lit(None).cast("long")
        mapped = mapped.select(*scope, "key", "n", "rest", "made_at", "made_log").unionByName(wordless.select(*scope, "key", "n", F.lit(False).alias("rest"), none.alias("made_at"), none.alias("made_log")))
    return Mined(settled(mapped.select(*scope, F.col("key").alias("line"), "n", "rest", "made_at", "made_log")), templates, nodes)


def aliases(templates: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, made_at, made_log, final_at, final_log) of each template: where its aliases lead, of whatever length the chain is; doubling steps, so as many rounds as its logarithm."""
    out = settled(templates.select(*scope, "made_at", "made_log", F.coalesce("alias_at", "made_at").alias("final_at"), F.coalesce("alias_log", "made_log").alias("final_log")))
    while True:
        onto = out.select(*scope, F.col("made_at").alias("final_at"), F.col("made_log").alias("final_log"), F.col("final_at").alias("next_at"), F.col("final_log").alias("next_log"))
        both = settled(out.join(onto, [*scope, "final_at", "final_log"], "left"))
        moves = F.coalesce((F.col("next_at") != F.col("final_at")) | (F.col("next_log") != F.col("final_log")), F.lit(False))
        if both.where(moves).isEmpty():
            return out
        out = both.select(*scope, "made_at", "made_log", F.coalesce("next_at", "final_at").alias("final_at"), F.coalesce("next_log", "final_log").alias("final_log"))


def texts(mined: Mined, scope: list[str]) -> DataFrame:
    """(scope, made_at, made_log, template): each identity ever issued with the text that it stands for now."""
    final = aliases(mined.templates, scope)
    named = mined.templates.select(*scope, F.col("made_at").alias("final_at"), F.col("made_log").alias("final_log"), F.array_join("words", " ").alias("template"))
    return final.join(named, [*scope, "final_at", "final_log"]).select(*scope, "made_at", "made_log", "template")


def mined_lines(logs: DataFrame, scope: list[str] = SERVICE, most: int | None = 10) -> DataFrame:
    """(scope, line, n, template, rest): each distinct masked line (by its md5) under its template's last text; ``rest`` is that text where ``template`` is ``__other__``."""
    mined = mine(logs, scope, most)
    out = mined.lines.withColumnRenamed("rest", "beyond").join(texts(mined, scope), [*scope, "made_at", "made_log"], "left")
    return out.select(*scope, "line", "n", F.when(F.col("beyond"), OTHER).otherwise(F.coalesce("template", F.lit(OTHER))).alias("template"), F.when(F.col("beyond"), F.col("template")).alias("rest"))


def mine_templates(logs: DataFrame, scope: list[str] = SERVICE, most: int | None = 10) -> DataFrame:
    """(scope, template, n, rest, lines): how many lines fall under each template.

    ``__other__`` has a row for each template of the rest: ``rest`` its text, ``lines`` its lines, ``n`` those of all ``__other__``. So
    ``lines`` adds up to all lines; only lines without a word have ``__other__`` and no ``rest``.
    """
    mined = mine(logs, scope, most)
    lines = mined.lines.join(aliases(mined.templates, scope), [*scope, "made_at", "made_log"], "left")
    counts = settled(lines.groupBy(*scope, F.col("rest").alias("beyond"), F.col("final_at").alias("made_at"), F.col("final_log").alias("made_log")).agg(F.sum("n").alias("lines")))
    other = F.col("beyond") | F.col("made_at").isNull()
    all_other = counts.where(other).groupBy(*scope).agg(F.sum("lines").alias("n"))
    named = mined.templates.select(*scope, "made_at", "made_log", F.array_join("words", " ").alias("text"))
    out = counts.join(named, [*scope, "made_at", "made_log"], "left").join(all_other, scope, "left")
    return out.select(*scope, F.when(other, OTHER).otherwise(F.col("text")).alias("template"), F.when(other, F.coalesce("n", "lines")).otherwise(F.col("lines")).alias("n"), F.when(F.col("beyond"), F.col("text")).alias("rest"), "lines")


def live(templates: DataFrame, scope: list[str], most: int = TENANT_TEMPLATES) -> DataFrame:
    """The ``most`` templates of a scope that were used last, and as many of its rest; aliases are none."""
    w = Window.partitionBy(*scope, "rest").orderBy(F.desc("last_at"), F.desc("made_at"), F.desc("made_log"))
    return templates.where("alias_at is null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def line_key(body: Column) -> Column:
    """What stands for a masked line: its md5."""
    return F.md5(F.array_join(S.mask_tokens(F.coalesce(body, F.lit(""))), " "))


def with_template(logs: DataFrame, scope: list[str] = SERVICE, most: int | None = 10) -> DataFrame:
    """``logs`` with the ``template`` that each one's body was mined to, and ``rest``: the template of its own where that is ``__other__``, null without words."""
    return logs.withColumn("line", line_key(F.col("body"))).join(mined_lines(logs, scope, most).select(*scope, "line", "template", "rest"), [*scope, "line"], "left").drop("line")


def save(mined: Mined, path: str, scope: list[str], most: int = TENANT_TEMPLATES) -> None:
    """Write what a later run needs: live templates, all aliases, and nodes."""
    aside = mined.templates.where("alias_at is not null")
    live(mined.templates, scope, most).unionByName(aside).write.mode("overwrite").parquet(f"{path}/templates")
    mined.nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def load(spark, path: str, scope: list[str]) -> Mined:
    templates = spark.read.parquet(f"{path}/templates")
    if "rest" not in templates.columns:  # saved before the rest was mined
        templates = templates.withColumn("rest", F.lit(False))
    return Mined(spark.createDataFrame([], "".join(f"{c} string, " for c in scope) + "line string, n long, rest boolean, made_at long, made_log long"), templates, spark.read.parquet(f"{path}/nodes"))
