"""A stored inverted index of log lines: postings sorted by term, in segments that are appended, removed from and merged.

A posting is (term, log_id, positions, len): where a stem stands in a line and how long the line is. The
words of ``body`` and then, apart, of ``service_name`` are indexed. Postings of a segment are dealt by ranges
of terms and sorted, so a term or a prefix is a range of few files and row groups, and a search reads no line
and no other column. A segment counts once its mark stands, which holds the sums that scores need, so writing one
again (as a micro-batch may be) changes nothing. Removed lines are a table that searches anti-join with
older segments; ``merge`` writes all that is live as one segment, whose mark retires the others.

Folders below ``path``: ``postings``, ``lengths``, ``removed`` and ``marks``, each by ``segment``.
Line ids are unique; null ids are not indexed; null bodies are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import stems
from .logs import B, K1, tokens
from .settle import settled

MARK = "docs long, tokens long, kind string, retires array<long>"
#: Above every character that a term can go on with.
LAST = "\U0010ffff"


def postings(logs: DataFrame) -> DataFrame:
    """(term, log_id, positions, len) of each stem of each line."""
    rows = logs.where("log_id is not null").select("log_id", _words("body").alias("body"), _words("service_name").alias("name"))
    length, words = (F.size("body") + F.size("name")).alias("len"), F.concat("body", F.array(F.lit("")), "name")  # apart, so that no phrase runs from one into the other
    # each different word is stemmed once; written, so that Spark knows the table's size before it chooses the join
    different = rows.select(F.explode(F.array_distinct(words)).alias("word")).distinct().where("word <> ''")
    known = settled(different.withColumn("words", F.array("word")).select("word", F.get(stems("words"), F.lit(0)).alias("term")))
    placed = rows.select("log_id", length, F.posexplode(words).alias("position", "word")).join(known, "word")
    return placed.groupBy("term", "log_id", "len").agg(F.sort_array(F.collect_list("position")).alias("positions")).select("term", "log_id", "positions", "len")


def _words(column: str) -> Column:
    return tokens(F.coalesce(F.col(column), F.lit("")))


def _write(df: DataFrame, path: str, name: str, segment: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/segment={segment}")


def _mark(spark: SparkSession, path: str, segment: int, docs: int, words: int, kind: str, retires: list[int] | None = None) -> None:
    _write(spark.createDataFrame([(docs, words, kind, retires or [])], MARK).coalesce(1), path, "marks", segment)


def _write_segment(rows: DataFrame, path: str, segment: int, retires: list[int] | None = None, lengths: DataFrame | None = None) -> None:
    spark = rows.sparkSession
    rows = settled(rows)  # dealing by ranges reads it twice
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term", "log_id").sortWithinPartitions("term", "log_id")
    _write(dealt, path, "postings", segment)
    _write(lengths, path, "lengths", segment)
    sums = spark.read.parquet(f"{path}/lengths/segment={segment}").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    _mark(spark, path, segment, sums["docs"], sums["words"], "add", retires)


def append(logs: DataFrame, path: str, segment: int) -> None:
    """Index lines as a segment; numbers rise."""
    lengths = logs.where("log_id is not null").select("log_id", (F.size(_words("body")) + F.size(_words("service_name"))).alias("len"))
    _write_segment(postings(logs), path, segment, lengths=lengths)


def sink(path: str):
    """A foreachBatch function: each micro-batch is a segment."""
    return lambda df, batch: append(df, path, batch)


def remove(ids: DataFrame, path: str, segment: int) -> None:
    """Take lines (log_id) out of all earlier segments; a line may be added anew by a later one."""
    spark = ids.sparkSession
    gone = _live(spark, path, "lengths").join(ids.select("log_id").distinct(), "log_id", "left_semi").where(F.col("segment") < segment).select("log_id", "len")
    _write(gone, path, "removed", segment)
    sums = spark.read.parquet(f"{path}/removed/segment={segment}").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    _mark(spark, path, segment, -sums["docs"], -sums["words"], "remove")


def merge(spark: SparkSession, path: str, segment: int) -> None:
    """Write all live lines as one segment that retires the others."""
    old = [s for s in _segments(spark, path) if s < segment]
    _write_segment(_live(spark, path, "postings").drop("segment"), path, segment, old, _live(spark, path, "lengths").drop("segment"))


def _marks(spark: SparkSession, path: str) -> list:
    """The marks of segments that no other retires: a row for each segment, so few where segments are merged."""
    rows = spark.read.schema(f"{MARK}, segment long").parquet(f"{path}/marks").collect()
    retired = {s for r in rows for s in r["retires"]}
    return [r for r in rows if r["segment"] not in retired]


def _segments(spark: SparkSession, path: str) -> list[int]:
    return [r["segment"] for r in _marks(spark, path)]


def _live(spark: SparkSession, path: str, name: str, only: Column | None = None) -> DataFrame:
    """A table's rows of the segments that count, less those of removed lines."""
    marks = _marks(spark, path)
    added = [r["segment"] for r in marks if r["kind"] == "add"]
    rows = spark.read.parquet(f"{path}/{name}").where(F.col("segment").isin(added))
    rows = rows if only is None else rows.where(only)
    if removed := [r["segment"] for r in marks if r["kind"] == "remove"]:
        gone = spark.read.parquet(f"{path}/removed").where(F.col("segment").isin(removed)).groupBy("log_id").agg(F.max("segment").alias("upto"))
        rows = rows.join(gone, "log_id", "left").where(F.col("upto").isNull() | (F.col("segment") > F.col("upto"))).drop("upto")
    return rows


def phrases(spark: SparkSession, query: str) -> list[list[str]]:
    """The stems of each of a query's words; a word with signs inside is a phrase of several."""
    fields = query.split()
    if not fields:
        return []
    words = spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("k", "f")).select("k", tokens(F.col("f")).alias("words"))
    return [r["stems"] for r in words.select("k", stems("words").alias("stems")).orderBy("k").collect() if r["stems"]]


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(log_id, score): lines that hold all of a query's words, the last stem of each as a prefix, by BM25 over all lines.

    An empty query, or one of signs alone, finds nothing. One scan of the postings of the
    query's terms and one grouping by line; a term that most lines hold counts next to nothing, but is asked for.
    """
    asked = phrases(spark, query)
    if not asked:
        return spark.createDataFrame([], "log_id long, score double")
    term = F.col("term")
    whole = lambda t: term == t
    prefix = lambda t: (term >= t) & (term < t + LAST)
    hit = [[*map(whole, p[:-1]), prefix(p[-1])] for p in asked]
    rows = _live(spark, path, "postings", reduce(lambda a, b: a | b, [c for p in hit for c in p]))
    # positions of a phrase's words, moved back to its first one
    moved = lambda c, k: F.flatten(F.collect_list(F.when(c, F.transform("positions", lambda p: p - k))))
    starts = [F.size(reduce(F.array_intersect, [moved(c, k) for k, c in enumerate(p)])) for p in hit]
    found = settled(rows.groupBy("log_id").agg(F.first("len").alias("len"), *[n.alias(f"tf{i}") for i, n in enumerate(starts)]))
    df = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    marks = _marks(spark, path)
    docs, mean = sum(r["docs"] for r in marks), sum(r["tokens"] for r in marks) / max(1, sum(r["docs"] for r in marks))
    norm = K1 * (1 - B + B * F.col("len") / F.lit(mean))

    def part(i: int) -> Column:
        n, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log((docs - n + 0.5) / (n + 0.5))
        return F.when(idf > 0, idf).otherwise(1e-6) * tf * (K1 + 1) / (tf + norm)

    rows = found.where(" AND ".join(f"tf{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(df))  # a single row
    return rows.select("log_id", sum((part(i) for i in range(1, len(asked))), part(0)).alias("score"))


def found_logs(logs: DataFrame, hits: DataFrame) -> DataFrame:
    """The lines that a search found, best first."""
    return logs.join(hits, "log_id").orderBy(F.desc("score"), "log_id")
