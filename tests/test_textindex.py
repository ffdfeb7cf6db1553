"""The stemmer against Porter's published examples, and the stored index."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lumenspan.functions.stemming import stems
from lumenspan.operators import textindex

#: The examples of Porter's paper, each word with its whole stem.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll toy toi yes ye is is by by panicked panick generalizations gener oscillators oscil""".split()


def test_stems(spark):
    words, want = EXAMPLES[::2], EXAMPLES[1::2]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stems("w").alias("s")).first()["s"]
    assert {w: (g, x) for w, g, x in zip(words, got, want) if g != x} == {}


LOGS = "log_id long, body string, service_name string"
LINES = [
    (1, "Connection refused by the Payment service", "api"), (2, "connections are refused; retrying connection", "api"), (3, "Latência alta: latence-payments", "payments"), (4, None, "api"), (5, "", None),
    (6, "payment service by connection", "worker"), (7, "refused connection", "x"), (None, "connection refused", "api"), (8, "a connection " * 300, "api"),
]


def _hits(spark, path, query):
    return {r["log_id"]: r["score"] for r in textindex.search(spark, path, query).collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    textindex.append(spark.createDataFrame(LINES, LOGS), path, 0)
    return path


def test_search(spark, index):
    assert set(_hits(spark, index, "conn")) == {1, 2, 6, 7, 8}
    assert set(_hits(spark, index, "CONNECTING refus")) == {1, 2, 7}  # stems, prefixes, all words
    assert set(_hits(spark, index, "latencia")) == {3} and set(_hits(spark, index, "latência")) == {3}
    assert set(_hits(spark, index, "payments")) == {1, 3, 6}  # a service's name counts too
    assert set(_hits(spark, index, "payment-serv")) == {1, 6} and _hits(spark, index, "service-payment") == {}  # a phrase
    assert _hits(spark, index, "service/work") == {} and set(_hits(spark, index, "connection/wor")) == set()  # none over two columns
    assert _hits(spark, index, "") == {} and _hits(spark, index, "--- !") == {} and _hits(spark, index, "nothing") == {}


def test_scores(spark, index):
    """BM25 worked out by hand over the eight lines."""
    line = lambda b, s: len(re.findall(r"\w+", b or "")) + len(re.findall(r"\w+", s or ""))
    lens = {i: line(b, s) for i, b, s in LINES if i is not None}
    mean = sum(lens.values()) / 8
    idf = max(math.log((8 - 3 + 0.5) / (3 + 0.5)), 1e-6)
    got = _hits(spark, index, "refused")
    assert set(got) == {1, 2, 7}
    for i, score in got.items():
        assert abs(score - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lens[i] / mean))) < 1e-12
    assert all(s < 1e-5 for s in _hits(spark, index, "connection").values())  # in more than half of the lines


def test_segments_give_the_same_hits(spark, index, tmp_path):
    logs, path = spark.createDataFrame(LINES, LOGS), str(tmp_path / "three")
    for k in range(3):
        textindex.append(logs.where(F.col("log_id") % 3 == k), path, k)
    textindex.append(logs.where("log_id % 3 = 2"), path, 2)  # a batch that runs again
    same = lambda: all(_hits(spark, path, q) == pytest.approx(_hits(spark, index, q)) for q in ("conn refus", "payment-serv"))
    assert same()
    textindex.merge(spark, path, 3)
    assert same() and textindex._segments(spark, path) == [3]
    textindex.append(spark.createDataFrame([(9, "connection refused again", "z")], LOGS), path, 4)
    textindex.remove(spark.createDataFrame([(9,), (77,)], "log_id long"), path, 5)
    assert same()
    textindex.append(spark.createDataFrame([(9, "other words", "z")], LOGS), path, 6)
    assert set(_hits(spark, path, "again")) == set() and set(_hits(spark, path, "other")) == {9}
    textindex.merge(spark, path, 7)
    assert set(_hits(spark, path, "again")) == set() and set(_hits(spark, path, "other")) == {9} and set(_hits(spark, path, "refus")) == {1, 2, 7}


def test_a_segment_without_its_mark_does_not_count(spark, index, tmp_path):
    path = str(tmp_path / "torn")
    textindex.append(spark.createDataFrame(LINES[:2], LOGS), path, 0)
    textindex.postings(spark.createDataFrame(LINES[2:], LOGS)).write.parquet(f"{path}/postings/segment=1")
    assert set(_hits(spark, path, "connection")) == {1, 2}


def test_the_scan_is_pruned(spark, index):
    rows = textindex._live(spark, index, "postings", (F.col("term") >= "conn") & (F.col("term") < "conn" + textindex.LAST)).select("log_id", "positions")
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = plan[plan.index("Scan parquet") :]
    assert "GreaterThanOrEqual(term,conn)" in scan and "LessThan(term,conn" in scan and "PartitionFilters: [isnotnull(segment" in scan
    assert "ReadSchema: struct<term:string,log_id:bigint,positions:array<int>>" in scan and plan.count("Scan parquet") == 2  # named twice, read once


def test_logs_of_hits(spark, index):
    got = textindex.found_logs(spark.createDataFrame(LINES, LOGS), textindex.search(spark, index, "refused")).collect()
    hits = _hits(spark, index, "refused")
    assert [r["log_id"] for r in got] == sorted(hits, key=lambda i: (-hits[i], i)) == [7, 2, 1] and got[0]["body"] == "refused connection"


def test_stream_of_segments(spark, index, tmp_path):
    logs = spark.createDataFrame(LINES, LOGS)
    for k in range(2):
        logs.where(F.coalesce(F.col("log_id"), F.lit(0)) % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "streamed")
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(textindex.sink(path)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(textindex._segments(spark, path)) == 2
    assert _hits(spark, path, "conn refus") == pytest.approx(_hits(spark, index, "conn refus"))


def test_each_different_word_is_stemmed_once(spark):
    logs = spark.createDataFrame([(k, "connected connecting the connected", "a") for k in range(50)], LOGS)
    got = textindex.postings(logs)
    assert {(r["term"], tuple(r["positions"]), r["len"]) for r in got.collect()} == {("connect", (0, 1, 3), 5), ("the", (2,), 5), ("a", (5,), 5)} and got.count() == 150
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()  # the lines are not stemmed
