"""Streams with state: whatever the micro-batches, the results are the batch's."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenspan.operators import rollup, traffic
from lumenspan.streaming import stateful

NOON = datetime(2026, 6, 1, 12)
at = lambda s: NOON + timedelta(seconds=s)


def play(spark, tmp_path, name, rows, schema, cuts, make, mode):
    """The rows that a stream tells when ``rows`` come as one file for each of the parts that ``cuts`` makes, one file a batch."""
    stateful.use_rocksdb(spark)
    folder = tmp_path / name
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = q.recentProgress
    return [r.asDict() for r in spark.table(name).collect()], progress


SPANS = "tenant_id string, service_name string, operation_name string, start_time timestamp, duration_us long, status string, arrival timestamp"


def _spans():
    """An hour of spans of two tenants, each up to eleven minutes late, some later than a window stays open; in the order of arrival."""
    rng = random.Random(3)
    rows = []
    for k in range(900):
        start, delay = 4 * k, rng.choice([0, 0, 1, 30, 200, 590, 650, 1300])
        rows.append((rng.choice(["default", "other"]), f"svc-{k % 2}", "op", at(start), 1000 + k, "STATUS_CODE_ERROR" if k % 9 == 0 else "STATUS_CODE_UNSET", at(start + delay)))
    return sorted(rows, key=lambda r: r[-1])


@pytest.mark.parametrize("cuts", [[450], [100, 101, 350, 700, 899]])
def test_windows_equal_the_batch_in_any_split(spark, tmp_path, cuts):
    rows = _spans() + [("default", "end", "op", at(9000), 1, "STATUS_CODE_UNSET", at(9000))]
    told, _ = play(spark, tmp_path, f"life{len(cuts)}", rows, SPANS, [*cuts, 900], lambda s: stateful.window_life(stateful.deltas(s), most_closed=100), "update")
    batch = traffic.late_points(spark.createDataFrame(rows, SPANS).withColumn("timestamp", F.col("start_time")))
    keys = ["tenant_id", "service_name", "operation_name"]
    flat = lambda df: {(r["window"], *[r[c] for c in keys]): (r["n"], r["errors"], r["duration_sum"], r["duration_min"], r["duration_max"]) for r in df.collect()}
    roots = lambda df: rollup.reduce_spans(df.withColumn("parent_span_id", F.lit("")), keys)
    want = flat(roots(batch.where("class = 'accepted' and service_name <> 'end'")))
    closed = [r for r in told if r["state"] == "closed"]
    assert {(r["window"], *[r[c] for c in keys]): (r["n"], r["errors"], r["duration_sum"], r["duration_min"], r["duration_max"]) for r in closed} == want
    assert len(closed) == len(want)  # each window closes once
    late = batch.where("class = 'late'").count()
    assert late > 20 and sum(r["n"] for r in told if r["state"] == "refused") == late
    # the updates before a window closes only grow
    for r in closed:
        mine = [x["n"] for x in told if x["state"] == "mutable" and all(x[c] == r[c] for c in ("window", *keys))]
        assert mine == sorted(mine) and mine[-1] == r["n"]


def test_windows_that_nobody_writes_are_lost_and_counted(spark, tmp_path):
    rows = [("t", "s", "op", at(300 * k), 10 + k, "STATUS_CODE_UNSET", at(300 * k)) for k in range(20)]
    told, _ = play(spark, tmp_path, "lost", rows, SPANS, list(range(1, 20)), lambda s: stateful.window_life(stateful.deltas(s), most_closed=3), "update")
    closed, lost = ([r["window"] for r in told if r["state"] == s] for s in ("closed", "lost"))
    assert closed == [at(300 * k) for k in range(len(closed))] and len(closed) >= 15
    assert lost == closed[: len(closed) - 3] and sum(r["n"] for r in told if r["state"] == "lost") == len(lost)


def test_written_windows_become_final(spark, tmp_path):
    stateful.use_rocksdb(spark)
    kind = "kind string, tenant_id string, service_name string, operation_name string, start_time timestamp, duration_us long, status string, arrival timestamp"
    span = lambda start, arrival: ("span", "t", "s", "op", at(start), 5, "STATUS_CODE_UNSET", at(arrival))
    done = lambda start, arrival: ("written", "t", "s", "op", at(start), 0, "", at(arrival))
    rows = [span(0, 0), span(10, 899), done(0, 899), span(20, 1000), span(1000, 1000), span(2500, 2500), span(2501, 2501), done(0, 2502), done(0, 2503), span(30, 2504)]

    def make(stream):
        spans = stateful.deltas(stream.where("kind = 'span'").drop("kind"))
        return stateful.window_life(spans.unionByName(stateful.written(stream.where("kind = 'written'").withColumn("window", F.col("start_time")))))

    told, _ = play(spark, tmp_path, "finals_of_windows", rows, kind, list(range(1, len(rows))), make, "update")
    first = [(r["state"], r["n"]) for r in told if r["window"] == NOON]
    # not final while it is open, refused once it is late, final once, and gone
    assert first == [("mutable", 1), ("mutable", 2), ("refused", 1), ("closed", 2), ("final", 2), ("refused", 1)]


POINTS = "tenant_id string, service_name string, name string, producer long, start_ts timestamp, timestamp timestamp, value double, arrival timestamp, seq long"
START = NOON - timedelta(hours=1)
#: Inputs and outcomes of counters, by case: (seconds, value, start) and (event, delta).
COUNTERS = {
    "stale": ([(0, 100, 0), (1, 110, 0), (1, 110, 0), (0, 100, 0), (2, 111, 0)], [("seed", 0), ("normal", 10), ("ignored", 0), ("ignored", 0), ("normal", 1)]),
    "start": ([(0, 500, 0), (60, 600, 1)], [("seed", 0), ("reset", 600)]),
    "regression": ([(0, 500, 0), (60, 12, 0)], [("seed", 0), ("reset", 12)]),
    "progression": ([(0, 100, 0), (10, 105, 0), (20, 120, 0), (30, 121, 0)], [("seed", 0), ("normal", 5), ("normal", 15), ("normal", 1)]),
    "gap": ([(0, 100, 0), (3600, 100000, 0), (3660, 100005, 0)], [("seed", 0), ("gap", 0), ("normal", 5)]),
    "boundary": ([(0, 100, 0), (600, 150, 0), (1201, 200, 0)], [("seed", 0), ("normal", 50), ("gap", 0)]),
}


@pytest.mark.parametrize("cuts", [[9], [2, 3, 4, 8, 13]])
def test_counters_in_any_split(spark, tmp_path, cuts):
    rows = [("t", "s", case, 1, START + timedelta(seconds=start), at(s), float(v), NOON, k) for case, (points, _) in COUNTERS.items() for k, (s, v, start) in enumerate(points)]
    rows = sorted(rows, key=lambda r: (r[-1], r[2]))
    told, _ = play(spark, tmp_path, f"counters{len(cuts)}", rows, POINTS, cuts, stateful.counter_slots, "append")
    for case, (_, want) in COUNTERS.items():
        assert sorted((r["event"], r["delta"]) for r in told if r["name"] == case) == sorted((e, float(d)) for e, d in want)


def test_the_ninth_producer_shares_and_silence_frees(spark, tmp_path):
    point = lambda producer, s, v, seq: ("t", "s", "m", producer, START, at(s), float(v), at(s), seq)
    first = [point(p, p, 100 * p, p) for p in range(1, 11)]  # ten producers
    second = [point(p, 20 + p, 100 * p + 7, 20 + p) for p in range(1, 11)]
    quiet = [point(1, 1000, 120, 100), point(1, 5000, 130, 101), point(1, 5001, 131, 102), point(11, 5010, 900, 103), point(11, 5020, 905, 104)]
    cuts = [10, 20, 21, 22, 23, 24]
    told, progress = play(spark, tmp_path, "ninth", first + second + quiet, POINTS, cuts, lambda s: stateful.counter_slots(s, idle_seconds=1800), "append")
    by = {(r["producer"], (r["timestamp"] - NOON).total_seconds()): (r["event"], r["delta"], r["shared"]) for r in told}
    assert all(by[p, p] == ("seed", 0, False) and by[p, 20 + p] == ("normal", 7, False) for p in range(1, 9))
    assert by[9, 9] == ("seed", 0, True) and by[10, 10] == ("normal", 100, True)  # one baseline for both
    assert by[9, 29] == ("reset", 907, True) and by[10, 30] == ("normal", 100, True)
    # after half an hour of silence the others' places are free
    assert by[11, 5010] == ("seed", 0, False) and by[11, 5020] == ("normal", 5, False)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > held[-1]


CALLS = "tenant_id string, trace_id string, span_id string, parent_span_id string, service_name string, start_time timestamp, duration_us long, status string, arrival timestamp, seq long"


def test_calls_of_parents_already_seen(spark, tmp_path):
    base = [
        ("default", "a1", "", "svc-a", 100_000), ("default", "a2", "a1", "svc-a", 10_000), ("default", "b1", "a1", "svc-b", 50_000), ("default", "b2", "a1", "svc-b", 30_000), ("default", "m1", "f" * 16, "svc-b", 7000),
        ("default", "e1", "a1", "", 5000), ("default", "f1", "e1", "svc-b", 13_000), ("default", "c1", "b1", "svc-c", 20_000), ("default", "z1", "0" * 16, "svc-c", 40_000), ("tenant-b", "x1", "a1", "svc-z", 888_888),
    ]
    rows = [(t, "t", s, p, name, NOON, us, "STATUS_CODE_UNSET", at(k), k) for k, (t, s, p, name, us) in enumerate(base)]
    want = {(r["caller"], r["callee"], r["duration_us"]) for r in traffic.calls(spark.createDataFrame(rows, CALLS)).collect()}
    for cuts in ([5], [1, 2, 3, 7]):
        told, _ = play(spark, tmp_path, f"calls{len(cuts)}", rows, CALLS, cuts, stateful.seen_calls, "append")
        assert {(r["caller"], r["callee"], r["duration_us"]) for r in told if r["event"] == "edge"} == want and len(want) == 3
        assert sorted(r["callee"] for r in told if r["event"] == "miss") == ["svc-b", "svc-b", "svc-z"]  # unknown, nameless and another tenant's parents


def test_a_child_before_its_parent_is_a_miss_and_traces_are_forgotten(spark, tmp_path):
    row = lambda span, parent, service, s: ("t", "tr", span, parent, service, at(s), 1, "STATUS_CODE_UNSET", at(s), s)
    rows = [row("c", "p", "child", 0), row("p", "", "parent", 1), row("d", "p", "late child", 2), row("far", "", "x", 3000), row("far2", "", "x", 3001), row("e", "p", "too late", 3002)]
    told, progress = play(spark, tmp_path, "order", rows, CALLS, [1, 3, 4, 5], lambda s: stateful.seen_calls(s.withColumn("trace_id", F.when(F.col("span_id").startswith("far"), "other").otherwise(F.col("trace_id")))), "append")
    assert [(r["event"], r["caller"], r["callee"]) for r in told] == [("miss", None, "child"), ("edge", "parent", "late child"), ("miss", None, "too late")]
