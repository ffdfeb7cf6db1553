"""Windows by entity, caps of buckets, reserves, and export requests as a data source, against brute force and by hand."""

import gzip
import json
import random
from datetime import datetime, timedelta

import pytest

from lumenspan.operators import rollup, sampling, serving, topology
from lumenspan.sources import otlp, requests
from lumenspan.streaming import pipelines

NOON = datetime(2026, 6, 1, 12)
SPANS = "tenant_id string, service_name string, operation_name string, start_time timestamp, duration_us long, status string"
ERROR = "STATUS_CODE_ERROR"


def _at(s):
    return NOON + timedelta(seconds=s)


def test_fold_counts_each_span_once_a_level(spark):
    spans = spark.createDataFrame([("t", "a", "x", _at(0), 10, ERROR), ("t", "a", "x", _at(299), 30, ""), ("t", "a", "y", _at(300), 5, None), ("t", "a", "", _at(1), None, ""), ("t", "", "x", _at(1), 7, "")], SPANS)
    calls = spark.createDataFrame([("t", "a", "b", _at(0), 4, ERROR), ("t", "a", "a", _at(0), 4, ""), ("t", "", "b", _at(0), 4, "")], "tenant_id string, caller string, callee string, start_time timestamp, duration_us long, status string")
    points = spark.createDataFrame([("t", "a", "cpu", 2.0, _at(0)), ("t", "a", "cpu", -1.0, _at(9))], "tenant_id string, service_name string, name string, value double, timestamp timestamp")
    got = {(r["level"], r["a"], r["b"], (r["window"] - NOON).seconds): r for r in topology.fold(spans, calls, points).collect()}
    assert set(got) == {("service", "a", None, 0), ("service", "a", None, 300), ("operation", "a", "x", 0), ("operation", "a", "y", 300), ("edge", "a", "b", 0), ("metric", "a", "cpu", 0)}
    s = got["service", "a", None, 0]
    assert (s["n"], s["errors"], s["durations"], s["duration_sum"], s["duration_min"], s["duration_max"]) == (3, 1, 2, 40, 10, 30)
    m = got["metric", "a", "cpu", 0]
    assert (m["samples"], m["value_sum"], m["value_min"], m["value_max"], m["duration_sum"]) == (2, 1.0, -1.0, 2.0, None)
    assert topology.fold(spans.limit(0), calls.limit(0), points.limit(0)).count() == 0


def test_nodes_of_what_horizon_and_caps_leave(spark):
    rows = [("t", f"s{k}", "x", _at(60 * k), 1000 * k, ERROR if k % 2 else "") for k in range(6)] + [("t", "s0", f"o{k}", _at(k), 1, "") for k in range(4)] + [("u", "s9", "x", _at(0), 1, "")]
    spans = spark.createDataFrame(rows, SPANS)
    windows = topology.fold(spans)
    kept, dropped = topology.capped(windows, {"service": 4, "operation": 2, "edge": 1, "metric": 1})
    have = {(r["level"], r["tenant_id"], r["id"]) for r in topology.nodes(kept).collect()}
    assert {x for x in have if x[0] == "service"} == {("service", "t", f"s{k}") for k in range(4)} | {("service", "u", "s9")}
    assert {x[2] for x in have if x[0] == "operation" and x[2].startswith("s0")} == {"s0|o0", "s0|x"}  # at one moment by name
    assert {(r["level"], r["tenant_id"]): r["dropped"] for r in dropped.collect()} == {("service", "t"): 2, ("operation", "t"): 3, ("service", "u"): 0, ("operation", "u"): 0}
    # the cutoff: 1800 seconds before, less a window and ten minutes, on the window's bound
    assert topology.retained(windows, _at(2700)).count() == windows.count()
    left = topology.retained(windows, _at(3000))
    assert {r["a"] for r in left.where("level = 'service'").collect()} == {"s5"}
    node = topology.nodes(windows, topology.service_quantiles(spans)).where("id = 's5'").first()
    assert (node["calls"], node["error_rate"], node["avg_ms"], node["health"]) == (1, 1.0, 5.0, 0.0) and abs(node["p99_ms"] - 5) < 0.2


@pytest.mark.parametrize("per_tenant, in_all", [(2, 3), (2, 0), (0, 3), (1, 50)])
def test_capped_buckets_against_one_point_after_the_other(spark, per_tenant, in_all):
    rng = random.Random(per_tenant * 10 + in_all)
    rows = [(rng.choice("ab"), rng.choice("sr"), rng.choice("mnop"), float(rng.randrange(100)), _at(rng.randrange(60)), k, json.dumps({"z": rng.randrange(2), "a": "1"})) for k in range(120)]
    got = rollup.tsdb_buckets(spark.createDataFrame(rows, "tenant_id string, service_name string, name string, value double, timestamp timestamp, seq long, attributes string"), per_tenant, in_all)
    want, mine, live = {}, {}, {}
    for tenant, service, name, value, at, _, attributes in sorted(rows, key=lambda r: (r[4], r[5])):
        w = at.replace(second=at.second // 30 * 30)
        text = json.dumps(json.loads(attributes), sort_keys=True, separators=(",", ":"))
        key = (w, tenant, service, name, text)
        if key not in want:
            if per_tenant and mine.get((w, tenant), 0) >= per_tenant:
                key = (w, tenant, None, "__overflow__", None)
            elif in_all and live.get(w, 0) >= in_all:
                key = (w, "__global__", None, "__overflow__", None)
            else:
                mine[w, tenant], live[w] = mine.get((w, tenant), 0) + 1, live.get(w, 0) + 1
        want.setdefault(key, [service, []])[1].append(value)
    have = {(r["window"], r["tenant_id"], r["service_name"], r["name"], r["attributes"]): (r["min"], r["max"], r["sum"], r["count"]) for r in got.collect()}
    assert have == {(k[0], k[1], s, k[3], k[4]): (min(v), max(v), sum(v), len(v)) for k, (s, v) in want.items()}


def test_reserves_against_one_span_after_the_other(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice("sr"), f"t{rng.randrange(4)}", f"p{k}", _at(rng.randrange(900)), rng.randrange(1, 30)) for k in range(300)]
    spans = spark.createDataFrame(rows, "tenant_id string, service_name string, trace_id string, span_id string, start_time timestamp, size long")
    used, want = {}, {}
    for tenant, service, trace, span, at, n in sorted(rows, key=lambda r: (r[4], r[3])):
        w = (tenant, service, at.minute // 5)
        fits = used.get(w, 0) + n <= 200 and used.get((w, trace), 0) + n <= 60
        if fits:
            used[w], used[w, trace] = used.get(w, 0) + n, used.get((w, trace), 0) + n
        want[span] = fits
    reserved = sampling.reserve_spans(spans, "size", 60, 200)
    assert {r["span_id"]: r["retained"] for r in reserved.collect()} == want and 0 < sum(want.values()) < 300
    stats = sampling.trace_stats(reserved).collect()
    assert sum(r["observed"] for r in stats) == 300 and sum(r["retained"] for r in stats) == sum(want.values()) and all(r["truncated"] == (r["retained"] < r["observed"]) for r in stats)
    assert sampling.reserve_spans(spans.limit(0), "size").count() == 0


def test_new_series_are_refused(spark):
    rows = [("a", "s", "m", 0), ("b", "s", "m", 1), ("a", "s", "n", 2), ("a", "s", "m", 3), ("a", "s", "n", 4)]
    kept, refused = serving.refused_series(spark.createDataFrame(rows, "tenant_id string, service_name string, name string, seq long"), 2, ["seq"])
    assert sorted(r["seq"] for r in kept.collect()) == [0, 1, 3] and [tuple(r) for r in refused.collect()] == [("a", 2)]


# ------------------------------------------------------------------ export requests


def _request(service):
    span = {"traceId": "t", "spanId": service, "name": "op", "startTimeUnixNano": "1000000000", "endTimeUnixNano": "2000000000"}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}, "scopeSpans": [{"spans": [span]}]}]})


def test_requests_as_a_batch(spark, tmp_path):
    spark.dataSource.register(requests.ExportRequests)
    (tmp_path / "1.json").write_text(_request("a"))
    (tmp_path / "2.json.gz").write_bytes(gzip.compress(_request("b").encode()[:40]) + gzip.compress(_request("b").encode()[40:]))
    (tmp_path / "3.json.gz").write_bytes(gzip.compress(b" " * 100_000))
    (tmp_path / "4.json.gz").write_bytes(gzip.compress(_request("c").encode())[:-9])
    (tmp_path / "5.json").write_text("x" * 5000)
    (tmp_path / "6.json").write_bytes(b"\xff\xfe")
    (tmp_path / "7.json").write_text("")
    (tmp_path / "_8.json").write_text(_request("hidden"))
    rows = spark.read.format("export_requests").option("wire", 4000).option("unpacked", 50_000).option("together", 600).load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1][0]: (r["reason"], r["body"] is None) for r in rows.collect()}
    assert got == {"1": (None, False), "2": (None, False), "3": ("unpacked", True), "4": ("gzip", True), "5": ("wire", True), "6": ("utf8", True), "7": (None, False)}
    assert sorted(r["service_name"] for r in otlp.spans(requests.parsed(rows, otlp.TRACE_SCHEMA)).collect()) == ["a", "b"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("export_requests").load(str(tmp_path / "none")).count() == 0


def test_requests_as_a_stream_go_on_where_they_stopped(spark, tmp_path):
    spark.dataSource.register(requests.ExportRequests)
    folder = tmp_path / "in"
    folder.mkdir()
    for k, names in enumerate((["01", "02"], [], ["03", "04", "05"])):
        for n in names:
            (folder / f"{n}.json").write_text(_request(n))
        spans = otlp.spans(requests.parsed(spark.readStream.format("export_requests").load(str(folder)), otlp.TRACE_SCHEMA))
        q = spans.select("service_name", "start_time").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
        q.awaitTermination()
        have = sorted(r["service_name"] for r in spark.read.schema("service_name string").parquet(str(tmp_path / "out")).collect())
        assert have == [["01", "02"], ["01", "02"], ["01", "02", "03", "04", "05"]][k]


# ------------------------------------------------------------------ streams


def test_bucket_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    schema = "tenant_id string, service_name string, name string, value double, timestamp timestamp, seq long, attributes string"
    rows = [(rng.choice("ab"), "s", rng.choice("mn"), float(rng.randrange(9)), _at(k // 3), k, rng.choice(['{"x": 1, "b": "1"}', '{"b":"1","x":1}', None])) for k in range(600)]
    folder = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame(rows[k * 150 : k * 150 + 150], schema).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([("z", "s", "m", 0.0, _at(9000), 0, None)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    q = pipelines.metric_buckets(pipelines.file_stream(spark, str(folder), schema, 1)).writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["window", "tenant_id", "service_name", "name", "attributes", "min", "max", "sum", "count"]
    got = sorted(map(tuple, spark.table("buckets").select(columns).collect()))
    want = sorted(map(tuple, rollup.tsdb_buckets(spark.createDataFrame(rows, schema)).select(columns).collect()))
    assert got == want and len({r[4] for r in got}) == 2


def test_template_facts_of_a_stream(spark, tmp_path):
    schema = "tenant_id string, service_name string, severity string, log_id long, timestamp timestamp, body string"
    lines = ["disk full on host alpha", "disk full on host beta", "user left the room now", "disk full on host gamma", "user left the house now", "nothing"]
    batches = [[("t", "s", "ERROR", 10 * b + k, _at(100 * b + k), lines[(b * 2 + k) % 6]) for k in range(4)] for b in range(3)]
    sink, path = pipelines.template_facts(str(tmp_path / "f")), str(tmp_path / "f")
    for b, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), b)
    facts = lambda: sorted((r["batch"], r["template"], r["n"]) for r in spark.read.parquet(f"{path}/facts").collect())
    first = facts()
    assert {b for b, _, _ in first} == {0, 1, 2} and sum(n for _, _, n in first) == 12 and any("<*>" in t for _, t, _ in first)
    sink(spark.createDataFrame(batches[2], schema), 2)  # a batch that runs again
    assert facts() == first
