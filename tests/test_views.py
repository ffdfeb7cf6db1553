"""JSON documents: names, units, moments, and what is null."""

import json
from datetime import datetime

from lumenspan.operators import rollup, traffic, views
from lumenspan.sources import telemetry as T

NOON = datetime(2026, 6, 1, 12)
SF = "/root/testdata/sf0.001"


def _bodies(df):
    return [json.loads(r["body"]) for r in df.collect()]


def test_spans_with_nulls_and_ties(spark):
    rows = [("t", "1", "2", None, 'say "hi"', None, NOON, 1_500_000, "", '{"a":1}'), ("t", None, None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows * 2, "tenant_id string, trace_id string, span_id string, parent_span_id string, operation_name string, service_name string, start_time timestamp, duration_us long, status string, attributes_json string")
    got = _bodies(views.spans(table.withColumn("body", table["status"])))
    assert len(got) == 4 and got[0] == got[2]
    assert got[0] == {"trace_id": "1", "span_id": "2", "parent_span_id": "", "operation_name": 'say "hi"', "start_time": "2026-06-01T12:00:00Z", "end_time": "2026-06-01T12:00:01.5Z", "duration": 1_500_000, "service_name": "", "status": "", "attributes_json": '{"a":1}'}
    assert got[1] == {"trace_id": "", "span_id": "", "parent_span_id": "", "operation_name": "", "duration": 0, "service_name": "", "status": "", "attributes_json": ""}  # a moment that isn't known is left out
    assert views.spans(table.limit(0)).count() == 0


def test_moments_in_any_zone(spark):
    table = spark.createDataFrame([(datetime(2026, 6, 1, 12, 0, 0, k),) for k in (0, 1, 120, 500_000)], "t timestamp")
    want = sorted(["2026-06-01T12:00:00Z", "2026-06-01T12:00:00.000001Z", "2026-06-01T12:00:00.00012Z", "2026-06-01T12:00:00.5Z"])
    assert sorted(r[0] for r in table.select(views.moment("t")).collect()) == want
    stored = table.selectExpr("unix_micros(t) AS u").collect()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        again = spark.createDataFrame([(r["u"],) for r in stored], "u long").selectExpr("timestamp_micros(u) AS t")
        assert sorted(r[0] for r in again.select(views.moment("t")).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_documents_of_the_tables(spark):
    spans, logs = T.event_spans(spark, SF), T.document_logs(spark, SF)
    row, failing = traffic.dashboard(spans, logs), traffic.top_failing(spans, 2)
    [doc] = _bodies(views.dashboard(row, failing))
    r, f = row.first(), sorted(failing.collect(), key=lambda x: (-x["errors"], x["service_name"], x["tenant_id"]))
    assert (doc["total_traces"], doc["p99_latency_ms"]) == (r["total_traces"], r["p99_latency_us"] / 1000)
    assert doc["top_failing_services"] == [{"service_name": x["service_name"], "error_count": x["errors"], "total_count": x["total"], "error_rate": x["error_rate"]} for x in f] and len(f) == 4
    assert _bodies(views.dashboard(row, failing, 3))[0]["top_failing_services"] == doc["top_failing_services"][:3]
    [doc] = _bodies(views.dashboard(row, failing.limit(0)))
    assert "top_failing_services" not in doc
    docs = views.traces(traffic.traces(T.order_spans(spark, SF)))
    assert all(d["duration_ms"] == d["duration"] / 1000 and d["span_count"] > 0 for d in _bodies(docs.limit(50)))
    points = spark.createDataFrame([("t", "s", "m", 2.5, NOON, 1, None)], "tenant_id string, service_name string, name string, value double, timestamp timestamp, seq long, attributes string")
    assert _bodies(views.metric_buckets(rollup.tsdb_buckets(points))) == [{"name": "m", "service_name": "s", "time_bucket": "2026-06-01T12:00:00Z", "min": 2.5, "max": 2.5, "sum": 2.5, "count": 1, "attributes_json": "{}"}]
