"""Export requests, streams and sinks."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenspan.operators import rollup, traffic
from lumenspan.schema import SPANS
from lumenspan.sources import otlp, sinks
from lumenspan.streaming import pipelines

NOON = datetime(2026, 6, 1, 12)
NANOS = int(NOON.timestamp()) * 10**9


def _attr(k, v):
    return {"key": k, "value": {"stringValue": v}}


def test_otlp_traces(spark, tmp_path):
    span = {"traceId": "t", "spanId": "a", "name": "GET /x", "kind": 2, "startTimeUnixNano": str(NANOS), "endTimeUnixNano": str(NANOS + 5_000_000), "status": {"code": 2}, "events": [{"name": "exception", "timeUnixNano": "1", "attributes": [_attr("exception.message", "boom")]}]}
    other = dict(span, spanId="b", parentSpanId="a", events=[], status={"code": 2})
    doc = {"resourceSpans": [{"resource": {"attributes": [_attr("service.name", "api")]}, "scopeSpans": [{"spans": [span, other]}]}, {"resource": {}, "scopeSpans": [{"spans": [dict(span, spanId="c", status=None, events=None)]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    rows = otlp.spans(otlp.read_json(spark, str(tmp_path), otlp.TRACE_SCHEMA))
    got = {r["span_id"]: r for r in rows.collect()}
    assert got["a"]["service_name"] == "api" and got["a"]["duration_us"] == 5000 and got["a"]["status"] == "STATUS_CODE_ERROR"
    assert got["c"]["service_name"] == "unknown-service" and got["c"]["status"] == "STATUS_CODE_UNSET"
    made = {(r["span_id"], r["body"]) for r in otlp.synthesized_logs(rows).collect()}
    assert made == {("a", "boom"), ("b", "Span 'GET /x' failed")}


def test_otlp_logs_and_metrics(spark, tmp_path):
    log = {"resourceLogs": [{"resource": {}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "0", "severityNumber": 17, "body": {"stringValue": "x"}}]}]}]}
    points = [{"timeUnixNano": str(NANOS), "asInt": "7"}, {"timeUnixNano": str(NANOS), "asDouble": 1.5, "flags": 1}]
    hist = {"timeUnixNano": str(NANOS), "count": "3", "bucketCounts": ["1", "2"], "explicitBounds": [1.0]}
    metric = {"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"metrics": [{"name": "m", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": points}}, {"name": "h", "histogram": {"aggregationTemporality": 1, "dataPoints": [hist]}}]}]}]}
    (tmp_path / "l").mkdir()
    (tmp_path / "m").mkdir()
    (tmp_path / "l/x.json").write_text(json.dumps(log))
    (tmp_path / "m/x.json").write_text(json.dumps(metric))
    r = otlp.logs(otlp.read_json(spark, str(tmp_path / "l"), otlp.LOG_SCHEMA), F.lit(NOON)).first()
    assert (r["severity"], r["body"], r["timestamp"]) == ("ERROR", "x", NOON)
    requests = otlp.read_json(spark, str(tmp_path / "m"), otlp.METRIC_SCHEMA)
    assert [(p["dispatch"], p["value"]) for p in otlp.number_points(requests).collect()] == [("cumulative", 7.0)]
    h = otlp.histogram_points(requests).first()
    assert (h["counts"], h["bounds"], h["temporality"]) == ([1, 2], [1.0], "delta")


def test_a_stream_of_requests_reads_each_once(spark, tmp_path):
    def request(k):
        span = {"traceId": "t", "spanId": f"s{k}", "name": "op", "kind": 2, "startTimeUnixNano": str(NANOS), "endTimeUnixNano": str(NANOS + 1000)}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [_attr("service.name", "api")]}, "scopeSpans": [{"spans": [span]}]}]}))

    for k in range(6):
        request(k)
        if k in (2, 3, 5):  # stopped and started again
            spans = otlp.spans(otlp.stream_json(spark, str(tmp_path / "in"), otlp.TRACE_SCHEMA, 2))
            q = spans.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
    assert sorted(r["span_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"s{k}" for k in range(6)]


def _spans(spark, n=300):
    rows = [("default", f"t{i % 20}", f"s{i}", "" if i < 20 else f"s{i % 20}", f"op{i % 3}", f"svc-{i % 4}", NOON + timedelta(seconds=7 * i), 1000 + i, "STATUS_CODE_ERROR" if i % 9 == 0 else "STATUS_CODE_UNSET", 1, None) for i in range(n)]
    return spark.createDataFrame(rows, SPANS)


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_rollup_equals_batch(spark, tmp_path):
    spans = _spans(spark)
    spans.coalesce(1).write.parquet(str(tmp_path / "in"))
    keys = ["tenant_id", "service_name", "operation_name"]
    got = _run(pipelines.rollup(pipelines.file_stream(spark, str(tmp_path / "in"), SPANS)), "rolled", "complete")
    want = rollup.reduce_spans(spans, keys).drop("requests")
    columns = ["window", *keys, "n", "errors", "duration_sum", "duration_min", "duration_max"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_stream_dedup(spark, tmp_path):
    spans = _spans(spark, 50)
    spans.unionByName(spans).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert _run(pipelines.dedup(pipelines.file_stream(spark, str(tmp_path / "in"), SPANS)), "deduped").count() == 50


def test_stream_edges(spark, tmp_path):
    """Edges of several micro-batches, parents late and early, are those of the batch."""
    rows = [("default" if t % 2 else "other", f"t{t}", f"s{k}", f"s{k // 3}" if k else "", f"op{k}", f"svc-{k % 4}", NOON + timedelta(seconds=20 * k + t), 1000 + k, "STATUS_CODE_ERROR" if k % 5 == 0 else "STATUS_CODE_UNSET", 1, None) for t in range(6) for k in range(14)]
    late = [("default", "t1", "s99", "s1", "op", "svc-3", NOON - timedelta(hours=5), 1, "STATUS_CODE_UNSET", 1, None)]  # far from its parent: beyond the join's reach
    late += [("default", "t1", s, p, "op", name, NOON + timedelta(seconds=30), 1, "STATUS_CODE_UNSET", 1, None) for s, p, name in (("n1", "s0", ""), ("n2", "n1", "svc-3"), ("n3", "0" * 16, "svc-3"), ("s0", "", "svc-0"))]  # none is a call
    for k in range(4):
        spark.createDataFrame(rows[k::4] + (late if k == 3 else []), SPANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = _run(pipelines.edges(pipelines.file_stream(spark, str(tmp_path / "in"), SPANS, 1)), "edges")
    columns = ["caller", "callee", "start_time", "duration_us", "status"]
    want = sorted(map(tuple, traffic.calls(spark.createDataFrame(rows, SPANS)).select(columns).collect()))
    assert want and sorted(map(tuple, got.select(columns).collect())) == want


def test_sink_is_idempotent(spark, tmp_path):
    sink = sinks.write_batch(str(tmp_path / "out"), "start_time")
    for _ in range(2):
        sink(_spans(spark, 10), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_otlp_exponential_and_rejected(spark, tmp_path):
    point = {"timeUnixNano": str(NANOS), "count": "6", "sum": 9.5, "scale": 3, "positive": {"offset": -1, "bucketCounts": ["2", "3"]}, "negative": {"offset": 0, "bucketCounts": ["1"]}}
    metrics = [
        {"name": "e", "exponentialHistogram": {"aggregationTemporality": 1, "dataPoints": [point, {"timeUnixNano": str(NANOS), "count": "0"}]}}, {"name": "c", "exponentialHistogram": {"aggregationTemporality": 2, "dataPoints": [point]}},
        {"name": "h", "histogram": {"dataPoints": [{"count": "1"}, {"count": "2"}]}}, {"name": "q", "summary": {"dataPoints": [{}, {}, {}]}}, {"name": "g", "gauge": {"dataPoints": []}},
    ]
    doc = {"resourceMetrics": [{"resource": {"attributes": [_attr("service.name", "api")]}, "scopeMetrics": [{"metrics": metrics}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    requests = otlp.read_json(spark, str(tmp_path), otlp.METRIC_SCHEMA, multi_line=True)
    got = [tuple(r) for r in otlp.exponential_points(requests).drop("timestamp").orderBy("count").collect()]
    assert got == [("api", "e", 0, 0, [], 0, 0, 0, None), ("api", "e", 3, -1, [2, 3], 0, 1, 6, 9.5)]
    assert {tuple(r) for r in otlp.rejected_points(requests).collect()} == {("api", "temporality", 3), ("api", "summary", 3)}


def test_tables_of_a_batch_stand_together(spark, tmp_path):
    path = str(tmp_path / "out")
    sink = sinks.write_together(path, {"spans": (lambda df: df, "start_time"), "failed": (lambda df: df.where("status = 'STATUS_CODE_ERROR'"), "start_time")})
    for batch in (0, 0, 1):
        sink(_spans(spark, 10), batch)
    assert [sinks.read_committed(spark, path, t).count() for t in ("spans", "failed")] == [20, 4]
    (tmp_path / "out/committed/batch=1").rename(tmp_path / "aside")  # as if the driver was lost before the mark
    assert [sinks.read_committed(spark, path, t).count() for t in ("spans", "failed")] == [10, 2]


def test_stream_rollup_is_final_after_the_watermark(spark, tmp_path):
    early = _spans(spark, 60)
    one = lambda name, at: spark.createDataFrame([("default", "t", name, "", "op", "svc", at, 1, "STATUS_CODE_UNSET", 1, None)], SPANS)
    # the watermark of a batch takes effect in the second one after it, so the late span comes in the fourth
    for df in (early, one("x", NOON + timedelta(hours=2)), one("y", NOON + timedelta(hours=2, minutes=1)), one("late", NOON)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keys = ["tenant_id", "service_name", "operation_name"]
    got = _run(pipelines.rollup(pipelines.file_stream(spark, str(tmp_path / "in"), SPANS, 1)), "finals")
    columns = ["window", *keys, "n", "errors", "duration_sum"]
    want = sorted(map(tuple, rollup.reduce_spans(early, keys).select(columns).collect()))
    assert sorted(map(tuple, got.select(columns).collect())) == want  # neither the late span nor the windows still open
