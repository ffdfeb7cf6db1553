"""Queries of ``operators.merging`` and of the scalar functions beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, histogram, merging, mining, rollup, traffic
from ..operators.traffic import stamp
from ..sources import telemetry as T
from . import views as V
from .catalogue import _conv_edges, _query

_SERIES = ["service_name", "name"]


@_query(
    f"""WITH {V.METRICS}, g AS (SELECT * FROM points WHERE seq % 4 <> 0) SELECT service_name, name, count(*)::BIGINT AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, arg_max(value, (moment, value)) AS last, {V.stamp('max(moment)')} AS last_time FROM g GROUP BY 1, 2"""
)
def merged_gauges(spark, d):
    """Each point a delta, every fourth without a point; merged in tens, then altogether."""
    m = T.event_metrics(spark, d).withColumns({"n": (F.col("seq") % 4 != 0).cast("long"), "part": F.col("seq") % 10, **{c: F.col("value") for c in ("sum", "min", "max", "last")}, "last_time": F.col("timestamp")})
    out = merging.merge_gauges(merging.merge_gauges(m, [*_SERIES, "part"]), _SERIES)
    return out.withColumns({"sum": F.round("sum", 4), "last_time": stamp("last_time")})


@_query(
    f"""WITH {V.METRICS}, h AS (SELECT *, seq % 3 AS c, CASE seq % 7 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS r FROM points WHERE name <> 'click' OR seq % 7 NOT IN (3, 5))
SELECT service_name, name, sum(c)::BIGINT AS n, round(sum(value * c), 4) AS sum, min(value) FILTER (seq % 2 = 0) AS min, max(value) FILTER (seq % 2 = 1) AS max, (count(*) FILTER (seq % 5 = 0))::BIGINT AS tail_count, min(seq) FILTER (seq % 5 = 0)::DOUBLE AS tail_bound,
max(seq % 11 / 10) AS source_error, bit_or(pow(2, seq % 3)::INTEGER) AS flags, coalesce(min(r) FILTER (r > 0), 0)::INTEGER AS reason, sum(c) > 0 AND max(r) = 0 AS percentiles FROM h GROUP BY 1, 2"""
)
def merged_histograms(spark, d):
    i = F.col("seq")
    rows = T.event_metrics(spark, d).where(~((F.col("name") == "click") & (i % 7).isin(3, 5))).withColumns({
        "n": i % 3, "sum": F.col("value") * (i % 3), "min": F.when(i % 2 == 0, F.col("value")), "max": F.when(i % 2 == 1, F.col("value")), "tail_count": (i % 5 == 0).cast("long"), "tail_bound": F.when(i % 5 == 0, i.cast("double")),
        "source_error": i % 11 / 10, "flags": F.pow(F.lit(2), i % 3).cast("int"), "reason": F.when(i % 7 == 3, 2).when(i % 7 == 5, 1).otherwise(0), "part": i % 10,
    })
    return merging.merge_histograms(merging.merge_histograms(rows, [*_SERIES, "part"]), _SERIES).withColumn("sum", F.round("sum", 4))


_SIGNALS = f"""signals AS (SELECT 'trace' AS signal, service_name, operation_name AS name, {V.window('start_time')} AS w, ({V.ERROR})::INTEGER AS e FROM spans UNION ALL SELECT 'log', service_name, severity, {V.window('moment')}, (severity = 'ERROR')::INTEGER FROM logs)"""


def _signals(spark, d):
    spans = rollup.reduce_spans(T.event_spans(spark, d), ["service_name", "operation_name"]).withColumnRenamed("operation_name", "name")
    logs = T.document_logs(spark, d).groupBy(S.window_start(F.col("timestamp")).alias("window"), "service_name", F.col("severity").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
    return {"trace": spans, "log": logs}


@_query(f"WITH {V.EVT}, {V.LOGS}, {_SIGNALS} SELECT signal, service_name, count(*)::BIGINT AS n, sum(e)::BIGINT AS errors FROM signals GROUP BY 1, 2")
def signal_services(spark, d):
    return merging.sum_signals(_signals(spark, d), ["signal", "service_name"]).select("signal", "service_name", "n", "errors")


@_query(f"WITH {V.EVT}, {V.LOGS}, {_SIGNALS} SELECT signal, {V.stamp('w')} AS bucket, count(*)::BIGINT AS n, sum(e)::BIGINT AS errors FROM signals GROUP BY 1, 2")
def signal_windows(spark, d):
    return merging.sum_signals(_signals(spark, d), ["signal", "window"]).select("signal", stamp("window").alias("bucket"), "n", "errors")


@_query(f"WITH {V.EVT}, {V.LOGS}, {_SIGNALS} SELECT count(*)::BIGINT AS n, sum(e)::BIGINT AS errors, true AS bare FROM signals")
def signal_totals(spark, d):
    return merging.sum_signals(_signals(spark, d), []).select("n", "errors", F.coalesce(*merging.DIMENSIONS[1:]).isNull().alias("bare"))


@_query(
    f"""WITH {V.EVT}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, service_name ORDER BY start_time, span_id) AS place FROM spans),
n AS (SELECT tenant_id, service_name, count(*)::BIGINT AS spans, count(*) FILTER ({V.ERROR}) / count(*) AS rate, avg(duration_us / 1000) AS mean, quantile_disc(duration_us, 0.99) FILTER (place <= 100) / 1000 AS p99 FROM r GROUP BY 1, 2),
s AS (SELECT *, greatest(0, least(1, 1 - 5 * rate - 0.1 * greatest(0, (mean - 100) / 100))) AS score FROM n)
SELECT tenant_id, service_name, spans, round(spans / 3600, 6) AS rps, round(rate, 6) AS error_rate, round(mean, 4) AS avg_ms, p99 AS p99_ms, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'healthy' WHEN score >= 0.7 THEN 'degraded' ELSE 'critical' END AS state,
concat_ws('; ', CASE WHEN rate > 0.05 THEN 'high error rate: ' || floor(rate * 100)::INTEGER || '%' END, CASE WHEN p99 > 500 THEN 'p99 latency exceeds 500ms' END) AS alerts,
concat_ws('; ', CASE WHEN rate > 0.05 THEN 'error rate above 5%' END, CASE WHEN rate > 0.1 THEN 'error rate above 10% — investigate immediately' END, CASE WHEN mean > 50 THEN 'avg latency above 500ms' END, CASE WHEN mean > 100 THEN 'avg latency above 1s — SLA breach risk' END) AS by_mean FROM s"""
)
def service_nodes(spark, d):
    """The first hundred spans' p99; the alerts by mean are asked of ten times the mean, so that they fire."""
    out = merging.service_nodes(T.event_spans(spark, d), 3600, 100)
    rounded = [F.round(c, p).alias(c) for c, p in (("rps", 6), ("error_rate", 6), ("avg_ms", 4), ("score", 6))]
    by_mean = S.alerts_by_mean(F.col("error_rate"), F.col("avg_ms") * 10)
    return out.select("tenant_id", "service_name", "spans", *rounded, "p99_ms", "state", F.array_join("alerts", "; ").alias("alerts"), F.array_join(by_mean, "; ").alias("by_mean"))


@_query(f"WITH {V.EVT} SELECT span_id, (SELECT count(*) FROM spans WHERE {V.ERROR})::BIGINT AS total FROM spans WHERE {V.ERROR} ORDER BY start_time DESC, span_id LIMIT 15 OFFSET 30")
def counted_page(spark, d):
    spans = T.event_spans(spark, d).where(traffic.is_error())
    return merging.counted_page(spans, [F.desc("start_time"), F.col("span_id")], 15, 30).select("span_id", "total")


@_query(f"WITH {V.EVT} SELECT span_id, {V.stamp('start_time')} AS moment FROM spans WHERE (start_time, span_id) > (TIMESTAMP '2024-01-15 12:00:00', '5') ORDER BY start_time, span_id LIMIT 500")
def read_above(spark, d):
    return merging.read_above(T.event_spans(spark, d), (datetime(2024, 1, 15, 12), "5"), ["start_time", "span_id"], 500).select("span_id", stamp("start_time").alias("moment"))


@_query(
    f"""WITH {V.METRICS}, w AS (SELECT service_name, name, {V.window('moment', 30)} AS w, count(*)::BIGINT AS n FROM points GROUP BY 1, 2, 3), x AS (SELECT *, max(w) OVER (PARTITION BY service_name, name) AS newest FROM w)
SELECT service_name, name, {V.stamp('w')} AS bucket, n FROM x WHERE w > newest - INTERVAL 3600 SECOND"""
)
def ring_slots(spark, d):
    windows = T.event_metrics(spark, d).groupBy(*_SERIES, S.window_start(F.col("timestamp"), 30).alias("window")).agg(F.count(F.lit(1)).alias("n"))
    return merging.ring_slots(windows, _SERIES).select(*_SERIES, stamp("window").alias("bucket"), "n")


@_query(
    f"""WITH {V.EVT}, s AS (SELECT tenant_id, {V.window('start_time', 86400)} AS w, service_name || '-' || operation_name AS name, min(span_id::BIGINT) AS first_seen FROM spans GROUP BY ALL)
SELECT tenant_id, name, {V.stamp('w')} AS bucket, row_number() OVER (PARTITION BY tenant_id, w ORDER BY first_seen, name) <= 5 AS kept FROM s"""
)
def window_budget(spark, d):
    spans = T.event_spans(spark, d)
    series = spans.groupBy("tenant_id", S.window_start(F.col("start_time"), 86400).alias("window"), F.concat_ws("-", "service_name", "operation_name").alias("name")).agg(F.min(F.col("span_id").cast("long")).alias("first_seen"))
    return merging.ranked_by_window(series, ["tenant_id"], 5).select("tenant_id", "name", stamp("window").alias("bucket"), "kept")


@_query(
    """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [105, 0] || list_transform(string_split('pod-' || c_custkey, ''), lambda c: ascii(c)) ELSE [116, 0, 0] || list_transform(string_split(c_mktsegment, ''), lambda c: ascii(c)) || [0] || list_transform(string_split('h' || c_custkey % 7, ''), lambda c: ascii(c)) || [0, 0] END AS octets FROM customer)
SELECT c_custkey, printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(octets, lambda o: o::HUGEINT)), lambda a, o: (xor(a, o) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT) AS producer FROM k"""
)
def producers(spark, d):
    i, none = F.col("c_custkey"), F.lit(None).cast("string")
    instance = F.when(i % 2 == 0, F.concat(F.lit("pod-"), i.cast("string")))
    return T.table(spark, d, "customer").select("c_custkey", S.producer_id(instance, none, F.col("c_mktsegment"), F.concat(F.lit("h"), (i % 7).cast("string")), F.lit("")).alias("producer"))


@_query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 60 * 60000000.0 WHEN 1 THEN 3600000000.0 + event_id % 60 * 1000000.0 WHEN 2 THEN -(event_id % 10 + 0.5) * 1000.0 WHEN 3 THEN NULL WHEN 4 THEN 0.0 END::DOUBLE AS micros,
CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS moment FROM events"""
)
def parsed_times(spark, d):
    i, text = F.col("event_id"), lambda c: F.date_format(F.col("ts").cast("timestamp"), c)
    n = lambda m: (i % m).cast("string")
    span = F.when(i % 6 == 0, F.concat(n(60), F.lit("m"))).when(i % 6 == 1, F.concat(F.lit("1h"), n(60), F.lit("s"))).when(i % 6 == 2, F.concat(F.lit("-"), n(10), F.lit(".5ms"))).when(i % 6 == 3, "5 minutes").when(i % 6 == 4, "0").otherwise("1h!")
    moment = F.when(i % 3 == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, text("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(text("yyyy-MM-dd HH:mm"))
    return T.table(spark, d, "events").select("event_id", S.parse_duration(span).alias("micros"), stamp(S.parse_moment(moment)).alias("moment"))


@_query(
    """SELECT event_id, CASE WHEN event_id % 7 > 5 THEN false WHEN event_id % 3 = 0 THEN true ELSE event_id % 7 = 0 AND event_id % 5 = 0 END AS valid FROM events"""
)
def valid_series(spark, d):
    """Traces and logs with classes of 0 to 6, and a method on four of five."""
    i = F.col("event_id")
    signal, method = F.when(i % 3 == 0, "trace").otherwise("log"), F.when(i % 5 == 0, "NONE").otherwise("GET")
    return T.table(spark, d, "events").select("event_id", S.valid_series(signal, F.col("event_type"), i % 7, method, F.lit("unspecified")).alias("valid"))


@_query(
    f"""WITH RECURSIVE {V.CONV}, {V.CALLS}, u AS (SELECT tenant_id, a, b, 1.0::DOUBLE / max(calls) AS w FROM (SELECT tenant_id, caller AS a, callee AS b, calls FROM edges UNION ALL SELECT tenant_id, callee, caller, calls FROM edges) GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT tenant_id, 'user-1' AS node, 0.0::DOUBLE AS dist, ['user-1'] AS path FROM edges UNION ALL SELECT u.tenant_id, b, round(dist + w, 12), list_append(path, b) FROM p JOIN u ON u.tenant_id = p.tenant_id AND a = node WHERE NOT list_contains(path, b))
SELECT tenant_id, node AS service, array_to_string(arg_min(path, (dist, path)), '>') AS path FROM p GROUP BY 1, 2"""
)
def shortest_route(spark, d):
    return graph.shortest_routes(_conv_edges(spark, d), "user-1").select("tenant_id", "service", F.array_join("path", ">").alias("path"))


@_query()
def tenant_templates(spark, d):
    """Each template of a whole tenant with its lines, and whether it is one of the 200 used last; mining has no SQL."""
    scope = ["tenant_id"]
    mined = mining.mine(T.document_logs(spark, d), scope, None)
    kept = mining.live(mined.templates, scope, 200).select(*scope, "made_at", "made_log", F.lit(True).alias("live"))
    rows = mined.templates.where("alias_at is null").join(kept, [*scope, "made_at", "made_log"], "left")
    lines = mined.lines.join(mining.aliases(mined.templates, scope), [*scope, "made_at", "made_log"]).groupBy(*scope, F.col("final_at").alias("made_at"), F.col("final_log").alias("made_log")).agg(F.sum("n").alias("n"))
    return rows.drop("n").join(lines, [*scope, "made_at", "made_log"]).select(*scope, F.array_join("words", " ").alias("template"), "n", F.coalesce("live", F.lit(False)).alias("live"))


@_query(
    """SELECT (event_id % 5)::VARCHAR AS series, count(*)::BIGINT AS n, sum(event_id % 9 + 1)::BIGINT AS observations, round(sum(value), 4) AS sum, bool_and(event_id % 20 >= 2 AND event_id % 6 <> 5) AS percentiles FROM events GROUP BY 1"""
)
def exponential_scalars(spark, d):
    """Scales of -2 to 17, and negative counts on every sixth point."""
    i = F.col("event_id")
    points = T.table(spark, d, "events").select((i % 5).cast("string").alias("series"), (i % 20 - 2).cast("int").alias("scale"), (i % 9 + 1).alias("count"), F.col("value").alias("sum"), F.when(i % 6 == 5, 3).otherwise(0).cast("long").alias("negative"))
    return histogram.exponential_scalars(points, ["series"]).withColumn("sum", F.round("sum", 4))
