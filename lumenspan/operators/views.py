"""Rows as the JSON that a client reads: fixed field names and units, one document a row.

Each function takes a DataFrame of the library's shape and gives ``body`` beside the key columns. Texts and numbers that are
null become empty or 0, optional fields that are null are left out, moments are RFC 3339 in UTC with as many digits as they
need, and latencies are milliseconds. Lists that a document holds are those already in its row: no row is gathered from others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(c: str | Column) -> Column:
    """A timestamp as RFC 3339 text in UTC, whatever the session's zone."""
    utc = F.to_utc_timestamp(F.col(c) if isinstance(c, str) else c, F.current_timezone())
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1"), F.lit("Z"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def _long(c: str, name: str | None = None) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(name or c)


def _double(c: str | Column, name: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)).alias(name)


def _body(rows: DataFrame, keys: list[str], fields: list[Column]) -> DataFrame:
    return rows.select(*keys, F.to_json(F.struct(*fields)).alias("body"))


def spans(rows: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, span_id, body); the end is the start and the duration."""
    end = F.timestamp_micros(F.unix_micros("start_time") + F.col("duration_us"))
    attributes = F.coalesce("attributes_json", F.lit("")) if "attributes_json" in rows.columns else F.lit("")
    fields = [_text("trace_id"), _text("span_id"), _text("parent_span_id"), _text("operation_name"), moment("start_time").alias("start_time"), moment(end).alias("end_time"), _long("duration_us", "duration"), _text("service_name"), _text("status"), attributes.alias("attributes_json")]
    return _body(rows, ["tenant_id", "trace_id", "span_id"], fields)


def traces(rows: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, body) of ``traffic.traces``: both the microseconds and the milliseconds."""
    fields = [_text("trace_id"), _text("service_name"), _text("operation"), _text("status"), _long("duration_us", "duration"), _double(F.col("duration_us") / 1000, "duration_ms"), _long("span_count"), moment("start_time").alias("timestamp")]
    return _body(rows, ["tenant_id", "trace_id"], fields)


def logs(rows: DataFrame) -> DataFrame:
    """(tenant_id, log_id, body)."""
    attributes = F.coalesce("attributes_json", F.lit("")) if "attributes_json" in rows.columns else F.lit("")
    span = _text("span_id") if "span_id" in rows.columns else F.lit("").alias("span_id")
    fields = [_long("log_id", "id"), _text("trace_id"), span, _text("severity"), F.coalesce("body", F.lit("")).alias("body"), _text("service_name"), attributes.alias("attributes_json"), moment("timestamp").alias("timestamp")]
    return _body(rows, ["tenant_id", "log_id"], fields)


def metric_buckets(rows: DataFrame) -> DataFrame:
    """(tenant_id, body) of ``rollup.tsdb_buckets``."""
    fields = [_text("name"), _text("service_name"), moment("window").alias("time_bucket"), _double("min", "min"), _double("max", "max"), _double("sum", "sum"), _long("count"), F.coalesce("attributes", F.lit("")).alias("attributes_json")]
    return _body(rows, ["tenant_id"], fields)


def service_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tenant_id, part, body): each node and each edge of ``traffic.service_map_nodes`` and ``service_map_edges``."""
    n = _body(nodes, ["tenant_id", F.lit("node").alias("part")], [F.coalesce("service_name", F.lit("")).alias("name"), _long("spans", "total_traces"), _long("errors", "error_count"), _double("avg_ms", "avg_latency_ms")])
    e = _body(edges, ["tenant_id", F.lit("edge").alias("part")], [F.coalesce("caller", F.lit("")).alias("source"), F.coalesce("callee", F.lit("")).alias("target"), _long("calls", "call_count"), _double("avg_ms", "avg_latency_ms"), _double("error_rate", "error_rate")])
    return n.unionByName(e)


def dashboard(row: DataFrame, failing: DataFrame, most: int = 5) -> DataFrame:
    """(body,) of ``traffic.dashboard`` with the ``most`` worst of the services of ``traffic.top_failing``."""
    entry = F.struct(F.col("service_name"), F.col("errors").alias("error_count"), F.col("total").alias("total_count"), F.col("error_rate"))
    order = F.struct((-F.col("errors")).alias("o"), F.col("service_name").alias("s"), F.col("tenant_id").alias("t"), entry.alias("entry"))
    worst = failing.orderBy(F.desc("errors"), "service_name", "tenant_id").limit(most)
    listed = worst.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["entry"]).alias("listed"))  # ``most`` rows
    both = row.crossJoin(F.broadcast(listed))  # a single row
    fields = [_long("total_traces"), _long("total_logs"), _long("total_errors"), _double("avg_latency_ms", "avg_latency_ms"), _double("error_rate", "error_rate"), _long("active_services"), _double(F.col("p99_latency_us") / 1000, "p99_latency_ms"), F.when(F.size("listed") > 0, F.col("listed")).alias("top_failing_services")]
    return _body(both, [], fields)
