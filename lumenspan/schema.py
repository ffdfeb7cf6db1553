"""Schemas of the telemetry tables, and the enumerations in them. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SPANS = _struct(
    ("tenant_id", _S), ("trace_id", _S), ("span_id", _S), ("parent_span_id", _S), ("operation_name", _S), ("service_name", _S),
    ("start_time", _TS), ("duration_us", _L), ("status", _S), ("kind", T.IntegerType()), ("attributes_json", _S),
)
TRACES = _struct(
    ("tenant_id", _S), ("trace_id", _S), ("service_name", _S), ("duration_us", _L), ("status", _S), ("timestamp", _TS),
    ("truncated", T.BooleanType()), ("retained_span_count", T.IntegerType()), ("observed_span_count", T.IntegerType()),
)
LOGS = _struct(
    ("tenant_id", _S), ("trace_id", _S), ("span_id", _S), ("severity", _S), ("body", _S), ("service_name", _S), ("attributes_json", _S), ("timestamp", _TS),
)
METRICS = _struct(("tenant_id", _S), ("service_name", _S), ("name", _S), ("value", _D), ("timestamp", _TS))

#: Status names, and windows and lateness of the rollup.
STATUS_ERROR, STATUS_UNSET = "STATUS_CODE_ERROR", "STATUS_CODE_UNSET"
WINDOW = "5 minutes"
WINDOW_SECONDS, LATENESS_SECONDS, FUTURE_SECONDS = 300, 600, 120
KIND_SERVER = 2
OTHER = "__other__"
