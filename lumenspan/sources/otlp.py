"""Trace, log and metric export requests (JSON) flattened to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "STRUCT<stringValue:STRING,intValue:STRING,boolValue:BOOLEAN,doubleValue:DOUBLE>"
_ATTRS = f"ARRAY<STRUCT<key:STRING,value:{_VALUE}>>"
_RESOURCE = f"resource:STRUCT<attributes:{_ATTRS}>"
_POINT = f"STRUCT<attributes:{_ATTRS},startTimeUnixNano:STRING,timeUnixNano:STRING,asDouble:DOUBLE,asInt:STRING,flags:INT>"
_HIST = f"STRUCT<attributes:{_ATTRS},timeUnixNano:STRING,count:STRING,sum:DOUBLE,min:DOUBLE,max:DOUBLE,bucketCounts:ARRAY<STRING>,explicitBounds:ARRAY<DOUBLE>>"
_BUCKETS = "STRUCT<offset:INT,bucketCounts:ARRAY<STRING>>"
_EXPONENTIAL = f"STRUCT<attributes:{_ATTRS},timeUnixNano:STRING,count:STRING,sum:DOUBLE,scale:INT,zeroCount:STRING,positive:{_BUCKETS},negative:{_BUCKETS}>"
TRACE_SCHEMA = (
    f"resourceSpans ARRAY<STRUCT<{_RESOURCE},scopeSpans:ARRAY<STRUCT<spans:ARRAY<STRUCT<traceId:STRING,spanId:STRING,parentSpanId:STRING,name:STRING,kind:INT,"
    f"startTimeUnixNano:STRING,endTimeUnixNano:STRING,attributes:{_ATTRS},status:STRUCT<code:INT,message:STRING>,events:ARRAY<STRUCT<name:STRING,timeUnixNano:STRING,attributes:{_ATTRS}>>>>>>>>"
)
LOG_SCHEMA = (
    f"resourceLogs ARRAY<STRUCT<{_RESOURCE},scopeLogs:ARRAY<STRUCT<logRecords:ARRAY<STRUCT<timeUnixNano:STRING,severityNumber:INT,severityText:STRING,body:{_VALUE},traceId:STRING,spanId:STRING,attributes:{_ATTRS}>>>>>>"
)
METRIC_SCHEMA = (
    f"resourceMetrics ARRAY<STRUCT<{_RESOURCE},scopeMetrics:ARRAY<STRUCT<metrics:ARRAY<STRUCT<name:STRING,gauge:STRUCT<dataPoints:ARRAY<{_POINT}>>,"
    f"sum:STRUCT<aggregationTemporality:INT,isMonotonic:BOOLEAN,dataPoints:ARRAY<{_POINT}>>,histogram:STRUCT<aggregationTemporality:INT,dataPoints:ARRAY<{_HIST}>>,"
    f"exponentialHistogram:STRUCT<aggregationTemporality:INT,dataPoints:ARRAY<{_EXPONENTIAL}>>,summary:STRUCT<dataPoints:ARRAY<STRUCT<timeUnixNano:STRING>>>>>>>>>"
)
DEFAULT_SERVICE = "unknown-service"


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Export requests, one for each line, or one for each file; gzip is read as it is."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def stream_json(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Export requests as a stream, so many files a micro-batch: each file once, also after a restart from its checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def attribute(attrs: Column, key: str) -> Column:
    """The value of an attribute as text; null if absent."""
    v = F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def attributes_json(attrs: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    return F.to_json(F.map_from_entries(F.transform(F.coalesce(attrs, F.array().cast(_ATTRS)), lambda a: F.struct(a["key"], text(a["value"])))))


def _service(resource: Column) -> Column:
    return F.coalesce(F.nullif(attribute(resource["attributes"], "service.name"), F.lit("")), F.lit(DEFAULT_SERVICE))


def _nanos(c: Column) -> Column:
    return F.timestamp_micros(F.floor(c.cast("decimal(20,0)") / 1000).cast("long"))


def spans(requests: DataFrame, tenant: str = "default") -> DataFrame:
    r = requests.select(F.explode("resourceSpans").alias("r")).select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeSpans").alias("s")).select("service_name", F.explode("s.spans").alias("x"))
    start, end = F.col("x.startTimeUnixNano").cast("decimal(20,0)"), F.col("x.endTimeUnixNano").cast("decimal(20,0)")
    code = F.coalesce(F.col("x.status.code"), F.lit(0))
    return r.select(
        F.lit(tenant).alias("tenant_id"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.coalesce("x.parentSpanId", F.lit("")).alias("parent_span_id"),
        F.col("x.name").alias("operation_name"), "service_name", _nanos(F.col("x.startTimeUnixNano")).alias("start_time"), F.floor((end - start) / 1000).cast("long").alias("duration_us"),
        F.when(code == 2, "STATUS_CODE_ERROR").when(code == 1, "STATUS_CODE_OK").otherwise("STATUS_CODE_UNSET").alias("status"), F.col("x.kind").alias("kind"),
        attributes_json(F.col("x.attributes")).alias("attributes_json"), F.col("x.events").alias("events"), F.col("x.status.message").alias("status_message"),
    )


def logs(requests: DataFrame, now: Column, tenant: str = "default") -> DataFrame:
    """Severity text, else the number's name; a time of 0 means ``now``."""
    r = requests.select(F.explode("resourceLogs").alias("r")).select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeLogs").alias("s")).select("service_name", F.explode("s.logRecords").alias("x"))
    names = F.array(*[F.lit(n) for n in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")])
    number = F.coalesce(F.col("x.severityNumber"), F.lit(0))
    by_number = F.when(number.between(1, 24), F.get(names, F.floor((number - 1) / 4).cast("int"))).otherwise("")
    nanos = F.coalesce(F.col("x.timeUnixNano"), F.lit("0"))
    return r.select(
        F.lit(tenant).alias("tenant_id"), F.coalesce("x.traceId", F.lit("")).alias("trace_id"), F.coalesce("x.spanId", F.lit("")).alias("span_id"),
        F.coalesce(F.nullif("x.severityText", F.lit("")), by_number).alias("severity"), F.coalesce("x.body.stringValue", F.lit("")).alias("body"), "service_name",
        attributes_json(F.col("x.attributes")).alias("attributes_json"), F.when(nanos == "0", now).otherwise(_nanos(nanos)).alias("timestamp"),
    )


def number_points(requests: DataFrame, tenant: str = "default") -> DataFrame:
    """Points of gauges and sums, without those flagged as holding no value."""
    m = requests.select(F.explode("resourceMetrics").alias("r")).select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeMetrics").alias("s")).select("service_name", F.explode("s.metrics").alias("m"))
    kind = F.when(F.col("m.sum").isNotNull(), F.when(F.col("m.sum.aggregationTemporality") == 1, "delta").when(F.col("m.sum.isMonotonic"), "cumulative").otherwise("gauge")).otherwise("gauge")
    p = m.select("service_name", F.col("m.name").alias("name"), kind.alias("dispatch"), F.explode(F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).alias("p"))
    p = p.where(F.coalesce(F.col("p.flags"), F.lit(0)).bitwiseAND(1) == 0)
    return p.select(
        F.lit(tenant).alias("tenant_id"), "service_name", "name", "dispatch", F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value"),
        _nanos(F.coalesce("p.startTimeUnixNano", F.lit("0"))).alias("start_ts"), _nanos(F.col("p.timeUnixNano")).alias("timestamp"),
    )


def histogram_points(requests: DataFrame) -> DataFrame:
    """Explicit-bounds points in the shape that the folding takes."""
    m = requests.select(F.explode("resourceMetrics").alias("r")).select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeMetrics").alias("s")).select("service_name", F.explode("s.metrics").alias("m"))
    h = m.where("m.histogram is not null").select("service_name", F.col("m.name").alias("name"), F.col("m.histogram.aggregationTemporality").alias("t"), F.explode("m.histogram.dataPoints").alias("p"))
    return h.select(
        "service_name", "name", _nanos(F.col("p.timeUnixNano")).alias("timestamp"), F.col("p.explicitBounds").alias("bounds"), F.transform("p.bucketCounts", lambda c: c.cast("long")).alias("counts"),
        F.col("p.count").cast("long").alias("count"), F.col("p.sum").alias("sum"), F.col("p.min").alias("min"), F.col("p.max").alias("max"), F.when(F.col("t") == 1, "delta").otherwise("cumulative").alias("temporality"),
    )


def _metrics(requests: DataFrame) -> DataFrame:
    return requests.select(F.explode("resourceMetrics").alias("r")).select(_service(F.col("r.resource")).alias("service_name"), F.explode("r.scopeMetrics").alias("s")).select("service_name", F.explode("s.metrics").alias("m"))


def exponential_points(requests: DataFrame) -> DataFrame:
    """Exponential points of delta temporality in the shape that the folding takes; ``negative`` counts what is below zero."""
    h = _metrics(requests).where("m.exponentialHistogram.aggregationTemporality = 1").select("service_name", F.col("m.name").alias("name"), F.explode("m.exponentialHistogram.dataPoints").alias("p"))
    longs = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("long")), F.array().cast("array<long>"))
    return h.select(
        "service_name", "name", _nanos(F.col("p.timeUnixNano")).alias("timestamp"), F.coalesce("p.scale", F.lit(0)).alias("scale"), F.coalesce("p.positive.offset", F.lit(0)).alias("offset"), longs("p.positive.bucketCounts").alias("counts"),
        F.coalesce(F.col("p.zeroCount").cast("long"), F.lit(0)).alias("zeros"), F.aggregate(longs("p.negative.bucketCounts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("negative"), F.col("p.count").cast("long").alias("count"), "p.sum",
    )


def rejected_points(requests: DataFrame) -> DataFrame:
    """(service_name, reason, n): points that aren't taken: histograms that are not deltas, and all summaries."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    kinds = [
        ("temporality", F.when(F.coalesce("m.histogram.aggregationTemporality", F.lit(0)) != 1, size("m.histogram.dataPoints"))),
        ("temporality", F.when(F.coalesce("m.exponentialHistogram.aggregationTemporality", F.lit(0)) != 1, size("m.exponentialHistogram.dataPoints"))),
        ("summary", size("m.summary.dataPoints")),
    ]
    rows = _metrics(requests).select("service_name", F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.coalesce(n, F.lit(0)).alias("n")) for r, n in kinds])).alias("x"))
    return rows.where("x.n > 0").groupBy("service_name", F.col("x.reason").alias("reason")).agg(F.sum("x.n").alias("n"))


def synthesized_logs(span_rows: DataFrame, per_span: int = 8) -> DataFrame:
    """A log for each event of a span, and one for a failed span without an exception event; at most ``per_span``."""
    message = lambda e: F.coalesce(attribute(e["attributes"], "exception.message"), e["name"])
    events = F.coalesce("events", F.array().cast(span_rows.schema["events"].dataType))
    listed = F.transform(events, lambda e: F.struct(F.when(e["name"] == "exception", "ERROR").otherwise("INFO").alias("severity"), message(e).alias("body")))
    failed = (F.col("status") == "STATUS_CODE_ERROR") & ~F.exists(events, lambda e: e["name"] == "exception")
    text = F.coalesce(F.nullif("status_message", F.lit("")), F.concat(F.lit("Span '"), "operation_name", F.lit("' failed")))
    extra = F.when(failed, F.array(F.struct(F.lit("ERROR").alias("severity"), text.alias("body")))).otherwise(F.array().cast("array<struct<severity:string,body:string>>"))
    rows = span_rows.select("tenant_id", "trace_id", "span_id", "service_name", "start_time", F.explode(F.slice(F.concat(listed, extra), 1, per_span)).alias("l"))
    return rows.select("tenant_id", "trace_id", "span_id", "service_name", F.col("start_time").alias("timestamp"), "l.severity", "l.body")
