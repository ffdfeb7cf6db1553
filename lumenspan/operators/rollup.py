"""Mergeable five-minute aggregates: reduce, merge, sum, overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sketch
from ..schema import OTHER
from .traffic import is_error

#: How each measure of a delta merges.
SUMS = ("n", "errors", "requests", "duration_sum")
SPAN_KEYS = ["tenant_id", "service_name", "operation_name", "status"]


def reduce_spans(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Deltas of (window, series): counts, requests, duration sums and extremes."""
    keys = keys or SPAN_KEYS
    kind = F.col("kind") if "kind" in spans.columns else F.lit(None).cast("int")
    rows = spans.withColumn("window", S.window_start(F.col("start_time"))).withColumn("request", S.is_request(F.col("parent_span_id"), kind))
    return rows.groupBy("window", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.count_if(F.col("request")).alias("requests"),
        F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"),
    )


def merge_deltas(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Commutative and associative: sums add, extremes meet."""
    return deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("duration_min").alias("duration_min"), F.max("duration_max").alias("duration_max"))


def sum_buckets(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Scalars by any subset of window, service and name; the empty set gives one row."""
    return deltas.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS], F.min("duration_min").alias("duration_min"), F.max("duration_max").alias("duration_max"))


def rollup_cube(deltas: DataFrame) -> DataFrame:
    """All groupings of service and operation at once, one shuffle for them all."""
    return deltas.cube("service_name", "operation_name").agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def reduce_edges(calls: DataFrame) -> DataFrame:
    """Deltas of service edges; all measures are the callee's."""
    rows = calls.withColumn("window", S.window_start(F.col("start_time")))
    return rows.groupBy("window", "tenant_id", "caller", "callee").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.sum("duration_us").alias("duration_sum"))


def edge_series(calls: DataFrame, parsed: dict[str, Column], variant: Column) -> DataFrame:
    """Deltas of edges by the whole series key: the ends, and status, HTTP class, method and kind of the callee; all measures are the callee's.

    Calls with an empty end, or onto the same service, are none. ``parsed`` has ``http_class`` and ``method``.
    """
    real = calls.where("caller <> '' and callee <> '' and caller <> callee")
    kind = F.col("kind") if "kind" in calls.columns else F.lit(None).cast("int")
    rows = real.withColumns({"http_class": parsed["http_class"], "method": parsed["method"], "variant": variant, "window": S.window_start(F.col("start_time")), "request": S.is_request(F.col("parent_span_id"), kind)})
    return rows.groupBy("window", "tenant_id", "caller", "callee", "status", "http_class", "method", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.count_if("request").alias("requests"),
        F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"),
    )


def canonical(attributes: Column) -> Column:
    """JSON attributes with their names in order and no blanks, so that equal ones are equal texts; none, or no JSON, is ``{}``."""
    return F.coalesce(F.to_json(F.try_parse_json(attributes)), F.lit("{}"))


def tsdb_buckets(points: DataFrame, per_tenant: int = 0, in_all: int = 0, seconds: int = 30) -> DataFrame:
    """Buckets of (tenant, service, name, attributes) with extremes, sum and count; ``points`` have ``attributes`` and ``seq``.

    In each window a tenant's first ``per_tenant`` series by (timestamp, seq) have buckets of their own; what comes beyond
    falls into the tenant's ``__overflow__``. Of the others, those beyond the first ``in_all`` of the window fall into one
    for all tenants, ``__global__``. Both carry their first point's service and no attributes. A cap of 0 is none. Points
    are reduced to buckets first, and the ranking is over those.
    """
    key = ["window", "tenant_id", "service_name", "name", "attributes"]
    rows = points.withColumns({"window": S.window_start(F.col("timestamp"), seconds), "attributes": canonical(F.col("attributes"))})
    at = F.struct("timestamp", "seq")
    out = rows.groupBy(*key).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"), F.min(at).alias("first"))
    if not per_tenant and not in_all:
        return out.drop("first")
    out = out.withColumns({"place": F.struct("first", "tenant_id", "service_name", "name", "attributes"), "tenant_last": F.lit(None), "all_last": F.lit(None)})
    within = F.coalesce(F.col("place") <= F.col("tenant_last"), F.lit(True))
    for scope, most, column in ((["window", "tenant_id"], per_tenant, "tenant_last"), (["window"], in_all, "all_last")):
        if most:
            # a task keeps no more of a scope than its cap before the shuffle; the others are compared with the last one kept
            top = out.where(within).withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("place"))).where(F.col("rank") <= most)
            full = F.when(F.count(F.lit(1)) == most, F.max("place"))
            out = out.drop(column).join(top.groupBy(*scope).agg(full.alias(column)), scope, "left")
    # a tenant is full only if its last series came before the window was full
    over = F.coalesce(F.col("place") > F.col("all_last"), F.lit(False))
    filled = F.coalesce(F.col("tenant_last") <= F.col("all_last"), F.col("tenant_last").isNotNull())
    out = out.withColumn("tenant_over", F.coalesce(F.col("place") > F.col("tenant_last"), F.lit(False)) & filled).withColumn("over", over & ~F.col("tenant_over"))
    own, both = ~F.col("tenant_over") & ~F.col("over"), F.col("tenant_over") | F.col("over")
    routed = out.withColumns({
        "service": F.when(own, F.col("service_name")), "attributes": F.when(own, F.col("attributes")), "tenant": F.when(F.col("over"), "__global__").otherwise(F.col("tenant_id")), "name": F.when(both, "__overflow__").otherwise(F.col("name")),
    })
    merged = routed.groupBy("window", "tenant", "service", "name", "attributes").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min_by("service_name", "place").alias("first_service"))
    return merged.select("window", F.col("tenant").alias("tenant_id"), F.coalesce("service", "first_service").alias("service_name"), "name", "attributes", "min", "max", "sum", "count")


def reduce_logs(logs: DataFrame) -> DataFrame:
    """Deltas of logs by service and severity tier; error means tier 5 or more."""
    tier = S.severity_tier(F.col("severity"), F.lit(None).cast("int")).cast("long")
    rows = logs.withColumn("window", S.window_start(F.col("timestamp"))).withColumn("tier", tier)
    return rows.groupBy("window", "tenant_id", "service_name", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") >= 5).alias("errors"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def gauges(points: DataFrame, keys: list[str]) -> DataFrame:
    """count, sum, min, max and last by (timestamp, seq) of gauge points."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", F.struct("timestamp", "seq")).alias("last")
    )


def metric_ring(points: DataFrame, seconds: int = 30, samples: int = 256) -> DataFrame:
    """Count, sum, extremes and nearest-rank percentiles of the first ``samples`` points of each series and window."""
    keys = ["tenant_id", "service_name", "name", "window"]
    rows = points.withColumn("window", S.window_start(F.col("timestamp"), seconds))
    kept = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "seq")))
    first = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN rn <= {samples} THEN value END)")
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), first(0.5).alias("p50"), first(0.95).alias("p95"), first(0.99).alias("p99"))


def moving_mean(points: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Exponential moving mean over time: the first value, then a share ``alpha`` of each next one.

    It is a weighted sum, with weights that fall by 1 - alpha from each point to the one before, so
    numbered points are summed with partial aggregation.
    """
    late = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("seq"))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "seq")) == 1
    rows = points.withColumns({"age": F.row_number().over(late) - 1, "first": last})
    weight = F.pow(F.lit(1 - alpha), F.col("age")) * F.when(F.col("first"), 1.0).otherwise(alpha)
    return rows.groupBy(*keys).agg(F.sum(weight * F.col("value")).alias("ema"), F.min("value").alias("min"), F.max("value").alias("max"))


def overflow(rows: DataFrame, scope: list[str], name: str, order: list[str], most: int) -> DataFrame:
    """Names beyond the first ``most`` of their scope, by first use, become __other__; totals stay whole.

    The ranking is over distinct names, so no scope's rows meet in one task.
    """
    first = rows.groupBy(*scope, name).agg(F.min(F.struct(*order)).alias("first"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("first", name)))
    routed = ranked.select(*scope, name, F.when(F.col("rank") > most, OTHER).otherwise(F.col(name)).alias("routed"))
    return rows.join(routed, [*scope, name]).drop(name).withColumnRenamed("routed", name)


def dashboard_quantiles(spans: DataFrame, qs: list[float]) -> DataFrame:
    """Quantiles by service from the mergeable sketch."""
    return sketch.quantiles(sketch.build(spans, ["service_name"], "duration_us"), ["service_name"], qs)


def union_sources(finalized: DataFrame, live: DataFrame, boundary: Column | str) -> DataFrame:
    """Final windows before the boundary and live ones from it on: each contribution once."""
    edge = F.lit(boundary) if isinstance(boundary, str) else boundary
    edge = edge.cast("timestamp")
    return finalized.where(F.col("window") < edge).unionByName(live.where(F.col("window") >= edge))
