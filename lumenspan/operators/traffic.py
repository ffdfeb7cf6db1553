"""Dashboards, traffic, lists, service maps over raw spans and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import STATUS_ERROR
from .selection import exact_quantile

SORTABLE = {"timestamp": "start_time", "duration": "duration_us", "service_name": "service_name", "status": "status", "trace_id": "trace_id"}


def is_error() -> Column:
    return F.col("status") == STATUS_ERROR


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Both ends inclusive; an end that is None is open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df.where(F.col(column) <= F.lit(end)) if end is not None else df


def percentile_disc(column: str, q: float) -> Column:
    """The element at ceil(q n) of the ordered values."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def service_map_nodes(spans: DataFrame) -> DataFrame:
    named = spans.where("service_name <> ''")
    out = named.groupBy("tenant_id", "service_name").agg(F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors"), F.avg("duration_us").alias("mean"))
    return out.select("tenant_id", "service_name", "spans", "errors", S.scaled_round(F.col("mean") / 1000, 2).alias("avg_ms"))


def calls(spans: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Child spans with their parents' service, where both have one and they differ.

    Parent and child share a trace, so the join is on (tenant, trace, span); of duplicated
    span ids one row stands, the smallest by service. ``owners`` are all spans that any other names
    as its parent, where a source can tell them; without it, any span may be one.
    """
    parents = (spans if owners is None else owners).where("service_name <> ''").groupBy("tenant_id", "trace_id", F.col("span_id").alias("parent_span_id")).agg(F.min("service_name").alias("caller"))
    children = spans.where("service_name <> '' and parent_span_id <> '' and parent_span_id <> '0000000000000000'")
    joined = children.join(parents, ["tenant_id", "trace_id", "parent_span_id"])
    return joined.where("caller <> service_name").withColumnRenamed("service_name", "callee")


def service_map_edges(spans: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    out = calls(spans, owners).groupBy("tenant_id", "caller", "callee").agg(F.count(F.lit(1)).alias("calls"), F.count_if(is_error()).alias("errors"), F.avg("duration_us").alias("mean"))
    return out.select("tenant_id", "caller", "callee", "calls", S.scaled_round(F.col("mean") / 1000, 2).alias("avg_ms"), S.scaled_round(F.col("errors") / F.col("calls"), 4).alias("error_rate"))


def dashboard(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """One row of totals; rates in percent, durations in ms."""
    t = spans.agg(
        F.count(F.lit(1)).alias("total_traces"),
        F.count_if(F.col("status").ilike("%ERROR%")).alias("total_errors"),
        F.avg("duration_us").alias("mean"),
        F.count_distinct("service_name").alias("active_services"),
    )
    p99 = exact_quantile(spans, [], "duration_us", 0.99).select(F.col("quantile").alias("p99"))
    n = logs.agg(F.count(F.lit(1)).alias("total_logs"))
    rate = F.when(F.col("total_traces") > 0, F.col("total_errors") / F.col("total_traces") * 100).otherwise(0.0)
    return t.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(p99)).select(  # three single rows
        "total_traces", "total_logs", "total_errors", S.scaled_round(rate, 4).alias("error_rate"),
        S.scaled_round(F.coalesce("mean", F.lit(0.0)) / 1000, 4).alias("avg_latency_ms"), "active_services", F.coalesce("p99", F.lit(0)).cast("long").alias("p99_latency_us"),
    )


def p99_exact(spans: DataFrame) -> DataFrame:
    """The exact p99 of each tenant's services; rows without a duration count for none."""
    return exact_quantile(spans, ["tenant_id", "service_name"], "duration_us", 0.99).select("tenant_id", "service_name", F.col("quantile").alias("p99_us"), "n")


def top_failing(spans: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` services of each tenant with the most errors."""
    out = spans.groupBy("tenant_id", "service_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error()).alias("errors"))
    out = out.where("errors > 0").withColumn("error_rate", S.scaled_round(F.col("errors") / F.col("total"), 6))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("errors"), "service_name"))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")


def traffic(spans: DataFrame, seconds: int) -> DataFrame:
    """(bucket, count, errors) in epoch-aligned buckets."""
    out = spans.groupBy(S.window_start(F.col("start_time"), seconds).alias("moment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"))
    return out.select(stamp("moment").alias("bucket"), "n", "errors")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def latency_heatmap(spans: DataFrame, most: int = 2000) -> DataFrame:
    newest = spans.orderBy(F.desc("start_time"), F.desc("span_id")).limit(most)
    return newest.select("span_id", stamp("start_time").alias("moment"), "duration_us")


def traces(spans: DataFrame) -> DataFrame:
    """One row for each (tenant, trace): start, duration, first service, status, spans and an operation."""
    first = F.struct("start_time", "span_id")
    rows = spans.groupBy("tenant_id", "trace_id").agg(
        F.min("start_time").alias("start_time"), F.max("duration_us").alias("duration_us"), F.min_by("service_name", first).alias("service_name"),
        F.max(is_error()).alias("error"), F.count(F.lit(1)).alias("span_count"), F.min("operation_name").alias("operation"),
    )
    return rows.withColumn("status", F.when(F.col("error"), STATUS_ERROR).otherwise("STATUS_CODE_UNSET")).withColumn("operation", F.coalesce("operation", F.lit("Unknown")))


def trace_list(
    spans: DataFrame, sort_by: str = "timestamp", descending: bool = True, limit: int = 50, offset: int = 0,
    tenant: str | None = None, status: str = "", trace_id: str = "", services: list[str] | None = None, start=None, end=None,
) -> DataFrame:
    """A page of traces and, in ``total``, how many the filters leave.

    ``status`` and ``trace_id`` are parts of the words looked for, in any case (% and _ stand for
    any characters); unknown sort columns mean timestamp; the offset is not below 0 and the limit
    between 1 and 1000.
    """
    key = SORTABLE.get(sort_by, "start_time")
    rows = in_range(traces(spans if tenant is None else spans.where(F.col("tenant_id") == tenant)), "start_time", start, end)
    for column, part in (("status", status), ("trace_id", trace_id)):
        rows = rows.where(F.col(column).ilike(f"%{part}%")) if part else rows
    rows = rows.where(F.col("service_name").isin(services)) if services else rows
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    order = F.desc(key) if descending else F.asc(key)
    page = rows.orderBy(order, "tenant_id", "trace_id").offset(max(0, offset)).limit(max(1, min(1000, limit))).crossJoin(F.broadcast(total))  # a single row
    return page.select("tenant_id", "trace_id", stamp("start_time").alias("moment"), "duration_us", "service_name", "status", "span_count", "operation", "total")


def trace_detail(spans: DataFrame, trace_id: str) -> DataFrame:
    one = spans.where(F.col("trace_id") == trace_id)
    return one.groupBy("trace_id").agg(F.array_sort(F.collect_list("span_id")).alias("ids"), F.sum("duration_us").alias("total_us")).select(
        "trace_id", F.array_join("ids", ",").alias("span_ids"), "total_us"
    )


def trace_upsert(spans: DataFrame) -> DataFrame:
    """One row for each trace: the first writer's fields win, but a later error turns the status."""
    first = F.struct("start_time", "span_id")
    out = spans.groupBy("tenant_id", "trace_id").agg(
        F.min_by("service_name", first).alias("service_name"), F.min_by("duration_us", first).alias("duration_us"), F.max(is_error()).alias("error"), F.count(F.lit(1)).alias("observed")
    )
    return out.select("tenant_id", "trace_id", "service_name", "duration_us", F.when(F.col("error"), STATUS_ERROR).otherwise("STATUS_CODE_UNSET").alias("status"), "observed")


def span_dedup(spans: DataFrame) -> DataFrame:
    """One row for each (tenant, trace, span): the one that started first."""
    w = Window.partitionBy("tenant_id", "trace_id", "span_id").orderBy("start_time", "duration_us", "service_name")
    return spans.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def orphan_spans(spans: DataFrame, traces: DataFrame, cutoff) -> DataFrame:
    """Spans older than the cutoff whose trace is gone."""
    return spans.where(F.col("start_time") < F.lit(cutoff)).join(traces.select("tenant_id", "trace_id"), ["tenant_id", "trace_id"], "left_anti")


def late_points(points: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Each point's class: late, future or accepted, by its own arrival."""
    start = S.window_start(F.col("timestamp"))
    late = F.unix_micros(F.col(arrival)) >= F.unix_micros(start) + 900 * 1_000_000
    future = F.unix_micros("timestamp") - F.unix_micros(F.col(arrival)) > 120 * 1_000_000
    return points.withColumn("class", F.when(late, "late").when(future, "future").otherwise("accepted"))


def system_summary(nodes: DataFrame) -> DataFrame:
    """Each tenant's services by status and the unweighted mean of their rates; ``nodes``: (tenant_id, service_name, spans, errors, avg_ms)."""
    rate = F.when(F.col("spans") > 0, F.col("errors") / F.col("spans")).otherwise(0.0)
    scored = nodes.withColumn("rate", rate).withColumn("score", S.health_score_fallback(F.col("rate"), F.col("avg_ms"))).withColumn("state", S.health_status(F.col("score")))
    state = lambda s: F.count_if(F.col("state") == s)
    return scored.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("services"), state("healthy").alias("healthy"), state("degraded").alias("degraded"), state("critical").alias("critical"),
        S.scaled_round(F.avg("rate"), 6).alias("mean_error_rate"), S.scaled_round(F.avg("avg_ms"), 4).alias("mean_latency_ms"),
    )


def topology_closed(spans: DataFrame, services: list[str]) -> DataFrame:
    """Edges of the service map whose ends are both among ``services``, by tenant."""
    return service_map_edges(spans.where(F.col("service_name") != "")).where(F.col("caller").isin(services) & F.col("callee").isin(services))


def db_stats(spans: DataFrame, logs: DataFrame) -> DataFrame:
    names = spans.select("service_name").union(logs.select("service_name")).where("service_name <> ''").distinct().agg(F.count(F.lit(1)).alias("services"))
    return spans.agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("trace_id").alias("traces")).crossJoin(logs.agg(F.count(F.lit(1)).alias("logs"))).crossJoin(names)  # single rows
