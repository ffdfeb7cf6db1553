"""The newest windows of each tenant's services, operations, edges and metrics: folded, bounded by a horizon and caps, and as nodes.

One table holds all four levels: ``a`` is the service (of an edge: the caller) and ``b`` the operation, the callee or the
metric; a service has none. Empty names and edges onto the same service are no entities. Only services have quantiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sketch
from ..schema import LATENESS_SECONDS, WINDOW_SECONDS
from .traffic import is_error

ENTITY = ["level", "tenant_id", "a", "b"]
#: Entities that a tenant keeps (operations: a service), and seconds of history.
CAPS = {"service": 512, "operation": 64, "edge": 4096, "metric": 4096}
HORIZON_SECONDS = 1800

_SUMS, _LEAST, _MOST = ("n", "errors", "durations", "duration_sum", "samples", "value_sum"), ("duration_min", "value_min", "first_seen"), ("duration_max", "value_max", "last_seen")


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in _LEAST], *[F.max(c).alias(c) for c in _MOST])


def _folded(rows: DataFrame, level: str, a: str, b: str, at: str, duration: Column, value: Column, failed: Column) -> DataFrame:
    flat = rows.select(
        F.lit(level).alias("level"), "tenant_id", F.col(a).alias("a"), F.col(b).alias("b"), S.window_start(F.col(at)).alias("window"), F.lit(1).alias("n"), failed.cast("int").alias("errors"),
        duration.isNotNull().cast("int").alias("durations"), duration.alias("duration_sum"), value.isNotNull().cast("int").alias("samples"), value.alias("value_sum"),
        duration.alias("duration_min"), value.alias("value_min"), F.col(at).alias("first_seen"), duration.alias("duration_max"), value.alias("value_max"), F.col(at).alias("last_seen"),
    )
    return _merged(flat, [*ENTITY, "window"])


def fold(spans: DataFrame, calls: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """(level, tenant_id, a, b, window, measures) of spans, of ``calls`` (see ``traffic.calls``) and of metric ``points``.

    Services are sums of their folded operations, so a span is counted once and shuffled once.
    """
    none, long_none = F.lit(None).cast("double"), F.lit(None).cast("long")
    operations = _folded(spans.where("service_name <> ''"), "operation", "service_name", "operation_name", "start_time", F.col("duration_us").cast("long"), none, F.coalesce(is_error(), F.lit(False)))
    services = _merged(operations.withColumns({"level": F.lit("service"), "b": F.lit(None).cast("string")}), [*ENTITY, "window"])
    parts = [services, operations.where("b <> ''")]
    if calls is not None:
        real = calls.where("caller <> '' and callee <> '' and caller <> callee")
        parts.append(_folded(real, "edge", "caller", "callee", "start_time", F.col("duration_us").cast("long"), none, F.coalesce(is_error(), F.lit(False))))
    if points is not None:
        parts.append(_folded(points.where("service_name <> '' and name <> ''"), "metric", "service_name", "name", "timestamp", long_none, F.col("value").cast("double"), F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def service_quantiles(spans: DataFrame) -> DataFrame:
    """(tenant_id, a, window, p95_us, p99_us) of each service's windows, from the mergeable sketch."""
    keys = ["tenant_id", "a", "window"]
    rows = spans.where("service_name <> ''").select("tenant_id", F.col("service_name").alias("a"), S.window_start(F.col("start_time")).alias("window"), "duration_us")
    q = sketch.quantiles(sketch.build(rows, keys, "duration_us"), keys, [0.95, 0.99])
    at = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    return q.groupBy(*keys).agg(at(0.95).alias("p95_us"), at(0.99).alias("p99_us"))


def retained(windows: DataFrame, now, seconds: int = HORIZON_SECONDS) -> DataFrame:
    """Windows from the cutoff on: the window that holds the horizon's start, less a window and the lateness that is allowed.

    An entity without a window is gone.
    """
    start = S.window_start(F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - seconds * 1_000_000))
    return windows.where(F.unix_micros("window") >= F.unix_micros(start) - (WINDOW_SECONDS + LATENESS_SECONDS) * 1_000_000)


def capped(windows: DataFrame, caps: dict[str, int] = CAPS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): windows of the entities within the caps, and (level, tenant_id, dropped) how many are beyond them.

    Those seen first stay, ties by name. Distinct entities are ranked, and Spark keeps no more of a scope in a task than
    its cap before the shuffle, so the rest is found by comparing with the last one that stays.
    """
    order = F.struct("first_seen", "a", F.coalesce("b", F.lit("")).alias("b"))
    entities = windows.groupBy(*ENTITY).agg(F.min("first_seen").alias("first_seen")).withColumn("scope", F.when(F.col("level") == "operation", F.col("a")).otherwise("")).withColumn("place", order)
    scope = ["level", "tenant_id", "scope"]
    lasts = []
    for level, most in caps.items():
        top = entities.where(F.col("level") == level).withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("place"))).where(F.col("rank") <= most)
        lasts.append(top.groupBy(*scope).agg(F.max("place").alias("last")))
    judged = entities.join(reduce(DataFrame.unionByName, lasts), scope, "left").withColumn("kept", F.coalesce(F.col("place") <= F.col("last"), ~F.col("level").isin(*caps)))
    kept = judged.where("kept").select(*ENTITY)
    same = reduce(lambda x, y: x & y, [windows[c].eqNullSafe(kept[c]) for c in ENTITY])
    dropped = judged.groupBy("level", "tenant_id").agg(F.count_if(~F.col("kept")).alias("dropped"))
    return windows.join(kept, same, "left_semi"), dropped


def nodes(windows: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """Each entity over all its windows: calls, rates, mean, health, rolling extremes and mean of values.

    Quantiles don't sum: a service shows those of its newest window that has any.
    """
    if quantiles is not None:
        known = quantiles.withColumn("level", F.lit("service"))
        windows = windows.join(known, ["level", "tenant_id", "a", "window"], "left")
    else:
        windows = windows.withColumns({"p95_us": F.lit(None).cast("double"), "p99_us": F.lit(None).cast("double")})
    newest = lambda c: F.max_by(c, F.when(F.col(c) > 0, F.col("window")))
    out = windows.groupBy(*ENTITY).agg(
        *[F.sum(c).alias(c) for c in ("n", "errors", "durations", "duration_sum", "samples", "value_sum")], F.min("value_min").alias("rolling_min"), F.max("value_max").alias("rolling_max"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), (newest("p95_us") / 1000).alias("p95_ms"), (newest("p99_us") / 1000).alias("p99_ms"),
    )
    timed, rate = F.col("level") != "metric", F.col("errors") / F.col("n")
    mean = F.coalesce(F.col("duration_sum") / F.nullif("durations", F.lit(0)) / 1000, F.lit(0.0))
    return out.select(
        *ENTITY, F.when(F.col("level") == "service", F.col("a")).when(F.col("level") == "metric", F.concat_ws("|", "b", "a")).otherwise(F.concat_ws("|", "a", "b")).alias("id"),
        F.when(timed, F.col("n")).alias("calls"), F.when(timed, F.col("errors")).alias("errors"), F.when(timed, rate).alias("error_rate"), F.when(timed, F.coalesce(F.col("duration_sum"), F.lit(0)) / 1000).alias("total_ms"),
        F.when(timed, mean).alias("avg_ms"), F.when(F.col("level").isin("service", "operation"), S.health_score(rate, mean)).alias("health"), "p95_ms", "p99_ms",
        F.when(~timed, F.col("samples")).alias("samples"), "rolling_min", "rolling_max", F.when(F.col("samples") > 0, F.col("value_sum") / F.col("samples")).alias("rolling_avg"), "first_seen", "last_seen",
    )
