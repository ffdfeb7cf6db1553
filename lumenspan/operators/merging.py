"""What merges whatever the order: gauges, histograms, totals by signal; nodes, pages, marks and rings over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .traffic import is_error

DIMENSIONS = ("window", "signal", "service_name", "name")


def merge_gauges(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Gauge deltas (n, sum, min, max, last, last_time) merged; those without a point change nothing.

    Of two last points at one moment the larger value stays, so the order of merging is of no account.
    """
    some = lambda c: F.when(F.col("n") > 0, F.col(c))
    last = F.max(F.when(F.col("n") > 0, F.struct("last_time", "last")))
    return deltas.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(some("sum")).alias("sum"), F.min(some("min")).alias("min"), F.max(some("max")).alias("max"), last["last"].alias("last"), last["last_time"].alias("last_time")
    )


def merge_histograms(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram deltas (n, sum, min, max, tail_count, tail_bound, source_error, flags, reason) merged.

    Null extremes and bounds are those that a delta doesn't have. The lowest bound of the tails is the
    one that holds for all of them. Flags unite. ``reason`` says why percentiles can't be given: the
    smallest one that isn't zero stands, and one such delta leaves the whole without percentiles.
    """
    reason = F.coalesce(F.min(F.when(F.col("reason") > 0, F.col("reason"))), F.lit(0)).cast("int")
    out = deltas.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("tail_count").alias("tail_count"),
        F.min("tail_bound").alias("tail_bound"), F.max("source_error").alias("source_error"), F.bit_or("flags").alias("flags"), reason.alias("reason"),
    )
    return out.withColumn("percentiles", (F.col("n") > 0) & (F.col("reason") == 0))


def sum_signals(deltas: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Counts and errors of several signals' deltas (window, service_name, name, n, errors) by any of window, signal, service_name and name.

    Dimensions that are not asked for are null; none at all gives one row.
    """
    rows = reduce(DataFrame.unionByName, [df.select("window", F.lit(signal).alias("signal"), "service_name", "name", "n", "errors") for signal, df in deltas.items()])
    out = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return out.select(*[F.col(c) if c in by else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in DIMENSIONS], "n", "errors")


def service_nodes(spans: DataFrame, seconds: float, samples: int = 1000) -> DataFrame:
    """Each service with rate, mean, health and alerts; its p99 is of its first ``samples`` spans.

    Only those are ranked: Spark keeps no more of a service in each task before the shuffle.
    """
    keys, ms = ["tenant_id", "service_name"], F.col("duration_us") / 1000
    counts = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("errors"), F.avg(ms).alias("avg_ms"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen"))
    first = spans.select(*keys, "duration_us", F.row_number().over(Window.partitionBy(*keys).orderBy("start_time", "span_id")).alias("place")).where(F.col("place") <= samples)
    p99 = first.groupBy(*keys).agg((F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_us)") / 1000).alias("p99_ms"))
    rate = F.col("errors") / F.col("spans")
    score = S.health_score(rate, F.col("avg_ms"))
    return counts.join(p99, keys).withColumns({"rps": F.col("spans") / seconds, "error_rate": rate, "score": score, "state": S.health_status(score), "alerts": S.alerts(rate, F.col("p99_ms"))})


def counted_page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows with ``total``, how many there are in all. Limits are held within 1 and 1000, offsets at 0 or more."""
    page = rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # a single row


def read_above(rows: DataFrame, mark: tuple | None, order: list[str], most: int = 50_000) -> DataFrame:
    """The next ``most`` rows above a mark (the last row's values of ``order``, or None), oldest first.

    Nothing is read twice: the next mark is the last row's. The first column also prunes the scan.
    """
    if mark is not None:
        rows = rows.where(F.col(order[0]) >= F.lit(mark[0])).where(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, mark)]))
    return rows.orderBy(*order).limit(most)


def ring_slots(windows: DataFrame, keys: list[str], seconds: int = 30, slots: int = 120) -> DataFrame:
    """Windows in the last ``slots`` of each series, counted back from its newest one."""
    newest = windows.groupBy(*keys).agg(F.max("window").alias("newest"))
    age = F.unix_micros("newest") - F.unix_micros("window")
    return windows.join(newest, keys).where(age < slots * seconds * 1_000_000).drop("newest")


def ranked_by_window(series: DataFrame, scope: list[str], most: int) -> DataFrame:
    """Series (window, first_seen, ...) with whether they are within a budget that a window's end gives back: each window counts anew."""
    w = Window.partitionBy("window", *scope).orderBy("first_seen", "name")
    kept = series.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("window", *scope, "name", F.lit(True).alias("kept"))
    return series.join(kept, ["window", *scope, "name"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
