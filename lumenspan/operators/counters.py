"""Cumulative counters to increments, with reset detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 600


def deltas(points: DataFrame, series: list[str], arrival: list[str] | None = None) -> DataFrame:
    """Adds ``delta`` and ``event`` to cumulative points (start_ts, timestamp, value).

    In order: stale or duplicate points (no newer than the newest before them by arrival) are
    ignored; the first point seeds with 0; a gap of more than ten minutes seeds anew; a new
    start, or a smaller value, is a reset and counts whole; else the difference counts.
    """
    came = Window.partitionBy(*series).orderBy(*(arrival or ["timestamp", "seq"]))
    newest = F.max("timestamp").over(came.rowsBetween(Window.unboundedPreceding, -1))
    fresh = points.withColumn("__newest", newest).where(F.col("__newest").isNull() | (F.col("timestamp") > F.col("__newest"))).drop("__newest")
    w = Window.partitionBy(*series).orderBy("timestamp")
    old_ts, old_start, old = (F.lag(c).over(w) for c in ("timestamp", "start_ts", "value"))
    rows = fresh.withColumns({"__ts": old_ts, "__start": old_start, "__value": old})
    gap = F.unix_micros("timestamp") - F.unix_micros("__ts") > GAP_SECONDS * 1_000_000
    reset = (F.col("start_ts") != F.col("__start")) | (F.col("value") < F.col("__value"))
    event = F.when(F.col("__ts").isNull(), "seed").when(gap, "gap").when(reset, "reset").otherwise("normal")
    zero = F.lit(0).cast(dict(points.dtypes)["value"])
    rows = rows.withColumn("event", event)
    delta = F.when(F.col("event").isin("seed", "gap"), zero).when(F.col("event") == "reset", F.col("value")).otherwise(F.col("value") - F.col("__value"))
    return rows.withColumn("delta", delta).drop("__ts", "__start", "__value")
