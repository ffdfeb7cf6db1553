"""Anomalies of windows against the final windows before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

SERVICE = ["tenant_id", "service"]
#: Guards of the detectors.
MIN_REQUESTS, MIN_BASE_REQUESTS, MIN_BASE_WINDOWS, MIN_ELAPSED, SIGMA = 20, 100, 2, 0.25, 3.0


def _latest(windows: DataFrame) -> DataFrame:
    """The most recent window of each tenant's service that is closed, or far enough open, with enough requests."""
    ok = (F.col("n") >= MIN_REQUESTS) & (F.col("closed") | (F.col("elapsed_s") >= MIN_ELAPSED * 300))
    w = Window.partitionBy(*SERVICE).orderBy(F.desc("start"))
    return windows.where(ok).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def error_spikes(windows: DataFrame) -> DataFrame:
    """Rate over the pooled earlier rate by three standard errors; ``windows``: (tenant_id, service, start, closed, final, elapsed_s, n, errors)."""
    now = _latest(windows).select(*SERVICE, F.col("start").alias("moment"), F.col("n").alias("now_n"), F.col("errors").alias("now_errors"))
    base = windows.where("final").join(now, SERVICE).where("start < moment").groupBy(*SERVICE, "moment", "now_n", "now_errors").agg(F.count(F.lit(1)).alias("base_windows"), F.sum("n").alias("base_n"), F.sum("errors").alias("base_errors"))
    rated = base.where((F.col("base_windows") >= MIN_BASE_WINDOWS) & (F.col("base_n") >= MIN_BASE_REQUESTS)).withColumns({"rate": F.col("now_errors") / F.col("now_n"), "p": F.col("base_errors") / F.col("base_n")})
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("now_n"))
    fires = (F.col("rate") > F.col("p")) & F.when(spread > 0, F.col("rate") >= F.col("p") + SIGMA * spread).otherwise(F.col("now_errors") > 0)
    return rated.where(fires).select(*SERVICE, "moment", "rate", "p", "base_windows", S.relative_severity(F.col("rate"), F.col("p")).alias("severity"))


def latency_spikes(windows: DataFrame) -> DataFrame:
    """p99 over mean and three population deviations of earlier p99s, twice the mean where they have no spread."""
    now = _latest(windows).where("p99_us > 0").select(*SERVICE, F.col("start").alias("moment"), F.col("p99_us").alias("now_p99"))
    base = windows.where(F.col("final") & (F.col("p99_us") > 0) & (F.col("n") >= MIN_REQUESTS)).join(now, SERVICE).where("start < moment")
    base = base.groupBy(*SERVICE, "moment", "now_p99").agg(F.count(F.lit(1)).alias("base_windows"), F.avg("p99_us").alias("mean"), F.stddev_pop("p99_us").alias("sd"))
    limit = F.when(F.col("sd") == 0, F.col("mean") * 2).otherwise(F.col("mean") + SIGMA * F.col("sd"))
    return base.where((F.col("base_windows") >= MIN_BASE_WINDOWS) & (F.col("now_p99") > limit) & (F.col("mean") > 0)).select(
        *SERVICE, "moment", "now_p99", "mean", "sd", "base_windows", S.relative_severity(F.col("now_p99"), F.col("mean")).alias("severity")
    )


def metric_zscores(windows: DataFrame, keys: list[str]) -> DataFrame:
    """z of each window's mean against all earlier windows of its series; ``windows``: (keys, start, mean)."""
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = windows.withColumns({"base": F.avg("mean").over(w), "sd": F.stddev_pop("mean").over(w), "prior": F.count("mean").over(w)})
    scored = rows.where((F.col("prior") >= MIN_BASE_WINDOWS) & (F.col("sd") > 0)).withColumn("z", (F.col("mean") - F.col("base")) / F.col("sd"))
    return scored.where(F.abs("z") >= SIGMA)


def preceded_by(anomalies: DataFrame, seconds: int = 30) -> DataFrame:
    """Pairs of anomalies of one tenant less than ``seconds`` apart; ``anomalies``: (tenant_id, id, at).

    A range join on buckets of the reach: each left row meets its own bucket and its two
    neighbours, so that equal keys, not all pairs, are compared.
    """
    bucket = F.floor(F.unix_micros("moment") / (seconds * 1_000_000))
    a = anomalies.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = anomalies.select("tenant_id", F.col("id").alias("other"), F.col("moment").alias("other_moment"), bucket.alias("bucket"))
    apart = F.abs(F.unix_micros("other_moment") - F.unix_micros("moment"))
    return a.join(b, ["tenant_id", "bucket"]).where((F.col("id") != F.col("other")) & (apart < seconds * 1_000_000)).drop("bucket")


def ticks(anomalies: DataFrame, seconds: int = 1800) -> DataFrame:
    """Worst severity, count and newest of each service and half hour; ``anomalies``: (service, severity, at)."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    out = anomalies.groupBy("service", S.window_start(F.col("moment"), seconds).alias("tick")).agg(F.max_by("severity", rank).alias("severity"), F.count(F.lit(1)).alias("n"), F.max("moment").alias("newest"))
    return out


def raw_thresholds(nodes: DataFrame) -> DataFrame:
    """The raw path's detector over (tenant_id, service_name, spans, errors, avg_ms): error rate over 5 %, or mean over 500 ms with more than 10 calls."""
    rate = F.col("errors") / F.col("spans")
    error = nodes.where(rate > 0.05).select("tenant_id", "service_name", F.lit("error_spike").alias("type"), S.error_severity(rate).alias("severity"))
    slow = nodes.where((F.col("avg_ms") > 500) & (F.col("spans") > 10)).select("tenant_id", "service_name", F.lit("latency_spike").alias("type"), S.latency_severity(F.col("avg_ms")).alias("severity"))
    return error.unionByName(slow)


def upsert(anomalies: DataFrame) -> DataFrame:
    """The newest anomaly of each (service, type)."""
    newest = F.max_by(F.struct(*[c for c in anomalies.columns if c not in ("service", "type")]), "moment").alias("x")
    return anomalies.groupBy("service", "type").agg(newest).select("service", "type", "x.*")
