"""Log filters, keyword and full-text search, context and clusters of mined lines."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .mining import OTHER
from .settle import settled

K1, B = 1.2, 0.75


def search_like(logs: DataFrame, query: str) -> DataFrame:
    """Body or trace id holds the query, in any case."""
    return logs.where(F.col("body").ilike(f"%{query}%") | F.col("trace_id").ilike(f"%{query}%"))


def filter_logs(logs: DataFrame, service: str = "", severity: str = "", trace_id: str = "", start=None, end=None) -> DataFrame:
    for name, value in (("service_name", service), ("severity", severity), ("trace_id", trace_id)):
        if value:
            logs = logs.where(F.col(name) == value)
    if start is not None:
        logs = logs.where(F.col("timestamp") >= F.lit(start))
    return logs.where(F.col("timestamp") <= F.lit(end)) if end is not None else logs


def clamp_search_window(start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """A keyword search spans 24 hours at most, the last ones of what is asked for."""
    day = timedelta(hours=24)
    end = end or (min(now, start + day) if start else now)
    if start is None or start > end or end - start > day:
        start = end - day
    return start, end


#: Accented letters and what stands for them in full-text search.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text):
    """Lower case, without accents."""
    return F.translate(F.regexp_replace(F.lower(text), "[\u0300-\u036f]", ""), ACCENTED, PLAIN)


def tokens(body):
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(folded(body), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def search_bm25(logs: DataFrame, terms: list[str]) -> DataFrame:
    """(log_id, score): logs that hold a word with each term as its prefix, by BM25 over all logs.

    The corpus is read and cut into words once; lengths and frequencies of the terms are kept
    (three numbers a log), and totals and hits both come from them.
    """
    words = logs.select("log_id", tokens(F.col("body")).alias("t"), F.array(*[folded(F.lit(t)) for t in terms]).alias("terms"))
    counts = [F.size(F.filter("t", _prefix(F.get("terms", F.lit(i))))).alias(f"tf{i}") for i in range(len(terms))]
    tf = settled(words.select("log_id", F.size("t").alias("len"), *counts))
    totals = tf.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = tf.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(totals))  # a single row
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)
    return rows.select("log_id", sum((part(i) for i in range(1, len(terms))), part(0)).alias("score"))


def _prefix(term):
    return lambda w: w.startswith(term)


def context(logs: DataFrame, at: datetime, seconds: int = 60) -> DataFrame:
    """Logs within a minute of a moment, oldest first."""
    return logs.where(F.col("timestamp").between(F.lit(at - timedelta(seconds=seconds)), F.lit(at + timedelta(seconds=seconds)))).orderBy("timestamp", "log_id")


def severity_gate(logs: DataFrame, least: str) -> DataFrame:
    floor = {"DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40, "FATAL": 50}.get(least.upper(), 20)
    return logs.where(S.severity_rank(F.col("severity")) >= floor)


def clusters(mined: DataFrame) -> DataFrame:
    """Mined log lines (tenant_id, service_name, template, rest, severity, timestamp) by template: counts, first and last, severities.

    Each template of the rest is a cluster; ``lines`` are a cluster's own, and ``n`` those of all with its ``template``, which differ for ``__other__`` alone.
    """
    keys, service = ["tenant_id", "service_name", "template", "rest"], ["tenant_id", "service_name"]
    by = mined.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    out = settled(by.groupBy(*keys).agg(
        F.sum("n").alias("lines"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("severities")
    ))
    other = F.col("template") == OTHER
    all_other = out.where(other).groupBy(*service).agg(F.sum("lines").alias("others"))
    out = out.join(all_other, service, "left").withColumn("n", F.when(other, F.coalesce("others", "lines")).otherwise(F.col("lines"))).drop("others")
    return out.withColumn("cluster_id", F.concat(F.lit("lc_"), "service_name", F.lit("_"), F.lower(F.hex(F.xxhash64("template", "rest")))))


def correlated(clusters: DataFrame, services: DataFrame, since) -> DataFrame:
    """Clusters of the services (tenant_id, service_name) that were last seen after a moment."""
    return clusters.where(F.col("last_seen") > F.lit(since)).join(services.select("tenant_id", "service_name").distinct(), ["tenant_id", "service_name"], "left_semi")


def latest(logs: DataFrame, k: int = 50) -> DataFrame:
    return logs.orderBy(F.desc("timestamp"), F.desc("log_id")).limit(k)


def first_per_slot(logs: DataFrame, error_cap: int = 50, warn_cap: int = 20) -> DataFrame:
    """Log exemplars of each tenant, service and window: the first errors and warnings up to their caps, nothing else."""
    slot = F.when(S.severity_rank(F.col("severity")) >= 40, "error").when(S.severity_rank(F.col("severity")) == 30, "warn")
    rows = logs.withColumn("slot", slot).where("slot is not null").withColumn("window", S.window_start(F.col("timestamp")))
    w = Window.partitionBy("tenant_id", "service_name", "window", "slot").orderBy("timestamp", "log_id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.when(F.col("slot") == "error", error_cap).otherwise(warn_cap)).drop("rn")
