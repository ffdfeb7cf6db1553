"""Exemplars, adaptive sampling and cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .traffic import is_error

PER_STRATUM, PER_SERVICE, PER_WINDOW = 5, 25, 1500


def select_exemplars(spans: DataFrame, slow_us: int = 500_000, healthy_rate: float = 0.1) -> DataFrame:
    """Bounded traces of each window, by class error, slow, healthy, then by hash of the trace id.

    A trace is ranked by its best class. Ranks narrow from (service, operation, class) to
    service to window, each over what the one before kept, so the last is over few rows.
    """
    grade = F.when(is_error(), 0).when(F.col("duration_us") >= slow_us, 1).otherwise(2)
    key = F.md5(F.col("trace_id"))
    rows = spans.select(S.window_start(F.col("start_time")).alias("window"), "tenant_id", "service_name", "operation_name", "trace_id", grade.alias("class"))
    best = rows.groupBy("window", "tenant_id", "service_name", "trace_id").agg(F.min("class").alias("class"), F.min_by("operation_name", F.struct("class", "operation_name")).alias("operation_name"))
    best = best.withColumn("hash", key)
    # the first eight hexadecimal digits as a share of their range
    share = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / 4294967296.0
    best = best.where((F.col("class") < 2) | (share < healthy_rate))
    keep = lambda df, by, order, n: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n).drop("rn")
    out = keep(best, ["window", "tenant_id", "service_name", "operation_name", "class"], ["hash", "trace_id"], PER_STRATUM)
    out = keep(out, ["window", "tenant_id", "service_name"], ["class", "hash", "trace_id"], PER_SERVICE)
    return keep(out, ["window", "tenant_id"], ["class", "hash", "trace_id", "service_name"], PER_WINDOW)


def adaptive_sample(spans: DataFrame, rate: float = 0.05, slow_us: int = 500_000) -> DataFrame:
    """(tenant_id, service_name, span_id) of the spans that are kept.

    Errors and slow spans always are. Of a service's other spans the first is, and each later one if
    its token bucket holds a token: ``rate`` tokens a second flow in, up to max(1, 1/rate), which a
    new bucket holds. Rates of 1 and more keep all, of 0 and less none of these. Each service's
    spans stream through one task in order of time; only its bucket is held.
    """
    always = is_error() | (F.col("duration_us") >= slow_us) | F.lit(rate >= 1)
    rows = spans.select("tenant_id", "service_name", "span_id", "start_time", F.unix_micros("start_time").alias("micros"), always.alias("always"))
    keys = ["tenant_id", "service_name", "span_id"]
    if rate <= 0 or rate >= 1:
        return rows.where("always").select(*keys)
    most = max(1.0, 1.0 / rate)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, left, last = None, most, None
        for pdf in batches:
            kept = []
            for tenant, name, micros, sure in zip(pdf["tenant_id"], pdf["service_name"], pdf["micros"], pdf["always"]):
                if (tenant, name) != service:
                    service, last = (tenant, name), None
                if sure:
                    kept.append(True)
                elif last is None:
                    left, last = most, micros
                    kept.append(True)
                else:
                    left, last = min(most, left + (micros - last) / 1e6 * rate), micros
                    kept.append(left >= 1)
                    left -= kept[-1]
            yield pdf.loc[kept, keys]

    dealt = rows.repartition("tenant_id", "service_name").sortWithinPartitions("tenant_id", "service_name", "start_time", "span_id")
    return dealt.mapInPandas(fold, "tenant_id string, service_name string, span_id string")


def cooldown(events: DataFrame, keys: list[str], seconds: int = 300) -> DataFrame:
    """Of each key's events the first, then each one that is ``seconds`` after the last kept.

    Events stream through in order of time; of each key only the last moment kept is held.
    """
    rows = events.select(*keys, F.unix_micros("moment").alias("micros"))
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for pdf in batches:
            kept = []
            for *now, micros in pdf.itertuples(index=False, name=None):
                kept.append(now != key or micros - last >= seconds * 1_000_000)
                if kept[-1]:
                    key, last = now, micros
            yield pdf[kept]

    kept = rows.repartition(*keys).sortWithinPartitions(*keys, "micros").mapInPandas(fold, schema)
    return kept.select(*keys, F.timestamp_micros("micros").alias("moment"))


#: Logs made from spans that a span and a trace keep.
PER_SPAN_LOGS, PER_TRACE_LOGS = 8, 64


def capped_logs(logs: DataFrame, order: list[str], per_span: int = PER_SPAN_LOGS, per_trace: int = PER_TRACE_LOGS) -> DataFrame:
    """``logs`` (tenant_id, trace_id, span_id, ...) with ``dropped``: null if kept, else the cap (``span``, ``trace``) that a log is beyond.

    The first logs by ``order`` stay; what a span's cap drops takes no place of its trace's.
    """
    of_span = F.row_number().over(Window.partitionBy("tenant_id", "trace_id", "span_id").orderBy(*order))
    rows = logs.withColumn("over", of_span > per_span)
    of_trace = F.sum(F.when(F.col("over"), 0).otherwise(1)).over(Window.partitionBy("tenant_id", "trace_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("taken", of_trace)
    full = F.col("taken") - F.when(F.col("over"), 0).otherwise(1) >= per_trace  # before this log
    return rows.withColumn("dropped", F.when(full, "trace").when(F.col("over"), "span")).drop("over", "taken")


def truncation(marked: DataFrame) -> DataFrame:
    """(tenant_id, trace_id, kept, dropped_by_span, dropped_by_trace, truncated) of what ``capped_logs`` marked."""
    n = lambda c: F.count_if(c)
    return marked.groupBy("tenant_id", "trace_id").agg(
        n(F.col("dropped").isNull()).alias("kept"), n(F.col("dropped") == "span").alias("dropped_by_span"), n(F.col("dropped") == "trace").alias("dropped_by_trace"), F.max(F.col("dropped").isNotNull()).alias("truncated")
    )


def capped_bytes(spans: DataFrame, size: str, most: int) -> DataFrame:
    """Spans of a trace while their running size stays within a cap, in order of time."""
    w = Window.partitionBy("tenant_id", "trace_id").orderBy("start_time", "span_id").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most).drop("running")


#: Bytes that a retained trace, and a service's window, may hand on.
TRACE_BYTES, SERVICE_WINDOW_BYTES = 256 * 1024, 512 * 1024


def reserve_spans(spans: DataFrame, size: str, per_trace: int = TRACE_BYTES, per_service: int = SERVICE_WINDOW_BYTES, seconds: int = 300) -> DataFrame:
    """(tenant_id, service_name, window, trace_id, span_id, retained) of the spans of selected traces.

    In order of (start_time, span_id) a span is retained if its trace and its service's window have room for it; one that
    hasn't takes none, so a smaller one may follow. A window's spans stream through one task, which holds a number for each
    selected trace of it, and those are budgeted.
    """
    keys = ["tenant_id", "service_name", "window"]
    rows = spans.withColumn("window", S.window_start(F.col("start_time"), seconds)).select(*keys, "start_time", "span_id", "trace_id", F.col(size).cast("long").alias("size"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, traces = None, 0, {}
        for pdf in batches:
            kept = []
            for *now, trace, n in pdf[[*keys, "trace_id", "size"]].itertuples(index=False, name=None):
                if now != key:
                    key, used, traces = now, 0, {}
                fits = used + n <= per_service and traces.get(trace, 0) + n <= per_trace
                if fits:
                    used += n
                    traces[trace] = traces.get(trace, 0) + n
                kept.append(fits)
            yield pdf[[*keys, "trace_id", "span_id"]].assign(retained=kept)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "start_time", "span_id")
    return dealt.mapInPandas(fold, "tenant_id string, service_name string, window timestamp, trace_id string, span_id string, retained boolean")


def trace_stats(reserved: DataFrame) -> DataFrame:
    """(tenant_id, service_name, window, trace_id, observed, retained, truncated) of what ``reserve_spans`` judged."""
    return reserved.groupBy("tenant_id", "service_name", "window", "trace_id").agg(F.count(F.lit(1)).alias("observed"), F.count_if("retained").alias("retained"), F.max(~F.col("retained")).alias("truncated"))
