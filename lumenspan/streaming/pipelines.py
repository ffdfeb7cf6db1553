"""Structured Streaming forms of the rollup, deduplication and edges, of built-in operators alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining
from ..operators.rollup import canonical
from ..operators.traffic import is_error
from ..schema import WINDOW


def file_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """Parquet files as a stream, so many for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def split_late(points: DataFrame, arrival: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by each point's own arrival; nothing is dropped unseen."""
    from ..operators.traffic import late_points

    rows = late_points(points, arrival)
    return rows.where("class = 'accepted'").drop("class"), rows.where("class <> 'accepted'")


def rollup(spans: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Five-minute deltas by series, final once the watermark has passed them."""
    out = spans.withWatermark("start_time", lateness).groupBy(F.window("start_time", WINDOW), "tenant_id", "service_name", "operation_name")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.sum("duration_us").alias("duration_sum"), F.min("duration_us").alias("duration_min"), F.max("duration_us").alias("duration_max"))
    return out.select(F.col("window.start").alias("window"), "tenant_id", "service_name", "operation_name", "n", "errors", "duration_sum", "duration_min", "duration_max")


def dedup(spans: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first of each (tenant, trace, span) within the watermark."""
    return spans.withWatermark("start_time", lateness).dropDuplicatesWithinWatermark(["tenant_id", "trace_id", "span_id"])


def edges(spans: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Calls by a stream-stream join of children with parents that start within the lateness of them, in whatever order they come.

    Of a span id that comes again the first within the watermark is a parent. For calls whose parent must have come
    before, see ``stateful.seen_calls``.
    """
    child = spans.where("service_name <> '' and parent_span_id <> '' and parent_span_id <> '0000000000000000'").withWatermark("start_time", lateness)
    parent = spans.where("service_name <> ''").select("tenant_id", "trace_id", F.col("span_id").alias("parent"), F.col("service_name").alias("caller"), F.col("start_time").alias("parent_start"))
    parent = parent.withWatermark("parent_start", lateness).dropDuplicatesWithinWatermark(["tenant_id", "trace_id", "parent"])
    near = (F.col("start_time") >= F.col("parent_start") - F.expr(f"INTERVAL {lateness}")) & (F.col("start_time") <= F.col("parent_start") + F.expr(f"INTERVAL {lateness}"))
    same = (child["tenant_id"] == parent["tenant_id"]) & (child["trace_id"] == parent["trace_id"]) & (F.col("parent_span_id") == F.col("parent"))
    return child.join(parent, same & near).where("caller <> service_name").select("caller", F.col("service_name").alias("callee"), "start_time", "duration_us", "status")


def metric_buckets(points: DataFrame, lateness: str = "10 minutes", seconds: int = 30) -> DataFrame:
    """Buckets of (tenant, service, name, attributes) as ``rollup.tsdb_buckets`` has them without caps, each once the watermark has passed it."""
    rows = points.withColumn("attributes", canonical(F.col("attributes"))).withWatermark("timestamp", lateness)
    out = rows.groupBy(F.window("timestamp", f"{seconds} seconds"), "tenant_id", "service_name", "name", "attributes").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")
    )
    return out.select(F.col("window.start").alias("window"), "tenant_id", "service_name", "name", "attributes", "min", "max", "sum", "count")


def template_facts(path: str, scope: list[str] = mining.SERVICE, most: int | None = None):
    """A sink for ``foreachBatch`` of logs: each batch is mined on from the templates of those before, and its facts are appended.

    Below ``path``: ``facts/batch=N`` (tenant_id, service_name, severity, template, n, first_seen, last_seen) and ``state/batch=N``,
    what mining goes on from. A batch that runs again starts from the same state and overwrites its own folders.
    """

    def sink(logs: DataFrame, batch: int) -> None:
        logs = logs.where("service_name <> ''").persist()
        try:
            before = _newest_state(logs.sparkSession, path, batch)
            old = None if before is None else mining.load(logs.sparkSession, f"{path}/state/batch={before}", scope)
            mined = mining.mine(logs, scope, most, old)
            named = mined.lines.join(mining.texts(mined, scope), [*scope, "made_at", "made_log"]).select(*scope, "line", "template")
            facts = logs.withColumn("line", mining.line_key(F.col("body"))).join(named, [*scope, "line"])
            facts = facts.groupBy("tenant_id", "service_name", "severity", "template").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
            facts.write.mode("overwrite").parquet(f"{path}/facts/batch={batch}")
            mining.save(mined, f"{path}/state/batch={batch}", scope)
        finally:
            logs.unpersist()

    return sink


def _newest_state(spark: SparkSession, path: str, before: int) -> int | None:
    """The last batch before this one whose state stands."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    numbers = [int(s.getPath().getName().partition("=")[2]) for s in system.listStatus(folder) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "nodes/_SUCCESS"))]
    return max((n for n in numbers if n < before), default=None)
