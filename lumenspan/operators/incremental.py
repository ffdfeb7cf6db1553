"""The service graph kept up to date: spans above a mark are folded into stored nodes and edges, none twice.

Folders below ``path``: ``nodes`` and ``edges``, each by ``revision``, and ``marks``, a row for each revision with the last
span that it holds. A revision counts once its mark stands; writing it again changes nothing.
Of a span id that comes twice in a trace the first one read is the parent that its children have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .settle import settled
from .traffic import is_error

MARK = "number long, start_time timestamp, span_id string, tenant_id string"
_ORDER = ["start_time", "tenant_id", "span_id"]
_TRACE = ["tenant_id", "trace_id"]
#: What a graph needs of a span.
SPAN = [*_TRACE, "span_id", "parent_span_id", "service_name", "operation_name", "status", "duration_us", "start_time"]
NODE, EDGE = ["tenant_id", "service_name", "operation_name"], ["tenant_id", "caller", "callee"]


def _measures() -> list:
    return [F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors"), F.sum("duration_us").alias("duration_sum"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen")]


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "errors", "duration_sum")], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def edge_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges that ``new`` spans add to those of ``old`` ones: new children of any parent, and old children whose parent has only now come."""
    touched = new.select(*_TRACE).distinct()  # only traces that go on are read of the old spans
    columns = [*_TRACE, "span_id", "parent_span_id", "service_name", "status", "duration_us", "start_time"]
    old = settled(old.where("service_name <> ''").join(touched, _TRACE, "left_semi").select(*columns))
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.where("service_name <> ''").select(*columns).withColumn("is_new", F.lit(True)))
    # an owner that was known stays; all children of one that has only now come are new calls
    owner = both.groupBy(*_TRACE, F.col("span_id").alias("parent_span_id")).agg(F.min(F.when(~F.col("is_new"), F.col("service_name"))).alias("known"), F.min("service_name").alias("first"))
    child = both.where("parent_span_id <> '' and parent_span_id <> '0000000000000000'").drop("span_id")
    calls = child.join(owner, [*_TRACE, "parent_span_id"]).where(F.col("is_new") | F.col("known").isNull()).withColumn("caller", F.coalesce("known", "first"))
    return calls.where("caller <> service_name").withColumnRenamed("service_name", "callee").groupBy(*EDGE).agg(*_measures())


def last_mark(spark: SparkSession, path: str):
    """The newest mark, or None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MARK).parquet(f"{path}/marks").orderBy(F.desc("number")).first()


def graph(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``nodes`` or ``edges`` as of the newest mark."""
    return spark.read.parquet(f"{path}/{name}/revision={last_mark(spark, path)['number']}")


def advance(spans: DataFrame, path: str, upto=None, edge_ttl=None, idle_ttl=None) -> int:
    """Fold the spans above the mark (and not after ``upto``) into the stored graph; the revision that stands then.

    The mark is the last span in the order of (start_time, tenant, span). With ``edge_ttl`` (seconds) nodes and edges go that
    were last seen so long before it, and with ``idle_ttl`` all of a tenant (but ``default``) of which nothing was seen since.
    The new spans are written out once, as five steps use them; the old ones are read once. What makes ``spans`` runs twice.
    """
    spark, mark = spans.sparkSession, last_mark(spans.sparkSession, path)
    place = F.struct(*_ORDER)
    rows = spans if upto is None else spans.where(F.col("start_time") <= F.lit(upto))
    if mark is None:
        old, new = rows.where(F.lit(False)), rows
    else:
        at = F.struct(*[F.lit(mark[c]).alias(c) for c in _ORDER])
        old, new = rows.where(F.col("start_time") <= F.lit(mark["start_time"])).where(place <= at), rows.where(F.col("start_time") >= F.lit(mark["start_time"])).where(place > at)
    new = settled(new.select(*SPAN))
    last = new.agg(F.max(place).alias("m")).first()["m"]
    if last is None:
        return mark["number"] if mark else 0
    revision = (mark["number"] if mark else 0) + 1
    nodes, edges = new.where("service_name <> ''").groupBy(*NODE).agg(*_measures()), edge_deltas(old, new)
    for name, keys, delta in (("nodes", NODE, nodes), ("edges", EDGE, edges)):
        merged = delta if mark is None else _merged(graph(spark, path, name).select(delta.columns).unionByName(delta), keys)
        kept = _lasting(merged, last["start_time"], edge_ttl, idle_ttl)
        kept.write.mode("overwrite").parquet(f"{path}/{name}/revision={revision}")
    spark.createDataFrame([(revision, last["start_time"], last["span_id"], last["tenant_id"])], MARK).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/revision={revision}")
    return revision


def _lasting(rows: DataFrame, now, edge_ttl, idle_ttl) -> DataFrame:
    age = F.unix_micros(F.lit(now)) - F.unix_micros("last_seen")
    if idle_ttl is not None:
        seen = rows.groupBy("tenant_id").agg(F.max("last_seen").alias("last_seen")).where((age < idle_ttl * 1_000_000) | (F.col("tenant_id") == "default"))
        rows = rows.join(seen.select("tenant_id"), "tenant_id", "left_semi")
    return rows if edge_ttl is None else rows.where(age < edge_ttl * 1_000_000)
