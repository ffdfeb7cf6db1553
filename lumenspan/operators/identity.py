"""Identity: aliases, unreferenced series, overlong names, keep-first, paging, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .settle import settled
from .traffic import is_error


def unreferenced(candidates: DataFrame, keys: list[str], *users: DataFrame) -> DataFrame:
    """Candidates that none of the tables refers to: a chain of anti joins."""
    for user in users:
        candidates = candidates.join(user.select(*keys).distinct(), keys, "left_anti")
    return candidates


def resolve_aliases(templates: DataFrame) -> DataFrame:
    """(id, final) of templates (id, alias_of): each alias followed to its end, whatever the chain's length.

    Steps double, so a chain of n links takes log2(n) rounds. A link to an id that isn't there ends the walk at it; a ring,
    and what leads into it, is resolved to the ring's smallest id.
    """
    out = settled(templates.select("id", F.coalesce("alias_of", "id").alias("final"), F.least("id", F.coalesce("alias_of", "id")).alias("low")))
    reach, most = 1, out.count()
    while True:
        onto = out.select(F.col("id").alias("final"), F.col("final").alias("next"), F.col("low").alias("further"))
        both = settled(out.join(onto, "final", "left"))
        moves = both.where(F.col("next") != F.col("final"))
        if moves.isEmpty():
            return out.select("id", "final")
        if reach > most:  # longer than any chain without a ring
            ring = both.withColumn("ring", F.coalesce(F.col("next") != F.col("final"), F.lit(False)))
            return ring.select("id", F.when(F.col("ring"), F.col("further")).otherwise(F.col("final")).alias("final"))
        out = both.select("id", F.coalesce("next", "final").alias("final"), F.least("low", "further").alias("low"))
        reach *= 2


def sweep(identities: DataFrame, *references: DataFrame) -> DataFrame:
    """Identities (id, alias_of) that nothing refers to, be it over any number of aliases.

    ``references`` (id) mark what they name; what is marked marks the identity that it is an alias of, until nothing new is marked. Each
    round knows of twice as many steps as the one before, so chains take as many rounds as their logarithm; a
    ring ends when it adds nothing. Null references mark nothing, nor do those to ids that aren't there.
    """
    named = reduce(DataFrame.union, [r.select(F.col("id")) for r in references]).where("id is not null").distinct()
    marked = settled(identities.select("id").join(named, "id", "left_semi").distinct())
    jump = settled(identities.where("alias_of is not null").select("id", "alias_of").distinct())
    while True:
        more = marked.join(jump, "id").select(F.col("alias_of").alias("id")).distinct().join(marked, "id", "left_anti")
        more = settled(more.join(identities.select("id").distinct(), "id", "left_semi"))
        if more.isEmpty():
            return identities.join(marked, "id", "left_anti")
        marked = marked.unionByName(more)
        onto = jump.select(F.col("id").alias("alias_of"), F.col("alias_of").alias("next"))
        jump = settled(jump.join(onto, "alias_of").select("id", F.col("next").alias("alias_of")).distinct())


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def stamp_truncation(traces: DataFrame, stamps: DataFrame) -> DataFrame:
    """Truncation columns of traces from stamps (tenant_id, trace_id, seq, truncated, retained, observed): the last write wins."""
    last = stamps.groupBy("tenant_id", "trace_id").agg(F.max_by(F.struct("truncated", "retained", "observed"), "seq").alias("x")).select("tenant_id", "trace_id", "x.*")
    return traces.join(last, ["tenant_id", "trace_id"], "left")


def page_after(rows: DataFrame, keys: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next page in key order, with one more row that tells whether there is another."""
    if cursor is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(c) for c in cursor]))
    return rows.orderBy(*keys).limit(limit + 1)


def worst_first(nodes: DataFrame, alerted: Column) -> DataFrame:
    """Rank of each tenant's services: critical, degraded, alerted, healthy; then by health, then by name."""
    bucket = F.when(F.col("state") == "critical", 0).when(F.col("state") == "degraded", 1).when(alerted, 2).otherwise(3)
    rows = nodes.withColumn("bucket", bucket.cast("long"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy("bucket", "score", "service_name")).cast("long"))  # one row a service


def error_counts(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """(tenant_id, service_name, spans, span_errors, logs, log_errors): input and errors by service, of both signals."""
    tier = S.severity_tier(F.col("severity"), F.lit(None).cast("int"))
    zero = F.lit(0).cast("long")
    s = spans.groupBy("tenant_id", "service_name").agg(F.count(F.lit(1)).alias("spans"), F.count_if(is_error()).alias("span_errors")).withColumns({"logs": zero, "log_errors": zero})
    x = logs.groupBy("tenant_id", "service_name").agg(F.count(F.lit(1)).alias("logs"), F.count_if(tier >= 5).alias("log_errors")).withColumns({"spans": zero, "span_errors": zero})
    return s.unionByName(x).groupBy("tenant_id", "service_name").agg(*[F.sum(c).alias(c) for c in ("spans", "span_errors", "logs", "log_errors")])


def reduction_stats(points: DataFrame) -> DataFrame:
    """Points by signal and class (late, future, accepted)."""
    return points.groupBy("signal").agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("accepted", "late", "future")], F.count(F.lit(1)).alias("input"))
