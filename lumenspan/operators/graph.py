"""Walks over spans and over the service graph.

Walks are rounds of joins: a frontier of rows is joined with the edges once for each step, so
that no graph comes to the driver or into one task. Shortest paths go on until nothing moves, error
chains double what they know of themselves; each round is written and the driver learns only whether rows are left.
Walks around a seed go up to a depth that is a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .settle import settled
from .traffic import is_error


def error_seeds(spans: DataFrame, service: str = "", since=None, limit: int | None = None) -> DataFrame:
    """(tenant_id, trace_id, error_span): each trace's first error span.

    With a service or a moment, only of its error spans, or of those that start after it. With a limit, of each tenant's
    newest so many error spans the newest one of each trace.
    """
    rows = spans.where(is_error())
    rows = rows.where(F.col("service_name") == service) if service else rows
    rows = rows.where(F.col("start_time") > F.lit(since)) if since is not None else rows
    at, pick = F.struct("start_time", "span_id"), F.min_by
    if limit is not None:
        newest = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("start_time"), F.desc("span_id")))
        rows, pick = rows.withColumn("place", newest).where(F.col("place") <= limit), F.max_by
    return rows.groupBy("tenant_id", "trace_id").agg(pick("span_id", at).alias("error_span"))


_TRACE = ["tenant_id", "trace_id"]


def chain_spans(spans: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(tenant_id, trace_id, error_span, position, span_id): each seed (error_span) and its ancestors, the seed at 0.

    By doubling: a table of the ancestors 1, 2, 4 ... steps up is joined with itself for the next one, and with what is known of
    the chains for twice as much of them, so a chain of d spans takes log2(d) rounds. A parent that is missing ends a
    chain, and so does one that was met before: a ring's spans stand once, at their first position. No round goes on beyond the
    largest trace's number of spans. Of a span id that comes twice the first by time and service is meant.
    """
    known = spans.join(seeds.select(*_TRACE).distinct(), _TRACE, "left_semi")
    known = settled(known.groupBy(*_TRACE, "span_id").agg(F.min_by("parent_span_id", F.struct("start_time", "service_name")).alias("up")))
    most = known.groupBy(*_TRACE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    most = most if depth is None else min(most, depth + 1)
    parents = known.select(*_TRACE, F.col("span_id").alias("up"))
    jump = settled(known.join(parents, [*_TRACE, "up"]).select(*_TRACE, "span_id", "up"))
    chain = [seeds.select(*_TRACE, "error_span", F.lit(0).cast("long").alias("position"), F.col("error_span").alias("span_id"))]
    step = 1
    while step < most:
        so_far = reduce(DataFrame.unionByName, chain)
        higher = so_far.join(jump, [*_TRACE, "span_id"]).select(*_TRACE, "error_span", (F.col("position") + step).alias("position"), F.col("up").alias("span_id"))
        higher = settled(higher)
        if higher.isEmpty():
            break
        chain.append(higher)
        step *= 2
        if step < most:
            onto = jump.select(*_TRACE, F.col("span_id").alias("up"), F.col("up").alias("further"))
            jump = settled(jump.join(onto, [*_TRACE, "up"]).select(*_TRACE, "span_id", F.col("further").alias("up")))
    out = reduce(DataFrame.unionByName, chain)
    out = out if depth is None else out.where(F.col("position") <= depth)
    return out.groupBy(*_TRACE, "error_span", "span_id").agg(F.min("position").alias("position"))


def error_chains(spans: DataFrame, depth: int | None = None, service: str = "", since=None, limit: int | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """From error spans (see ``error_seeds``) up to their roots, or ``depth`` steps at most.

    (tenant_id, trace_id, error_span, root_span, root_service, root_operation, hops, complete, chain): ``complete`` if the walk reached a
    span without a parent; ``chain`` lists the spans from the error up. With ``clusters`` (tenant_id, service_name, cluster_id,
    last_seen) also ``clusters``: those of the failed spans' services that were last seen after ``since``.
    """
    seeds = settled(error_seeds(spans, service, since, limit))
    operation = F.col("operation_name") if "operation_name" in spans.columns else F.lit("")
    fact = F.struct("parent_span_id", "service_name", operation.alias("operation_name"), is_error().alias("error"))
    facts = spans.groupBy(*_TRACE, "span_id").agg(F.min_by(fact, F.struct("start_time", "service_name")).alias("x"))
    placed = chain_spans(spans, seeds, depth).join(facts, [*_TRACE, "span_id"]).select(*_TRACE, "error_span", "position", "span_id", "x.*")
    placed = placed if clusters is None else settled(placed)
    listed = F.array_sort(F.collect_list(F.struct("position", "span_id", "service_name", "operation_name", "error", "parent_span_id"))).alias("chain")
    out = placed.groupBy(*_TRACE, "error_span").agg(listed)
    root = F.element_at("chain", -1)
    out = out.select(
        *_TRACE, "error_span", root["span_id"].alias("root_span"), root["service_name"].alias("root_service"), root["operation_name"].alias("root_operation"), root["position"].alias("hops"),
        (root["parent_span_id"] == "").alias("complete"), F.transform("chain", lambda s: F.struct(s["span_id"], s["service_name"], s["operation_name"], s["error"])).alias("chain"),
    )
    if clusters is None:
        return out
    near = clusters if since is None else clusters.where(F.col("last_seen") > F.lit(since))
    found = placed.where("error").select(*_TRACE, "error_span", "service_name").distinct().join(near.select("tenant_id", "service_name", "cluster_id"), ["tenant_id", "service_name"])
    found = found.groupBy(*_TRACE, "error_span").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))
    return out.join(found, [*_TRACE, "error_span"], "left").withColumn("clusters", F.coalesce("clusters", F.expr("cast(array() as array<string>)")))


def trace_graph(spans: DataFrame) -> DataFrame:
    """For each trace: spans, roots, and spans whose parent is missing."""
    known = spans.select("tenant_id", "trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("known")).dropDuplicates(["tenant_id", "trace_id", "parent_span_id"])
    joined = spans.join(known, ["tenant_id", "trace_id", "parent_span_id"], "left")
    root = F.col("parent_span_id") == ""
    return joined.groupBy("tenant_id", "trace_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if(root).alias("roots"), F.count_if(~root & F.col("known").isNull()).alias("dangling"))


def _reach(edges: DataFrame, seed: str, depth: int) -> DataFrame:
    """(tenant_id, node, depth): the fewest steps from a seed along each tenant's edges (tenant_id, a, b)."""
    frontiers, frontier = [], edges.select("tenant_id").distinct().withColumn("node", F.lit(seed))
    steps = edges.withColumnRenamed("a", "node")
    for k in range(1, depth + 1):
        frontier = frontier.join(steps, ["tenant_id", "node"]).select("tenant_id", F.col("b").alias("node")).distinct()
        frontiers.append(frontier.withColumn("depth", F.lit(k).cast("long")))
    found = reduce(DataFrame.unionByName, frontiers)
    return found.where(F.col("node") != seed).groupBy("tenant_id", "node").agg(F.min("depth").alias("depth"))


def _both_ways(edges: DataFrame) -> DataFrame:
    there = edges.withColumnsRenamed({"caller": "a", "callee": "b"})
    return there.unionByName(edges.withColumnsRenamed({"callee": "a", "caller": "b"}))


def impact(edges: DataFrame, health: DataFrame, seed: str, depth: int = 5) -> DataFrame:
    """Services of each tenant downstream of a seed; impact is one less the health (1 if unknown); ``health``: (tenant_id, service_name, score)."""
    found = _reach(edges.select("tenant_id", F.col("caller").alias("a"), F.col("callee").alias("b")).distinct(), seed, depth).withColumnRenamed("node", "service")
    known = health.select("tenant_id", F.col("service_name").alias("service"), "score")
    return found.join(known, ["tenant_id", "service"], "left").select("tenant_id", "service", "depth", S.scaled_round(1 - F.coalesce("score", F.lit(0.0)), 6).alias("impact"))


def map_around(edges: DataFrame, seed: str, depth: int = 1) -> DataFrame:
    """Services of each tenant within ``depth`` calls of a seed in either direction."""
    both = _both_ways(edges.select("tenant_id", "caller", "callee")).distinct()
    return _reach(both, seed, depth).select("tenant_id", F.col("node").alias("service"), F.col("depth").alias("hops"))


def _weights(edges: DataFrame) -> DataFrame:
    """(tenant_id, a, b, w): an undirected edge weighs 1/calls."""
    return settled(_both_ways(edges.select("tenant_id", "caller", "callee", "calls")).groupBy("tenant_id", "a", "b").agg((1.0 / F.max("calls")).alias("w")).withColumnRenamed("a", "node"))


def shortest_path(edges: DataFrame, source: str) -> DataFrame:
    """(tenant_id, service, distance) of least weight from a source in each tenant's graph.

    Bellman-Ford until no distance falls: one join and one grouping for each round, over services, not spans.
    """
    w, keys = _weights(edges), ["tenant_id", "node"]
    best = fallen = settled(w.select("tenant_id").distinct().select("tenant_id", F.lit(source).alias("node"), F.lit(0.0).alias("distance")))
    while not fallen.isEmpty():
        moved = fallen.join(w, keys).groupBy("tenant_id", F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("nearer"))
        both = settled(best.join(moved, keys, "full"))
        falls = F.col("distance").isNull() | (F.col("nearer") < F.col("distance"))
        fallen = both.where(falls).select(*keys, F.col("nearer").alias("distance"))
        best = both.select(*keys, F.least("distance", "nearer").alias("distance"))
    return best.select("tenant_id", F.col("node").alias("service"), "distance")


def shortest_routes(edges: DataFrame, source: str) -> DataFrame:
    """(tenant_id, service, distance, path) as ``shortest_path``, with the services on the way; of equal ways the first by name.

    Distances are kept to twelve places, so that sums in another order are still equal.
    """
    w, keys = _weights(edges), ["tenant_id", "node"]
    start = F.struct(F.lit(0.0).alias("distance"), F.array(F.lit(source)).alias("path")).alias("way")
    best = moved = settled(w.select("tenant_id").distinct().select("tenant_id", F.lit(source).alias("node"), start))
    while not moved.isEmpty():
        way = F.struct(F.round(F.col("way.distance") + F.col("w"), 12).alias("distance"), F.array_append("way.path", F.col("b")).alias("path"))
        near = moved.join(w, keys).where(~F.array_contains("way.path", F.col("b"))).groupBy("tenant_id", F.col("b").alias("node")).agg(F.min(way).alias("nearer"))
        both = settled(best.join(near, keys, "full"))
        moved = both.where(F.col("way").isNull() | (F.col("nearer") < F.col("way"))).select(*keys, F.col("nearer").alias("way"))
        best = both.select(*keys, F.least("way", "nearer").alias("way"))
    return best.select("tenant_id", F.col("node").alias("service"), "way.distance", "way.path")


def root_causes(chains: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Services of each tenant by evidence: one point for each chain that roots in it, two for each anomaly (tenant_id, service) of it."""
    evidence = chains.select("tenant_id", F.col("root_service").alias("service"), F.lit(1).alias("points")).unionByName(anomalies.select("tenant_id", "service", F.lit(2).alias("points")))
    return evidence.groupBy("tenant_id", "service").agg(F.sum("points").cast("long").alias("score"), F.count(F.lit(1)).alias("evidence"))


def ranked_causes(chains: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Probable causes (service, operation) of each tenant, ranked, with all their evidence.

    (tenant_id, service, operation, score, rank, evidence, chain, complete): a point for each chain that roots there and
    two for each anomaly (tenant_id, service, text) of the service; an anomaly of a service where no chain roots makes a cause without
    an operation. ``chain`` is the one of the last trace by id; one chain that is not complete makes the cause so. Of equal scores
    the first by service and operation ranks higher. ``chains`` are few: those of one service and limit.
    """
    roots = chains.groupBy("tenant_id", F.col("root_service").alias("service"), F.col("root_operation").alias("operation")).agg(
        F.count(F.lit(1)).alias("points"), F.array_sort(F.collect_list(F.concat(F.lit("error chain from trace "), "trace_id"))).alias("traces"), F.max_by("chain", "trace_id").alias("chain"), F.min("complete").alias("complete")
    )
    told = anomalies.groupBy("tenant_id", "service").agg((2 * F.count(F.lit(1))).alias("boost"), F.array_sort(F.collect_list(F.concat(F.lit("anomaly: "), "text"))).alias("texts"))
    both = roots.join(told, ["tenant_id", "service"], "full")
    none = F.expr("cast(array() as array<string>)")
    out = both.select(
        "tenant_id", "service", F.coalesce("operation", F.lit("")).alias("operation"), (F.coalesce("points", F.lit(0)) + F.coalesce("boost", F.lit(0))).alias("score"),
        F.concat(F.coalesce("traces", none), F.coalesce("texts", none)).alias("evidence"), "chain", F.coalesce("complete", F.lit(False)).alias("complete"),
    )
    w = Window.partitionBy("tenant_id").orderBy(F.desc("score"), "service", "operation")
    return out.withColumn("rank", F.row_number().over(w).cast("long"))  # a row for each cause


def service_map(nodes: DataFrame, spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Each tenant's services with their operations, callees and callers as sorted lists."""
    listed = lambda df, key, value, name: df.groupBy("tenant_id", F.col(key).alias("service_name")).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))
    out = nodes.select("tenant_id", "service_name", "spans", "errors")
    for df, key, value, name in ((spans, "service_name", "operation_name", "operations"), (edges, "caller", "callee", "calls_to"), (edges, "callee", "caller", "called_by")):
        out = out.join(listed(df, key, value, name), ["tenant_id", "service_name"], "left")
    return out.na.fill("", ["operations", "calls_to", "called_by"])


def system_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each tenant's services and calls in one table, with health, status and alerts: what a system view draws.

    (tenant_id, kind, source, target, n, avg_ms, error_rate, score, status, alerts); ``target`` and ``alerts`` of a call are empty. ``nodes``: (tenant_id,
    service_name, spans, errors, avg_ms), ``edges``: (tenant_id, caller, callee, calls, avg_ms, error_rate).
    """
    rate = F.when(F.col("spans") > 0, F.col("errors") / F.col("spans")).otherwise(0.0)
    services = nodes.select("tenant_id", F.lit("service").alias("kind"), F.col("service_name").alias("source"), F.lit("").alias("target"), F.col("spans").alias("n"), "avg_ms", rate.alias("rate"))
    calls = edges.select("tenant_id", F.lit("call").alias("kind"), F.col("caller").alias("source"), F.col("callee").alias("target"), F.col("calls").alias("n"), "avg_ms", F.col("error_rate").alias("rate"))
    score = S.health_score_fallback(F.col("rate"), F.col("avg_ms"))
    alerts = F.when(F.col("kind") == "service", F.array_join(S.alerts_by_mean(F.col("rate"), F.col("avg_ms")), "; ")).otherwise("")
    return services.unionByName(calls).select("tenant_id", "kind", "source", "target", "n", "avg_ms", S.scaled_round(F.col("rate"), 6).alias("error_rate"), score.alias("score"), S.health_status(score).alias("status"), alerts.alias("alerts"))


def typed_edges(spans: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(type, source, target) for each structural edge: EXPOSES, CONTAINS, CHILD_OF, and LOGGED_DURING with logs."""
    parts = [
        spans.select(F.lit("EXPOSES").alias("type"), F.col("service_name").alias("source"), F.col("operation_name").alias("target")),
        spans.select(F.lit("CONTAINS").alias("type"), F.col("trace_id").alias("source"), F.col("span_id").alias("target")),
        spans.where("parent_span_id <> ''").select(F.lit("CHILD_OF").alias("type"), F.col("span_id").alias("source"), F.col("parent_span_id").alias("target")),
    ]
    if logs is not None:
        parts.append(logs.where("trace_id <> ''").select(F.lit("LOGGED_DURING").alias("type"), F.col("log_id").cast("string").alias("source"), F.col("trace_id").alias("target")))
    return reduce(DataFrame.unionByName, parts).distinct()


def prune(nodes: DataFrame, scope: list[str], most: int) -> DataFrame:
    """The ``most`` rows of a scope that were seen last."""
    w = Window.partitionBy(*scope).orderBy(F.desc("last_seen"), "id")
    return nodes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")
