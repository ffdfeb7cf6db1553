"""The stored graph: increments equal one rebuild, nothing counts twice."""

import random
from datetime import datetime, timedelta

from lumenspan.operators import incremental, traffic
from lumenspan.sources import telemetry

NOON = datetime(2026, 6, 1, 12)
SPANS = "tenant_id string, trace_id string, span_id string, parent_span_id string, service_name string, operation_name string, start_time timestamp, duration_us long, status string"


def _rows():
    """Two tenants; children before, with and after their parents, in the order of start."""
    rng, rows = random.Random(6), []
    for t in range(30):
        for k in range(8):
            parent = rng.choice(["", "0" * 16, "gone", *[f"s{j}" for j in range(8) if j != k]])
            rows.append((rng.choice(["default", "other"]) if t % 5 == 0 else "default", f"t{t}", f"s{k}", parent, rng.choice(["a", "b", "c", ""]), "op", NOON + timedelta(seconds=rng.randrange(3600)), 10 * k, "STATUS_CODE_ERROR" if k == 3 else "STATUS_CODE_UNSET"))
    return rows


def _edges(df):
    return {(r["tenant_id"], r["caller"], r["callee"]): (r["n"], r["errors"], r["duration_sum"]) for r in df.collect()}


def test_increments_equal_one_rebuild(spark, tmp_path):
    spans = spark.createDataFrame(_rows(), SPANS)
    path, whole = str(tmp_path / "steps"), str(tmp_path / "whole")
    for k, minutes in enumerate((10, 25, 25, 60)):  # the third time nothing is new
        revision = incremental.advance(spans, path, NOON + timedelta(minutes=minutes))
        assert revision == (1, 2, 2, 3)[k]
    incremental.advance(spans, whole)
    calls = traffic.calls(spans)
    want = {}
    for r in calls.collect():
        n, e, d = want.get((r["tenant_id"], r["caller"], r["callee"]), (0, 0, 0))
        want[r["tenant_id"], r["caller"], r["callee"]] = (n + 1, e + (r["status"] == "STATUS_CODE_ERROR"), d + r["duration_us"])
    assert _edges(incremental.graph(spark, path, "edges")) == _edges(incremental.graph(spark, whole, "edges")) == want and len(want) > 6
    nodes = lambda p: sorted(map(tuple, incremental.graph(spark, p, "nodes").collect()))
    assert nodes(path) == nodes(whole)
    # a revision whose mark is missing doesn't count, and is written again
    (tmp_path / "steps/marks/revision=3").rename(tmp_path / "aside")
    assert incremental.last_mark(spark, path)["number"] == 2 and incremental.advance(spans, path) == 3
    assert _edges(incremental.graph(spark, path, "edges")) == want


def test_old_edges_and_idle_tenants_go(spark, tmp_path):
    row = lambda tenant, trace, span, parent, service, s: (tenant, trace, span, parent, service, "op", NOON + timedelta(seconds=s), 1, "")
    rows = [row(t, "t", "p", "", "a", 0) for t in ("default", "x", "y")] + [row(t, "t", "c", "p", "b", 1) for t in ("default", "x", "y")] + [row("y", "u", "p", "", "a", 5000), row("y", "u", "c", "p", "c", 5001)]
    spans, path = spark.createDataFrame(rows, SPANS), str(tmp_path / "g")
    incremental.advance(spans, path, NOON + timedelta(seconds=10))
    incremental.advance(spans, path, idle_ttl=3600)
    assert set(_edges(incremental.graph(spark, path, "edges"))) == {("default", "a", "b"), ("y", "a", "b"), ("y", "a", "c")}  # x was idle, default stays
    path = str(tmp_path / "h")
    incremental.advance(spans, path, NOON + timedelta(seconds=10))
    incremental.advance(spans, path, edge_ttl=3600)
    assert set(_edges(incremental.graph(spark, path, "edges"))) == {("y", "a", "c")}


def test_spans_are_made_twice_at_most_for_each_step(spark, tmp_path):
    """What makes the spans runs for the new ones once and for the old ones once, not for each use of them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = _rows()
    spans, path = spark.createDataFrame(rows, SPANS).mapInArrow(count, SPANS), str(tmp_path / "g")
    for steps, minutes in ((1, 20), (3, 60)):
        incremental.advance(spans, path, NOON + timedelta(minutes=minutes))
        assert made.value <= steps * len(rows) + len(rows)


def test_owners_give_the_same_calls(spark):
    sf = "/root/testdata/sf0.001"
    every, owned = traffic.calls(telemetry.order_spans(spark, sf)), traffic.calls(telemetry.order_spans(spark, sf), telemetry.order_owners(spark, sf))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, owned.select(every.columns).collect()))
    plan = lambda df: df.drop("span_id").groupBy("caller").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(every) and "Window" not in plan(owned)  # no line is numbered
