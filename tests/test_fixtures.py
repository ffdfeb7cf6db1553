"""Hand-computed cases of the service map, counters, masks, routes, histograms and anomalies."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import scalars as S
from lumenspan.functions import sketch
from lumenspan.operators import anomaly, counters, graph, histogram, identity, logs, merging, mining, rollup, sampling, selection, serving, settle, traffic
from lumenspan.plans import catalogue
from lumenspan.sources import sinks
from lumenspan.streaming import pipelines

NOON = datetime(2026, 6, 1, 12)
E, U = "STATUS_CODE_ERROR", "STATUS_CODE_UNSET"


SPAN = "tenant_id string, trace_id string, span_id string, parent_span_id string, service_name string, duration_us long, status string, start_time timestamp"


def test_service_map(spark):
    rows = [  # a shop's gateway calls cart and stock, cart calls stock; another tenant has the same names
        ("one", "g", "", "gate", 9000, U), ("one", "g2", "g", "gate", 1000, E), ("one", "c", "g", "cart", 4000, U), ("one", "s", "c", "stock", 700, E), ("one", "s2", "g", "stock", 300, U),
        ("one", "n", "g", "", 50, U), ("one", "u", "n", "cart", 60, U), ("one", "l", "lost", "cart", 140, U), ("one", "z", "0000000000000000", "stock", 500, U), ("two", "g", "", "gate", 8, E), ("two", "c", "g", "cart", 16, E),
    ]
    spans = spark.createDataFrame([(t, "x", s, p, v, d, st, NOON) for t, s, p, v, d, st in rows], SPAN)
    late = spark.createDataFrame([("one", "x", "o", "", "gate", 77, E, NOON + timedelta(hours=1))], SPAN)
    seen = traffic.in_range(spans.unionByName(late), "start_time", NOON, NOON + timedelta(minutes=10))
    assert {tuple(r) for r in traffic.service_map_nodes(seen).collect()} == {("one", "gate", 2, 1, 5.0), ("one", "cart", 3, 0, 1.4), ("one", "stock", 3, 1, 0.5), ("two", "gate", 1, 1, 0.01), ("two", "cart", 1, 1, 0.02)}
    assert {tuple(r)[:5] for r in traffic.service_map_edges(seen).collect()} == {("one", "gate", "cart", 1, 4.0), ("one", "gate", "stock", 1, 0.3), ("one", "cart", "stock", 1, 0.7), ("two", "gate", "cart", 1, 0.02)}


def test_p99(spark):
    df = spark.createDataFrame([(t, "s", i * k) for t, k in (("one", 3), ("two", 1000)) for i in range(1, 201)], "tenant_id string, service_name string, duration_us long")
    assert {(r["tenant_id"], r["p99_us"]) for r in traffic.p99_exact(df).collect()} == {("one", 198 * 3), ("two", 198 * 1000)}


@pytest.mark.parametrize(
    "points, want",
    [
        ([(0, 5, 40), (0, 9, 47), (0, 9, 47), (0, 5, 40)], [("seed", 0), ("normal", 7)]),
        ([(0, 5, 40), (20, 50, 90)], [("seed", 0), ("reset", 90)]),
        ([(0, 5, 40), (0, 50, 8)], [("seed", 0), ("reset", 8)]),
        ([(0, 0, 1), (0, 601, 9), (0, 650, 10), (0, 1250, 13), (0, 1851, 14)], [("seed", 0), ("gap", 0), ("normal", 1), ("normal", 3), ("gap", 0)]),
    ],
)
def test_counters(spark, points, want):
    rows = [("s", 0, NOON + timedelta(seconds=st), NOON + timedelta(seconds=ts), v, i) for i, (st, ts, v) in enumerate(points)]
    df = spark.createDataFrame(rows, "series string, producer long, start_ts timestamp, timestamp timestamp, value long, seq long")
    got = counters.deltas(df, ["series", "producer"], ["seq"]).orderBy("timestamp").select("event", "delta").collect()
    assert [tuple(r) for r in got] == want


def test_requests(spark):
    rows = [("", 2), ("x", 2), ("", 1), ("x", 3)]
    df = spark.createDataFrame(rows, "p string, k int")
    assert df.where(S.is_request(F.col("p"), F.col("k"))).count() == 3


@pytest.mark.parametrize(
    "path, want",
    [
        ("/shops/77/stock", "/shops/{id}/stock"), ("/a/abc1234/b", "/a/abc1234/b"), ("/a/abc12345/b", "/a/{id}/b"), ("/k/0f8fad5b-d9cb-469f-a165-70867728950e", "/k/{id}"),
        ("/f/Zm9vYmFyQmF6UXV4MTIz", "/f/{id}"), ("/f/NoDigitsInThisOneHere", "/f/NoDigitsInThisOneHere"), ("/shops/5?q=1#top", "/shops/{id}"), ("/up?", "/up"), ("//x//9", "//x//{id}"), ("shops/5?q", "shops/5?q"), ("", ""),
    ],
)
def test_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(S.normalize_path(F.col("p"))).first()[0] == want


@pytest.mark.parametrize("name, want", [("PUT /shops/12/items/5", "PUT /shops/{id}/items/{id}"), ("delete /x/1", "delete /x/{id}"), ("FETCH /x/1", "FETCH /x/1"), ("GET x/1", "GET x/1")])
def test_span_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(S.normalize_span_name(F.col("p"))).first()[0] == want


@pytest.mark.parametrize(
    "body, want",
    [
        ("waited +2.50 s", "waited <NUM> s"), ("v2beta31", "v<NUM>beta<NUM>"), ("from 192.168.0.1:80 on", "from <IP> on"), ("id 0f8fad5b-d9cb-469f-a165-70867728950e", "id <UUID>"), ("0XBEEF feedfacefeedface", "<HEX> <HEX>"),
        ("on 2025-02-03 at", "on <TS> at"), ("to a.b@c.org;", "to <EMAIL>"), ("\t two   gaps\n", "two gaps"), ("", ""), ("x " * 127 + "y", "x " * 127 + "y"), ("x " * 128, "x " * 128 + "<TRUNC>"), ("x " * 130, "x " * 128 + "<TRUNC>"),
    ],
)
def test_masks(spark, body, want):
    assert spark.createDataFrame([(body,)], "p string").select(F.array_join(S.mask_tokens(F.col("p")), " ")).first()[0] == want


def _histogram(spark, **kw):
    row = {"k": "h", "bounds": [1.0, 2.0, 4.0], "counts": [0, 5, 7, 2], "count": 14, "min": None, "max": None, "temporality": "delta"} | kw
    return spark.createDataFrame([tuple(row.values())], "k string, bounds array<double>, counts array<long>, count long, min double, max double, temporality string")


def test_histograms(spark):
    fold = lambda **kw: histogram.fold_explicit(_histogram(spark, **kw), ["k"]).first()
    r = fold()
    assert (r["usable"], sum(b["c"] for b in r["bins"]), r["tail_count"], r["tail_bound"]) == (True, 12, 2, 4.0)
    assert not fold(counts=[3, 5, 7, 0], count=15)["usable"]
    r = fold(counts=[3, 5, 7, 4], count=19)
    assert (r["usable"], r["tail_count"], r["tail_bound"]) == (False, 0, None)
    assert fold(counts=[3, 5, 7, 0], count=15, min=0.5)["usable"]
    assert fold(temporality="cumulative") is None
    assert fold(count=13) is None
    q = histogram.quantile_with_tail(histogram.fold_explicit(_histogram(spark), ["k"]), ["k"], 0.99).first()
    assert (q["value"], q["is_lower_bound"]) == (4.0, True)


def test_tail_bound_is_the_lowest(spark):
    points = _histogram(spark, bounds=[1.0, 2.0], counts=[0, 5, 3], count=8).unionByName(_histogram(spark, bounds=[1.0, 100.0], counts=[0, 5, 3], count=8))
    r = histogram.fold_explicit(points, ["k"]).first()
    assert (r["tail_count"], r["tail_bound"]) == (6, 2.0)


def test_histograms_of_series_with_zeros(spark):
    """Values that no bucket holds (zero, negative, null) don't make a series go, and a bucket from zero is the zero bin's."""
    rows = [("z", 0.0), ("z", 0.5), ("z", 7.0), ("z", 300.0), ("n", -2.0), ("n", None), ("n", 3.0), ("e", None), ("h", float("inf")), ("h", float("nan")), ("h", 0.5)]
    points = catalogue._histogram_of(spark.createDataFrame([("s", *r) for r in rows], "service_name string, name string, value double"))
    folded = histogram.fold_explicit(points, ["name"], from_zero=True)
    got = {r["name"]: (r["usable"], r["tail_count"], [(b["bin"], b["c"]) for b in r["bins"]]) for r in folded.collect()}
    seven, three, half = (math.ceil(math.log2(math.sqrt(a * b)) * 16) - 1 for a, b in ((5, 10), (1, 5), (0.5, 1)))
    assert got == {"z": (True, 1, [(None, 1), (seven, 1)]), "n": (True, 0, [(three, 1)]), "e": (True, 0, []), "h": (True, 2, [(half, 1)])}
    quantile = {r["name"]: (r["value"], r["is_lower_bound"]) for r in histogram.quantile_with_tail(folded, ["name"], 0.1).collect()}
    assert quantile["z"][0] == pytest.approx(7.0, rel=0.03) and quantile["e"] == (None, False)
    assert {r["name"]: r["source_bucket_error"] for r in histogram.accuracy(folded, ["name"]).collect()}["z"] == 1.0


def test_search_of_a_body_and_another_service(spark):
    df = spark.createDataFrame([(1, "a License", "x"), (2, "held in c1", "x"), (3, "none", "SRC1"), (4, None, "licensed"), (5, None, None)], "log_id long, body string, service_name string")
    ids = lambda *q: {r["log_id"] for r in serving.search_body_or_service(df, *q).collect()}
    assert ids("licens", "C1") == {1, 3} and ids("licens") == {1, 4} and ids("C1") == {2, 3}


def test_collapse_with_zeros(spark):
    bins = spark.createDataFrame([("a", None, 1), ("a", 40, 1), ("b", None, 3)], "k string, bin int, count long")
    assert {(r["k"], r["bin"]): r["count"] for r in sketch.collapse(bins, ["k"], 10, zeros=True).collect()} == {("a", 31): 1, ("a", 40): 1, ("b", None): 3}


def test_quantiles_with_zeros(spark):
    bins = spark.createDataFrame([("a", None, 1), ("a", 40, 1), ("b", None, 3)], "k string, bin int, count long")
    value = lambda **kw: {r["k"]: r["value"] for r in sketch.quantiles(bins, ["k"], [0.99], **kw).collect()}
    assert value() == {"a": 0.0, "b": 0.0}
    assert value(zeros=False) == {"a": pytest.approx(2 ** (41 / 16), rel=0.03), "b": 0.0}


def test_windows_with_a_zero(spark):
    spans = spark.createDataFrame([("t", "s", NOON, us, "") for us in (0, 15_000)] + [("t", "z", NOON, 0, "")], "tenant_id string, service_name string, start_time timestamp, duration_us long, status string")
    got = {r["service_name"]: r["p99_us"] for r in serving.topology_windows(spans, NOON).collect()}
    assert got == {"s": pytest.approx(15_000, rel=0.03), "z": 0.0}


def test_exponential_zeros_and_rejects(spark):
    point = {"k": "e", "scale": 4, "offset": 0, "counts": [1, 2], "zero_count": 7, "negative": 0, "count": 10}
    schema = "k string, scale int, offset int, counts array<long>, zero_count long, negative long, count long"
    of = lambda *changes: spark.createDataFrame([tuple((point | c).values()) for c in changes], schema)
    bins = histogram.fold_exponential(of({}), ["k"])
    assert {(r["bin"], r["count"]) for r in bins.collect()} == {(None, 7), (0, 1), (1, 2)}
    assert sketch.quantiles(bins, ["k"], [0.5]).first()["value"] == 0  # seven of ten are zeros
    odd = [{"count": 11}, {"scale": 21}, {"scale": -11}, {"counts": [-1, 4]}, {"negative": 1, "count": 11}, {"scale": -1}, {}]
    want = ["sum_of_counts", "scale", "scale", "buckets", "negative_observations", "negative_scale", None]
    assert [r[0] for r in of(*odd).select(histogram.exponential_reject()).collect()] == want


def test_log_exemplars_of_each_tenant(spark):
    rows = [(t, "s", NOON + timedelta(seconds=i % 60), 100 * k + i, "ERROR") for k, t in enumerate("ab") for i in range(60)]
    out = logs.first_per_slot(spark.createDataFrame(rows, "tenant_id string, service_name string, timestamp timestamp, log_id long, severity string"))
    assert {(r["tenant_id"], r["count"]) for r in out.groupBy("tenant_id").count().collect()} == {("a", 50), ("b", 50)}


def test_severity_ranks(spark):
    rank = lambda t: spark.range(1).select(S.severity_rank(F.lit(t))).first()[0]
    assert [rank(t) for t in ("FATAL ERROR", "fatal", "debug info", "Warning", "stderr", "x", None)] == [40, 50, 10, 30, 40, 20, 20]


def test_dims_are_typed(spark):
    cases = ['{"z": "[eu]"}', '{"z": "{a"}', '{"z": ["eu"]}', '{"z": {"a": 1}}', '{"z": 7}', '{"z": 1.0}', '{"z": 0.25}', '{"z": 1e21}', '{"z": 0.00001}', '{"z": 12345678.5}', '{"z": true}', '{"z": null}', '{"y": 1}', "{", None, '{"z": ""}', '{"z": 0.0}']
    got = spark.createDataFrame([(c,) for c in cases], "a string").select(serving.dims(F.col("a"), ["z"])).collect()
    want = ["[eu]", "{a", None, None, "7", "1", "0.25", "1e+21", "1e-05", "12345678.5", "true", None, None, None, None, "", "0"]
    assert [r[0] and r[0][0] for r in got] == want
    assert spark.range(1).select(serving.dims(F.lit('{"a.b": "x", "c": 2}'), ["a.b", "c"])).first()[0] == ["x", "2"]


def test_sketch_laws(spark):
    import random

    rng = random.Random(5)
    values = [min(1e8, max(1.0, rng.lognormvariate(8, 2))) for _ in range(2000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "part int, v double")
    whole = sketch.build(df, [], "v")
    merged = sketch.merge(sketch.build(df, ["part"], "v").drop("part"), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    got = {r["q"]: r["value"] for r in sketch.quantiles(whole.withColumn("k", F.lit(1)), ["k"], [0.5, 0.9, 0.99]).collect()}
    for q, v in got.items():
        exact = sorted(values)[int(q * (len(values) - 1))]
        assert abs(v - exact) <= exact * (sketch.relative_error() + 1e-9)


@pytest.mark.parametrize("k", range(-20, 41, 5))
def test_sketch_powers(spark, k):
    assert spark.range(1).select(sketch.bin_of(F.lit(2.0**k))).first()[0] == 16 * k - 1


def _windows(spark, base, now):
    rows = [("t", "s", NOON + timedelta(minutes=5 * i), True, True, 300.0, *w) for i, w in enumerate(base)]
    rows += [("quiet", *r[1:-3], 10 * r[-3], 0, r[-1]) for r in rows]  # another tenant's baseline is none of its own
    rows.append(("t", "s", NOON + timedelta(minutes=5 * len(base)), *now))
    return spark.createDataFrame(rows, "tenant_id string, service string, start timestamp, closed boolean, final boolean, elapsed_s double, n long, errors long, p99_us double")


@pytest.mark.parametrize(
    "base, now, fires",
    [
        ([(1000, 10, 0.0)] * 4, (True, False, 300.0, 500, 100, 0.0), True), ([(1000, 10, 0.0)] * 4, (True, False, 300.0, 19, 19, 0.0), False), ([(1000, 10, 0.0)] * 4, (False, False, 5.0, 400, 200, 0.0), False),
        ([(1000, 10, 0.0)] * 4, (False, False, 180.0, 400, 200, 0.0), True), ([(30, 0, 0.0)], (True, False, 300.0, 500, 400, 0.0), False),
    ],
)
def test_error_spikes(spark, base, now, fires):
    assert (anomaly.error_spikes(_windows(spark, base, now)).count() == 1) == fires


@pytest.mark.parametrize("base, now, fires", [(20_000.0, 400_000.0, True), (900_000.0, 900_000.0, False)])
def test_latency_spikes(spark, base, now, fires):
    w = _windows(spark, [(1000, 0, base)] * 4, (True, False, 300.0, 500, 0, now))
    assert (anomaly.latency_spikes(w).count() == 1) == fires


def test_overflow_keeps_totals(spark):
    df = spark.createDataFrame([("s", f"n{i % 7}", i) for i in range(70)], "scope string, name string, at long")
    out = rollup.overflow(df, ["scope"], "name", ["at"], 5).groupBy("name").count().collect()
    assert {r["name"] for r in out} == {"n0", "n1", "n2", "n3", "n4", "__other__"} and sum(r["count"] for r in out) == 70


def test_cooldown(spark):
    times = [0, 100, 299, 300, 500, 601]
    df = spark.createDataFrame([("k", NOON + timedelta(seconds=t)) for t in times], "k string, moment timestamp")
    got = sorted((r["moment"] - NOON).total_seconds() for r in sampling.cooldown(df, ["k"], 300).collect())
    assert got == [0, 300, 601]


def test_search_clamp():
    day = timedelta(hours=24)
    assert logs.clamp_search_window(None, None, NOON) == (NOON - day, NOON)
    assert logs.clamp_search_window(NOON - 3 * day, NOON, NOON) == (NOON - day, NOON)
    assert logs.clamp_search_window(NOON - day / 2, NOON, NOON) == (NOON - day / 2, NOON)


def test_severities(spark):
    row = lambda *a: spark.range(1).select(S.severity_tier(*map(F.lit, a))).first()[0]
    assert [row("critical", 0), row("ERR", 0), row("warning", 0), row("", 0), row("x", 0), row("info", 17)] == [6, 5, 4, 0, 3, 5]


def test_error_chains_have_no_depth_limit(spark):
    chain = [("t1", f"s{k}", f"s{k - 1}" if k else "", f"svc-{k}", E if k == 14 else U, NOON) for k in range(15)]
    ring = [("t2", f"r{k}", f"r{(k + 1) % 12}", f"svc-{k}", E if k == 0 else U, NOON) for k in range(12)]
    lost = [("t3", "x", "gone", "svc-x", E, NOON)]
    spans = spark.createDataFrame([("default", *r) for r in chain + ring + lost], "tenant_id string, trace_id string, span_id string, parent_span_id string, service_name string, status string, start_time timestamp")
    pick = ["trace_id", "error_span", "root_span", "root_service", "hops", "complete"]
    got = {tuple(r) for r in graph.error_chains(spans).select(pick).collect()}
    assert got == {("t1", "s14", "s0", "svc-0", 14, True), ("t2", "r0", "r11", "svc-11", 11, False), ("t3", "x", "x", "svc-x", 0, False)}
    assert {(r["root_span"], r["hops"]) for r in graph.error_chains(spans.where("trace_id = 't1'"), 3).collect()} == {("s11", 3)}
    assert graph.error_chains(spans.where("trace_id = 't4'")).count() == 0
    roots = graph.root_causes(graph.error_chains(spans), spark.createDataFrame([], "tenant_id string, service string"))
    assert {r["service"] for r in roots.collect()} == {"svc-0", "svc-11", "svc-x"}


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "settled", lambda df: rounds.append(1) or settle.settled(df))
    chain = [("default", "t1", f"s{k}", f"s{k - 1}" if k else "", f"svc-{k % 7}", E if k == 999 else U, NOON) for k in range(1000)]
    spans = spark.createDataFrame(chain, "tenant_id string, trace_id string, span_id string, parent_span_id string, service_name string, status string, start_time timestamp")
    r = graph.error_chains(spans).first()
    assert (r["hops"], r["complete"], r["root_span"]) == (999, True, "s0") and [s["span_id"] for s in r["chain"]] == [f"s{k}" for k in range(999, -1, -1)]
    assert len(rounds) <= 4 + 2 * 10


def test_chains_of_a_service_with_clusters_and_causes(spark):
    def span(t, tr, s, p, svc, status, k):
        return (t, tr, s, p, f"op-{svc}", svc, NOON + timedelta(seconds=k), status)

    rows = [span("default", f"t{k}", "a", "", "web" if k < 3 else "db", E, 10 * k) for k in range(5)] + [span("default", f"t{k}", "b", "a", "api", E, 10 * k + 1) for k in range(5)] + [span("default", "t0", "c", "gone", "api", E, 500), span("other", "t1", "b", "", "api", E, 9)]
    spans = spark.createDataFrame(rows, "tenant_id string, trace_id string, span_id string, parent_span_id string, operation_name string, service_name string, start_time timestamp, status string")
    clusters = spark.createDataFrame([("default", "api", "c1", NOON + timedelta(hours=1)), ("default", "web", "c2", NOON - timedelta(hours=1)), ("default", "web", "c3", NOON + timedelta(hours=1)), ("other", "web", "c4", NOON + timedelta(hours=1))], "tenant_id string, service_name string, cluster_id string, last_seen timestamp")
    got = {(r["tenant_id"], r["trace_id"]): r for r in graph.error_chains(spans, service="api", since=NOON + timedelta(seconds=5), limit=3, clusters=clusters).collect()}
    assert set(got) == {("default", "t0"), ("default", "t4"), ("default", "t3"), ("other", "t1")}  # the newest three of a tenant
    t0, t3 = got["default", "t0"], got["default", "t3"]
    assert (t0["root_span"], t0["complete"], t0["clusters"]) == ("c", False, ["c1"]) and (t3["root_service"], t3["hops"], t3["clusters"]) == ("db", 1, ["c1"])
    every = graph.error_chains(spans, service="api", clusters=clusters)
    assert {r["trace_id"]: r["clusters"] for r in every.where("tenant_id = 'default' and trace_id = 't1'").collect()} == {"t1": ["c1", "c2", "c3"]}
    anomalies = spark.createDataFrame([("default", "db", "slow"), ("default", "db", "errors"), ("default", "cache", "evictions")], "tenant_id string, service string, text string")
    ranked = graph.ranked_causes(every.where("tenant_id = 'default'"), anomalies).orderBy("rank").collect()
    assert [(r["service"], r["operation"], r["score"], r["complete"]) for r in ranked] == [("db", "op-db", 6, True), ("web", "op-web", 3, True), ("cache", "", 2, False)]
    assert ranked[0]["evidence"] == ["error chain from trace t3", "error chain from trace t4", "anomaly: errors", "anomaly: slow"] and [s["span_id"] for s in ranked[0]["chain"]] == ["b", "a"] and ranked[2]["chain"] is None


def test_shortest_path_has_no_round_limit(spark):
    edges = [(f"n{k}", f"n{k + 1}", 100) for k in range(9)] + [("n0", "n9", 2)]  # nine light edges beat one heavy one
    other = [("u", "n0", "n1", 1)]  # another tenant's edge is no way
    both = spark.createDataFrame([("t", *e) for e in edges] + other, "tenant_id string, caller string, callee string, calls long")
    got = {r["service"]: r["distance"] for r in graph.shortest_path(both, "n0").where("tenant_id = 't'").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {f"n{k}": round(k / 100, 9) for k in range(10)}


def _sampled(rows, rate, slow):
    """The spans that a plain token bucket keeps."""
    kept, buckets = [], {}
    for tenant, service, span, at, duration, status in sorted(rows, key=lambda r: (r[3], r[2])):
        if status == E or duration >= slow or rate >= 1:
            kept.append((tenant, service, span))
        elif rate > 0:
            most, key = max(1.0, 1 / rate), (tenant, service)
            if key not in buckets:
                buckets[key] = [most, at]
                kept.append((*key, span))
            else:
                b = buckets[key]
                b[0], b[1] = min(most, b[0] + (at - b[1]) * rate), at
                if b[0] >= 1:
                    b[0] -= 1
                    kept.append((*key, span))
    return sorted(kept)


@pytest.mark.parametrize("rate", [0, 0.05, 0.5, 1, 3])
def test_sampler(spark, rate):
    rng = random.Random(3)
    rows = [(f"t{i % 2}", f"s{i % 3}", f"{i:04d}", rng.randrange(900), rng.choice([5, 5, 5, 5, 900]), E if rng.random() < 0.05 else U) for i in range(800)]
    df = spark.createDataFrame([(t, v, s, NOON + timedelta(seconds=a), d, st) for t, v, s, a, d, st in rows], "tenant_id string, service_name string, span_id string, start_time timestamp, duration_us long, status string")
    got = sorted(map(tuple, sampling.adaptive_sample(df, rate, 600).collect()))
    assert got == _sampled(rows, rate, 600) and (len(got) == 800) == (rate >= 1)


def test_miner(spark):
    bodies = ["a b c d p0 p1 q r", "a b c d x0 p1 s t", "a b c d z0 z1 q r"] + [f"only {w} here" for w in "efghijklmno"] + ["", "a b c d p0 p1 q r"]
    rows = [(t, "svc", NOON + timedelta(seconds=i), i, b) for t in ("one", "two") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "tenant_id string, service_name string, timestamp timestamp, log_id long, body string")
    got = {(r["tenant_id"], r["template"]): r["n"] for r in mining.mine_templates(df, most=2).collect()}
    # the words that differ widen a template, and lines before that count under its last text
    assert got == {(t, x): n for t in ("one", "two") for x, n in {"a b c d <*> <*> <*> <*>": 4, "only e here": 1, mining.OTHER: 11}.items()}
    with_text = {(r["log_id"], r["template"]) for r in mining.with_template(df, most=2).where("tenant_id = 'one'").collect()}
    assert {k for k, t in with_text if t.startswith("a b")} == {0, 1, 2, len(bodies) - 1} and len(with_text) == len(bodies)
    assert mining.mine_templates(df.where("log_id < 0")).count() == 0


def test_sketch_collapse_without_keys(spark):
    bins = spark.createDataFrame([(k, 1) for k in range(100)] + [(None, 5)], "bin int, count long")
    got = {r["bin"]: r["count"] for r in sketch.collapse(bins, [], 10).collect()}
    assert got == {None: 5, 90: 91} | {k: 1 for k in range(91, 100)}


def test_small_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(S.normalize_operation(*map(F.lit, x))) for x in (("/r/{k}", "/r/5", "GET /r/5"), ("", "/r/5", "n"), ("", "", "GET /r/5"))] == ["/r/{k}", "/r/{id}", "GET /r/{id}"]
    assert [value(S.is_gauge_like(F.lit(t), F.lit(m))) for t, m in (("delta", False), ("cumulative", False), ("cumulative", True))] == [False, True, False]
    assert value(S.cooldown_key(F.lit(" A b"), F.lit("C "))) == "a b|c"


def test_anomaly_upsert_and_late_split(spark, tmp_path):
    df = spark.createDataFrame([("s", "t", NOON, 1), ("s", "t", NOON + timedelta(seconds=1), 2), ("s", "u", NOON, 3)], "service string, type string, moment timestamp, n int")
    assert {(r["type"], r["n"]) for r in anomaly.upsert(df).collect()} == {("t", 2), ("u", 3)}
    points = spark.createDataFrame([(NOON, NOON + timedelta(seconds=s)) for s in (0, 899, 900, -121)], "timestamp timestamp, arrival timestamp")
    kept, rejected = pipelines.split_late(points)
    assert (kept.count(), rejected.count()) == (2, 2)
    sinks.append(df.withColumn("tenant_id", F.lit("one")), str(tmp_path / "out"), "moment")
    sinks.append(df.withColumn("tenant_id", F.lit("two")), str(tmp_path / "out"), "moment")
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("tenant_id", "date").count().count() == 2


def test_templates_used_last_are_live(spark):
    lines = ["a b c d e f", "k l m n o p", "a b c d e g", "u v w x y z"]
    rows = [(t, "s", NOON + timedelta(seconds=i), i, b) for t in ("t1", "t2") for i, b in enumerate(lines)]
    df = spark.createDataFrame(rows, "tenant_id string, service_name string, timestamp timestamp, log_id long, body string")
    mined = mining.mine(df, ["tenant_id"], None)
    got = sorted((r["tenant_id"], " ".join(r["words"]), r["n"]) for r in mining.live(mined.templates, ["tenant_id"], 2).collect())
    assert got == [(t, x, n) for t in ("t1", "t2") for x, n in (("a b c d e <*>", 2), ("u v w x y z", 1))]  # the second was used longest ago


def test_hash_by_published_vectors(spark):
    texts = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a(F.col("t")).alias("h"))
    assert dict(map(tuple, df.collect())) == texts


def test_durations_and_moments(spark):
    cases = {"1h30m": 5.4e9, "-1.5s": -1.5e6, "2us": 2.0, "+.5ms": 500.0, "0": 0.0, "": None, "5": None, "h": None, "1h ": None, "1d": None, None: None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.parse_duration(F.col("t")))
    assert dict(map(tuple, got.collect())) == cases
    moments = {"2026-06-01T12:00:00Z": NOON, "2026-06-01T14:00:00+02:00": NOON, "2026-06-01T12:00:00": None, "2026-13-01T12:00:00Z": None, None: None}
    got = spark.createDataFrame([(t,) for t in moments], "t string").select("t", S.parse_moment(F.col("t")))
    assert dict(map(tuple, got.collect())) == moments


def test_shortest_route(spark):
    edges = [(f"n{k}", f"n{k + 1}", 100) for k in range(9)] + [("n0", "n9", 2), ("n0", "m", 100), ("m", "n2", 100)]  # m is as near as n1, and first by name
    got = {r["service"]: r["path"] for r in graph.shortest_routes(spark.createDataFrame([("t", *e) for e in edges], "tenant_id string, caller string, callee string, calls long"), "n0").collect()}
    assert got["n9"] == ["n0", "m"] + [f"n{k}" for k in range(2, 10)] and got["n1"] == ["n0", "n1"] and got["n0"] == ["n0"]


def test_pages_and_marks(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("k"))
    assert [tuple(r) for r in merging.counted_page(df, [F.col("id")], 0, -4).collect()] == [(0, 0, 30)]
    seen, mark = [], None
    while rows := merging.read_above(df, mark, ["k", "id"], 7).collect():
        seen += [(r["k"], r["id"]) for r in rows]
        mark = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(30))


def test_merging_of_nothing(spark):
    gauges = spark.createDataFrame([], "k string, n long, sum double, min double, max double, last double, last_time timestamp")
    assert merging.merge_gauges(gauges, ["k"]).count() == 0
    no_point = spark.createDataFrame([("a", 0, 9.0, 9.0, 9.0, 9.0, NOON), ("a", 1, 2.0, 2.0, 2.0, 2.0, NOON - timedelta(hours=1))], gauges.schema)
    assert tuple(merging.merge_gauges(no_point, ["k"]).first()) == ("a", 1, 2.0, 2.0, 2.0, 2.0, NOON - timedelta(hours=1))
    spans = spark.createDataFrame([], "tenant_id string, service_name string, span_id string, start_time timestamp, duration_us long, status string")
    assert merging.service_nodes(spans, 60).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantile_by_selection(spark, q, monkeypatch):
    rng = random.Random(11)
    values = {"a": [rng.randrange(10**9) for _ in range(301)], "b": [5] * 40 + [7], "c": [-(2**63), 2**63 - 1, 0, None], "d": [None], "e": [rng.randrange(-50, 50) for _ in range(200)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    nth = lambda vs: sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] if vs else None
    want = {k: (len(s), nth(s)) for k, vs in values.items() for s in [[v for v in vs if v is not None]]}
    out = selection.exact_quantile(df, ["k"], "v", q)
    assert {r["k"]: (r["n"], r["quantile"]) for r in out.collect()} == want
    if q == 0.99:
        every = [v for vs in values.values() for v in vs if v is not None]
        assert tuple(selection.exact_quantile(df, [], "v", q).first()) == (len(every), nth(every))
        monkeypatch.setattr(selection, "PARTS", 4)
        assert {r["k"]: r["quantile"] for r in selection.exact_quantile(df.where("k <> 'c'"), ["k"], "v", q).collect()} == {k: v for k, (_, v) in want.items() if k != "c"}
        assert tuple(selection.exact_quantile(df.where("k = 'none'"), [], "v", q).first()) == (0, None) and selection.exact_quantile(df.where("k = 'none'"), ["k"], "v", q).count() == 0


def test_p99_of_fifty(spark):
    rows = [("t", "s", 1000 * (k + 1)) for k in range(50)] + [("u", "s", 10**7)]
    got = traffic.p99_exact(spark.createDataFrame(rows, "tenant_id string, service_name string, duration_us long"))
    assert {(r["tenant_id"], r["p99_us"]) for r in got.collect()} == {("t", 50_000), ("u", 10**7)}


def test_sweep_and_aliases_reach_any_length(spark):
    chain = [(k, k - 1 if k else None) for k in range(40)]  # 39 leads to 0
    ring = [(100, 101), (101, 102), (102, 100), (103, 100)]
    rows = spark.createDataFrame([*chain, *ring, (200, 999), (201, None)], "id long, alias_of long")
    final = dict(map(tuple, identity.resolve_aliases(rows).collect()))
    assert final == {k: 0 for k in range(40)} | {k: 100 for k in range(100, 104)} | {200: 999, 201: 201}
    refs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    left = lambda *r: {x["id"] for x in identity.sweep(rows, *r).collect()}
    every = {r["id"] for r in rows.collect()}
    assert left(refs(20), refs(101, None, 777)) == every - set(range(21)) - {100, 101, 102}
    assert left(refs(39, 103, 200)) == {201} and left(refs()) == every


def test_logs_of_a_span_and_of_a_trace_are_capped(spark):
    rows = [("t", "tr", f"s{k % 5}", k) for k in range(60)] + [("t", "one", "s", k) for k in range(10)] + [("u", "one", "s", 0)]
    marked = sampling.capped_logs(spark.createDataFrame(rows, "tenant_id string, trace_id string, span_id string, seq long"), ["seq"], 8, 30)
    kept, total, spans = [], 0, {}
    for k in range(60):  # one log after another
        if total < 30 and spans.get(k % 5, 0) < 8:
            kept.append(k)
            total, spans[k % 5] = total + 1, spans.get(k % 5, 0) + 1
    assert sorted(r["seq"] for r in marked.where("trace_id = 'tr' and dropped is null").collect()) == kept
    got = {(r["tenant_id"], r["trace_id"]): tuple(r)[2:] for r in sampling.truncation(marked).collect()}
    assert got == {("t", "tr"): (30, 0, 30, True), ("t", "one"): (8, 2, 0, True), ("u", "one"): (1, 0, 0, False)}
