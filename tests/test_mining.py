"""Mining in leaves and blocks against one plain miner that takes line after line."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenspan.functions import scalars as S
from lumenspan.operators import mining
from lumenspan.sources import telemetry

NOON = datetime(2026, 6, 1, 12)
LOGS = "tenant_id string, service_name string, timestamp timestamp, log_id long, body string"


class Plain:
    """One scope's miner: a tree of nodes that know 100 words each, templates in leaves, equal texts folded within a leaf."""

    def __init__(self, most, children=100):
        self.most, self.children, self.kids, self.leaves, self.made = most, children, {}, {}, 0

    def mine(self, words):
        path = (len(words),)
        for w in words[:4]:
            kids = self.kids.setdefault(path, [])
            if w not in kids:
                if len(kids) < self.children:
                    kids.append(w)
                else:
                    w = "<*>"
            path += (w,)
        leaf = self.leaves.setdefault(path, [])
        like = lambda t: sum(a in (b, "<*>") for a, b in zip(t["words"], words)) / len(words)
        best = max((t for t in leaf if not t.get("heir")), key=like, default=None)
        if best is not None and like(best) >= 0.4:
            best["words"] = [a if a == b else "<*>" for a, b in zip(best["words"], words)]
            twin = next((t for t in leaf if t is not best and not t.get("heir") and t["words"] == best["words"]), None)
            if twin:
                old, young = sorted((best, twin), key=lambda t: t["at"])
                young["heir"] = old
                return old
            return best
        if self.most is not None and self.made >= self.most:
            return None
        self.made += 1
        leaf.append({"words": list(words), "at": self.made})
        return leaf[-1]


def plain(rows, most, children=100):
    """{(scope, template): n} of (scope, order, words) rows, each distinct line mined once."""
    miners, lines, counts = {}, {}, Counter()
    for scope, _, words in sorted(rows, key=lambda r: r[1]):
        if words and (scope, words) not in lines:
            lines[scope, words] = miners.setdefault(scope, Plain(most, children)).mine(words)
    for scope, _, words in rows:
        if words or most is not None:  # what has no word counts, but for a miner of any number of templates
            t = lines.get((scope, words))
            while t and t.get("heir"):
                t = t["heir"]
            counts[scope, " ".join(t["words"]) if t else "__other__"] += 1
    return dict(counts)


def masked(df, scope):
    rows = df.select(*scope, "timestamp", "log_id", S.mask_tokens(F.coalesce("body", F.lit(""))).alias("w")).collect()
    return [(tuple(r[c] for c in scope), (r["timestamp"], r["log_id"]), tuple(r["w"])) for r in rows]


def got_of(df, scope):
    return {(tuple(r[c] for c in scope), r["template"]): r["n"] for r in df.collect()}


@pytest.fixture(scope="module")
def random_logs(spark):
    rng = random.Random(8)
    verbs, things = [f"v{chr(97 + k)}" for k in range(6)], [f"t{chr(97 + k)}{chr(97 + k // 3)}" for k in range(20)]
    rows = []
    for k in range(900):
        body = " ".join([rng.choice(verbs), rng.choice(["is", "was"]), "the", rng.choice("ab"), *[rng.choice(things) for _ in range(rng.randint(0, 4))]])
        rows.append(("a" if k % 3 else "b", f"s{k % 2}", NOON + timedelta(seconds=k // 2), k, rng.choice([body, body, body, "", None]) if k % 10 == 0 else body))
    return spark.createDataFrame(rows, LOGS).repartition(3)


@pytest.mark.parametrize("scope, most", [(["tenant_id", "service_name"], 10), (["tenant_id"], None)])
def test_mining_equals_one_plain_miner(spark, random_logs, scope, most):
    want = plain(masked(random_logs, scope), most)
    assert got_of(mining.mine_templates(random_logs, scope, most), scope) == want and len(want) > 12
    assert any("<*>" in t for _, t in want) and (most is None or any(t == "__other__" for _, t in want))


def test_results_do_not_hang_on_partitions(spark, random_logs):
    scope, sets = ["tenant_id"], []
    for n in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sets.append(got_of(mining.mine_templates(random_logs.repartition(int(n)), scope, None), scope))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sets[0] == sets[1]


def test_nodes_know_so_many_words(spark, monkeypatch):
    monkeypatch.setattr(mining, "CHILDREN", 3)
    rows = [("t", "s", NOON + timedelta(seconds=k), k, f"w{chr(97 + k % 9)} x y z end{chr(97 + k % 4)} tail") for k in range(40)]
    logs = spark.createDataFrame(rows, LOGS)
    want = plain(masked(logs, ["tenant_id"]), None, children=3)
    assert got_of(mining.mine_templates(logs, ["tenant_id"], None), ["tenant_id"]) == want and ("<*> x y z <*> tail" in {t for _, t in want})


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_the_last_that_fits_is_found_in_first_lines(spark, random_logs, monkeypatch, first):
    """How many lines are looked at first changes nothing, and no more of them are mined without a cap than that takes."""
    monkeypatch.setattr(mining, "FIRST", first)
    want = plain(masked(random_logs, ["tenant_id"]), 3)
    assert got_of(mining.mine_templates(random_logs, ["tenant_id"], 3), ["tenant_id"]) == want
    seen, whole = [], mining._mine
    monkeypatch.setattr(mining, "_mine", lambda lines, *rest: seen.append(lines.count()) or whole(lines, *rest))
    mining.mine_templates(random_logs, ["tenant_id"], 1)
    assert seen[0] <= first * random_logs.select("tenant_id").distinct().count()


def test_a_leaf_keeps_no_words_of_lines_that_make_nothing():
    leaf = mining.Leaf(4)
    for k in range(100):
        leaf.take(["a", "b", "c", f"x{k}"], (k, k), k, 1)
    assert len(leaf.words) == 5 and [w for w, *_ in leaf.results()] == [["a", "b", "c", "<*>"]]


def test_blocks_are_merged(spark, random_logs, monkeypatch):
    whole = mining.mine(random_logs, ["tenant_id"], None)
    monkeypatch.setattr(mining, "CHUNK", 5)
    parts = mining.mine(random_logs, ["tenant_id"], None)
    n = lambda m: m.lines.agg(F.sum("n"), F.count("made_at"), F.count(F.lit(1))).first()
    assert n(whole) == n(parts)  # no line is lost, each has a template
    known = {tuple(r) for r in parts.templates.select("tenant_id", "made_at", "made_log").collect()}
    for r in parts.lines.collect():
        assert (r["tenant_id"], r["made_at"], r["made_log"]) in known
    # each line fits the text that it was mined to
    text = {(r["tenant_id"], r["made_at"], r["made_log"]): r["template"].split(" ") for r in mining.texts(parts, ["tenant_id"]).collect()}
    lines = {(t, " ".join(w)): w for (t,), _, w in masked(random_logs, ["tenant_id"])}
    import hashlib

    by_key = {(t, hashlib.md5(s.encode()).hexdigest()): w for (t, s), w in lines.items()}
    for r in parts.lines.collect():
        words = by_key[r["tenant_id"], r["line"]]
        assert all(a in ("<*>", b) for a, b in zip(text[r["tenant_id"], r["made_at"], r["made_log"]], words))


def test_a_stopped_run_equals_an_unbroken_one(spark, tmp_path):
    rng = random.Random(4)
    bodies = list(dict.fromkeys(" ".join([rng.choice(["get", "put"]), "the", "key", "of", *[rng.choice(["qa", "qb", "qc", "qd"]) for _ in range(4)]]) for _ in range(150)))
    logs = spark.createDataFrame([("t", "s", NOON + timedelta(seconds=k), k, b) for k, b in enumerate(bodies)], LOGS)
    scope, cut = ["tenant_id"], len(bodies) // 2
    want = {(r["made_at"], r["made_log"], r["template"]) for r in mining.texts(mining.mine(logs, scope, None), scope).collect()}
    mining.save(mining.mine(logs.where(F.col("log_id") < cut), scope, None), str(tmp_path), scope)
    resumed = mining.mine(logs.where(F.col("log_id") >= cut), scope, None, state=mining.load(spark, str(tmp_path), scope))
    assert {(r["made_at"], r["made_log"], r["template"]) for r in mining.texts(resumed, scope).collect()} == want
    assert resumed.templates.where("alias_at is null").agg(F.sum("n")).first()[0] == len(bodies)


def test_templates_that_widen_to_one_text_are_aliases(spark):
    bodies = ["a b c d p q r s t u", "a b c d p q v w x y", "a b c d k l m n o j", "a b c d k l f g h i", "a b c d z z z z z z"]
    logs = spark.createDataFrame([("t", "s", NOON + timedelta(seconds=k), k, b) for k, b in enumerate(bodies)], LOGS)
    assert got_of(mining.mine_templates(logs, ["tenant_id"], None), ["tenant_id"]) == plain(masked(logs, ["tenant_id"]), None)
    leaf = mining.Leaf(5)
    leaf.add(["a", "b", "<*>", "c", "<*>"], (0, 0), 9, 3)
    leaf.add(["a", "b", "x", "c", "e"], (1, 1), 1, 2)
    assert leaf._widen(1, leaf._row(["a", "b", "y", "c", "d"])) == 0
    assert [(r[1], r[2], r[3], r[4]) for r in leaf.results()] == [((0, 0), 9, 5, (None, None)), ((1, 1), 1, 0, (0, 0))]
    long = spark.createDataFrame([("t", k, k, max(0, k - 1) if k else None, max(0, k - 1) if k else None) for k in range(40)], "tenant_id string, made_at long, made_log long, alias_at long, alias_log long")
    assert {(r["final_at"], r["final_log"]) for r in mining.aliases(long, ["tenant_id"]).collect()} == {(0, 0)}


@pytest.mark.parametrize("scope, most", [(["tenant_id", "service_name"], 10), (["tenant_id"], None)])
def test_mining_of_the_given_table(spark, scope, most):
    logs = telemetry.document_logs(spark, "/root/testdata/sf0.001")
    want = plain(masked(logs, scope), most)
    assert got_of(mining.mine_templates(logs, scope, most), scope) == want


def test_empty(spark):
    none = spark.createDataFrame([], LOGS)
    assert mining.mine_templates(none).count() == 0
    wordless = spark.createDataFrame([("t", "s", NOON, 1, None), ("t", "s", NOON, 2, "  ")], LOGS)
    assert [(r["template"], r["n"]) for r in mining.mine_templates(wordless).collect()] == [(mining.OTHER, 2)] and mining.mine_templates(wordless, ["tenant_id"], None).count() == 0
    assert [r["template"] for r in mining.with_template(wordless).collect()] == [mining.OTHER, mining.OTHER]


def test_registered_queries(spark):
    """The five queries that no SQL can say, on the whole smallest table."""
    from lumenspan.plans import merged, more, served  # noqa: F401  they add to the catalogue
    from lumenspan.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    logs, service = telemetry.document_logs(spark, sf), ["tenant_id", "service_name"]
    by_service, by_tenant = plain(masked(logs, service), 10), plain(masked(logs, ["tenant_id"]), None)
    assert got_of(QUERIES["template_mine"](spark, sf), service) == by_service
    tenants = QUERIES["tenant_templates"](spark, sf).collect()
    assert {((r["tenant_id"],), r["template"]): r["n"] for r in tenants} == by_tenant
    assert all(sum(r["live"] for r in tenants if r["tenant_id"] == t) == min(200, sum(r["tenant_id"] == t for r in tenants)) for t in ("default", "tenant-b"))
    clusters = QUERIES["log_clusters"](spark, sf).where("template is not null").collect()
    assert {((r["tenant_id"], r["service_name"]), r["template"]): r["n"] for r in clusters} == by_service
    series = Counter()
    for r in QUERIES["template_series"](spark, sf).where("template is not null").collect():
        series[(r["tenant_id"], r["service_name"]), r["template"]] += r["n"]
    assert dict(series) == by_service
    edges = QUERIES["emitted_by"](spark, sf).where("source is not null").collect()
    assert {(r["source"], r["target"]) for r in edges} == {(r["cluster_id"], r["service_name"]) for r in clusters} and {r["type"] for r in edges} == {"EMITTED_BY"}
    # clusters of services with late errors, over the same lines under other names
    errors = telemetry.event_spans(spark, sf).where("status = 'STATUS_CODE_ERROR' and start_time > '2024-01-29'").select("tenant_id", "service_name").distinct().collect()
    renamed = logs.withColumn("service_name", F.concat(F.lit("svc-"), (F.col("log_id") % 8).cast("string")))
    lines = masked(renamed, service)
    got = got_of(QUERIES["correlated_clusters"](spark, sf), service)
    assert got and got.items() <= plain(lines, 10).items() and {s for s, _ in got} <= {tuple(e) for e in errors}


class Whole(Plain):
    """A plain miner that takes lines under none of its templates on to templates of their own, in the same leaves."""

    def __init__(self, most):
        super().__init__(most)
        self.others = Plain(None)
        self.others.kids = self.kids

    def mine(self, words):
        t = super().mine(words)
        return (t, False) if t else (self.others.mine(words), True)


def whole(rows, most):
    """{(scope, template, rest): lines}, where ``__other__`` is told by its own templates."""
    miners, lines, counts = {}, {}, Counter()
    for scope, _, words in sorted(rows, key=lambda r: r[1]):
        if words and (scope, words) not in lines:
            lines[scope, words] = miners.setdefault(scope, Whole(most)).mine(words)
    for scope, _, words in rows:
        t, beyond = lines.get((scope, words), (None, False))
        while t and t.get("heir"):
            t = t["heir"]
        text = " ".join(t["words"]) if t else None
        counts[(scope, "__other__", text) if beyond or t is None else (scope, text, None)] += 1
    return dict(counts)


@pytest.mark.parametrize("scope, most", [(["tenant_id", "service_name"], 10), (["tenant_id"], 3)])
def test_logs_and_clusters_beyond_the_cap_have_templates_of_their_own(spark, random_logs, scope, most):
    from lumenspan.operators import logs as L
    from lumenspan.operators import serving

    want = whole(masked(random_logs, scope), most)
    assert len({t for _, x, t in want if x == "__other__" and t}) > 5 and None in {t for _, x, t in want if x == "__other__"}
    mined = mining.with_template(random_logs, scope, most).withColumn("severity", F.lit("INFO"))
    assert Counter((tuple(r[c] for c in scope), r["template"], r["rest"]) for r in mined.collect()) == want
    if scope == ["tenant_id", "service_name"]:
        found = L.clusters(mined).collect()
        assert {((r["tenant_id"], r["service_name"]), r["template"], r["rest"]): r["lines"] for r in found} == want and len({r["cluster_id"] for r in found}) >= len({(k[0][1], *k[1:]) for k in want})
        assert {((r["tenant_id"], r["service_name"]), r["template"]): r["n"] for r in found} == plain(masked(random_logs, scope), most)
        series = Counter()
        for r in serving.template_deltas(mined).collect():
            series[(r["tenant_id"], r["service_name"]), r["template"], r["rest"]] += r["n"]
        assert series == want


def test_templates_beyond_the_cap_are_counted_too(spark, random_logs):
    scope = ["tenant_id", "service_name"]
    rows = masked(random_logs, scope)
    got = mining.mine_templates(random_logs, scope, 5).collect()
    assert {(tuple(r[c] for c in scope), r["template"], r["rest"]): r["lines"] for r in got} == whole(rows, 5) and sum(r["lines"] for r in got) == len(rows)
    assert {(tuple(r[c] for c in scope), r["template"]): r["n"] for r in got} == plain(rows, 5) and sum(r["rest"] is not None for r in got) > 20


@pytest.mark.parametrize("first", [3, 1000])
def test_long_leaves_with_a_cap_equal_one_plain_miner(spark, random_logs, monkeypatch, first):
    """A leaf of over ``CHUNK`` lines has no block of its own mind: lines find the templates that others made."""
    monkeypatch.setattr(mining, "CHUNK", 5)
    monkeypatch.setattr(mining, "FIRST", first)
    rows = masked(random_logs, ["tenant_id"])
    got = mining.mined_lines(random_logs, ["tenant_id"], 6).groupBy("tenant_id", "template").agg(F.sum("n").alias("n"))
    assert got_of(got, ["tenant_id"]) == plain(rows, 6)
    assert mining.mined_lines(random_logs, ["tenant_id"], 6).where("template = '__other__' and rest is null").agg(F.sum("n")).first()[0] == sum(not w for _, _, w in rows)
