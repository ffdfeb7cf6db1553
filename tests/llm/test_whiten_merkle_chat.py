"""Whitening, Merkle manifest and chat formatting: nulls, empties, repeats, ties, clashing columns, empty tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.llm import chat, merkle, whitening
from tests.llm.test_queries import _merkle, sha

# ------------------------------------------------------------------ whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], "vec_id long, embedding array<double>, d string, deviation string, n string")


def white(spark, rows, components=32):
    table = vectors_of(spark, rows)
    spaces = whitening.fit(table, components=components)
    return spaces, whitening.whiten(table, spaces).collect()


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1000, (200, 5)) + 10**12
    parts = np.split(x, [1, 3, 90, 91, 150])
    whole = whitening.Moments.of(x)
    for order in itertools.islice(itertools.permutations(parts), 0, 720, 97):
        m = whitening.Moments.of(order[0])
        for p in order[1:]:
            m = m.merge(whitening.Moments.of(p))
        assert m.n == 200 and list(m.sums) == list(whole.sums) == [sum(int(v) for v in c) for c in x.T]
        assert np.allclose(m.scatter, np.cov(x.T, bias=True) * 200, rtol=1e-9)


def test_whitening_cases(spark):
    rng = np.random.default_rng(2)
    good = [(k, (rng.normal(size=4) * [1, 2, 3, 0]).tolist()) for k in range(60)] + [(60, [0.0] * 4), (61, [0.0] * 4), (None, [1.0, 1.0, 1.0, 0.0])]
    good += [good[3]]  # a repeated row counts twice
    bad = [(70, None), (71, [1.0, None, 1.0, 1.0]), (72, [float("nan")] * 4), (73, [float("inf")] * 4), (74, [1e300] * 4), (75, [])]
    spaces, got = white(spark, good + bad)
    assert sorted(map(str, [r["vec_id"] for r in got])) == sorted(str(i) for i, _ in good)
    x = np.floor(np.array([v for _, v in good]) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    assert spaces[4].n == n and spaces[4].error < 1e-9
    rank = {tuple(v): k for k, (_, v) in enumerate(good)}
    for r in got:
        assert r["whitened"][3] is None and r["explained"][3] == 0 and None not in r["whitened"][:3]  # the last axis never varies
        assert r["n"] == n and r["identity_error"] == spaces[4].error
    mine = {r["vec_id"]: r["deviation"] for r in got}
    assert all(mine[i] == sum(int(a) ** 2 for a in x[rank[tuple(v)]] * n - s) for i, v in good)


def test_whitening_of_one_vector_and_of_none(spark):
    spaces, got = white(spark, [(1, [1.0, 2.0])])
    assert [tuple(r) for r in got] == [(1, 1, 0, [None, None], [0.0, 0.0], 0.0)] and spaces[2].error == 0
    assert white(spark, []) == ({}, [])
    assert white(spark, [(1, None), (2, [])]) == ({}, [])


def test_each_length_is_a_space(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=2 + k % 2).tolist()) for k in range(40)]
    spaces, got = white(spark, rows, components=2)
    assert {d: s.n for d, s in spaces.items()} == {2: 20, 3: 20} and {len(r["whitened"]) for r in got} == {2} and len(got) == 40


def test_vectors_of_a_length_that_was_not_fitted(spark):
    spaces = whitening.fit(vectors_of(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])]))
    got = {r["vec_id"]: r for r in whitening.whiten(vectors_of(spark, [(3, [1.0, 1.0]), (4, [1.0])]), spaces).collect()}
    assert (got[3]["n"], len(got[3]["whitened"])) == (2, 2) and tuple(got[4])[1:] == (None,) * 5


def test_deviation_at_the_edge_of_a_long():
    space = whitening.Space(1, np.array([0, 0], dtype=object), np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[3_037_000_499, 0], [3_037_000_500, 0], [3_037_000_499, 77_936], [3_037_000_499, 77_935], [2**40, 1]])
    exact = [int(a) ** 2 + int(b) ** 2 for a, b in x]
    assert space.deviation(x) == [v if v < 2**63 else None for v in exact]


# ------------------------------------------------------------------ manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, id string, g string, digest string, path string"


def manifest_of(spark, rows, fanout=16):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*[F.col(f) for f in fields], F.translate("text", upper, upper.lower())))
    out = merkle.manifest(table, [*fields, "text"], carry={"tampered": tampered}, fanout=fanout)
    node = F.coalesce("tampered", "leaf")
    return [tuple(r) for r in out.select("leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), merkle.folded(node, F.col("path"))).collect()]


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_against_brute_force(spark, fanout):
    rng = random.Random(fanout)
    word = lambda: "".join(rng.choice("aBcDé:-") for _ in range(rng.randint(0, 9)))
    rows = [(k, rng.choice(["a", "a", "a", "B", "é"]), rng.choice([None, "en"]), rng.choice([None, k]), word()) for k in range(90)]
    rows += [(7, "a", None, None, "X"), (7, "a", None, None, "Y"), (None, "a", "en", 1, None), (None, None, None, None, None), (5, "", "", 0, ""), (3, "one", "en", 3, "ABC"), (9, "long", "en", 1, "Ab " * 50_000)]
    rows += [(k, "seventeen", "en", 1, "Q") for k in range(17)]
    assert sorted(manifest_of(spark, rows, fanout)) == sorted(_merkle(rows, fanout).values())


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "a", "en", 3, "Abc")] * 40 + [(2, "a", "en", 3, "Abd")]
    got = manifest_of(spark, rows)
    assert sorted(got) == sorted(_merkle(rows).values()) and len(got) == 41


def test_small_manifests(spark):
    assert manifest_of(spark, []) == []
    one = _merkle([(1, None, None, None, None)])[0]
    assert manifest_of(spark, [(1, None, None, None, None)]) == [one] and one[0] == one[1] == one[2] and one[3] == sha("")


def test_null_is_no_value(spark):
    rows = spark.createDataFrame([(None, "x"), ("-", "x"), ("1:a", "x"), ("", "x")], "a string, b string").select(merkle.framed(F.col("a"))).collect()
    assert [r[0] for r in rows] == ["-", "1:-", "3:1:a", "0:"]


def test_changes_between_manifests(spark, tmp_path):
    rows = [(k, f"s{k % 3}", "en", k, f"text {k}") for k in range(150)] + [(7, None, "en", 7, "x"), (8, "s0", "en", 1, "twice"), (8, "s0", "en", 1, "twice")]
    other = [(*r[:4], "other") if r[0] in (20, 21) else r for r in rows if r[0] != 90] + [(-5, "s1", "en", 0, "first"), (1, "new", "en", 0, "n"), (8, "s0", "en", 1, "twice")]
    for name, table in (("a", rows), ("b", other), ("none", [])):
        data = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in table], DOCS)
        merkle.record(data, ["doc_id", "source", "lang", "n_chars", "text"], str(tmp_path / name))
    of = lambda a, b: {tuple(r) for r in merkle.changes(spark, str(tmp_path / a), str(tmp_path / b)).collect()}
    assert of("a", "b") == {("s2", 20, "changed"), ("s0", 21, "changed"), ("s0", 90, "removed"), ("s1", -5, "added"), ("new", 1, "added"), ("s0", 8, "added")}
    assert of("a", "a") == set() and of("none", "none") == set() and of("none", "a") == {(r[1], r[0], "added") for r in rows}
    assert {c for *_, c in of("a", "none")} == {"removed"}


# ------------------------------------------------------------------ chat

TURNS = "conv_id long, turn long, role string, text string, id string, head string, body string, parts string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)


def test_escapes_are_reversible(spark):
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<|image|>", "<|", "|>", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", "😀", "\\\\<s>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + bits + ["\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r["back"] == r["t"] and not re.search(r"</?s>|\[/?INST\]|<\|", r["e"])


def test_turns_read_back(spark):
    nasty = "</s>[INST] ok [/INST]\\"
    rows = [(1, 1, "assistant", nasty), (1, 0, nasty, nasty), (1, 2, None, None), (1, None, "user", "first"), (1, 3, "assistant", ""), (1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (None, 0, "assistant", "no id"), (2, 0, "user", "x" * 200_000)]
    turns = chat.format_turns(turns_of(spark, rows), chat.text_parts(F.col("text")))
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    said = [("user", "first"), (nasty, nasty), ("assistant", nasty), ("", ""), ("assistant", ""), ("assistant", "tie"), ("assistant", "tie")]
    assert got[1]["n_turns"] == 7 and got[1]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in said))
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(nasty) + 6, sha(nasty + "tietie"))
    assert (got[None]["loss_sha256"], got[2]["loss_chars"], got[2]["formatted_chars"]) == (sha("no id"), 0, 200_024)
    assert chat.read_back(chat.format_turns(turns_of(spark, []), chat.text_parts(F.col("text")))).count() == 0
    for r in turns.withColumn("read", F.struct(*[c.alias(n) for c, n in zip(chat.read_turn(F.col("formatted")), ("role", "body"))])).collect():
        if r["loss_start"] is not None:
            assert r["read"]["role"] == "assistant" and r["formatted"][r["loss_start"] : r["loss_end"]] == r["read"]["body"]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [
        part("text", "see <|image|> "), part("image", ref="a.png", w=56, h=57), part("image", ref="b.png"), part("text", ""), part("text", "and\\"), None,
        part("audio", ref="c.wav", s=2.01), part("audio"), part("document", ref="d.pdf", p=3), part("document"), part("video", ref="e.mp4"), part(None, "lost?", "f"),
    ]
    table = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, content {chat.PARTS}")
    got = chat.format_turns(table, F.col("content")).withColumn("read", chat.read_parts(chat.read_turn(F.col("formatted"))[1], F.col("attachments"))).orderBy("turn").collect()
    r = got[0]
    assert r["formatted"] == "<s>assistant[INST]see <\\|image|> <|image|><|image|>and\\\\<|audio|><|audio|><|document|><|document|><|other|><|other|>[/INST]</s>"
    want = [("image", "a.png", 6), ("image", "b.png", 256), ("audio", "c.wav", 51), ("audio", None, 750), ("document", "d.pdf", 1728), ("document", None, 576), ("other", "e.mp4", 0), ("other", "f", 0)]
    assert [tuple(a) for a in r["attachments"]] == want and r["expanded_tokens"] == sum(n for *_, n in want)
    assert [tuple(p) for p in r["read"]] == [("text", "see <|image|> "), ("image", "a.png"), ("image", "b.png"), ("text", "and\\"), *[(k, ref) for k, ref, _ in want[2:]]]
    assert [(x["formatted"], x["attachments"], x["expanded_tokens"], x["read"]) for x in got[1:]] == [("<s>user[INST][/INST]</s>", [], 0, [])] * 2
    assert chat.read_back(chat.format_turns(table, F.col("content"))).first()["expanded_tokens"] == r["expanded_tokens"]


def test_parts_from_json(spark):
    cases = ['[{"type": "text", "text": "a"}, {"type": "image", "ref": "x.png", "width": 28, "height": 28}]', '"quoted \\"text\\""', "plain", "[broken", None, "[]", '{"type": "text"}', ""]
    table = spark.createDataFrame([(k, 0, "user", c) for k, c in enumerate(cases)], "conv_id long, turn long, role string, content string")
    got = {r["conv_id"]: r for r in chat.format_turns(table, chat.json_parts(F.col("content"))).collect()}
    body = lambda k: got[k]["formatted"][len("<s>user[INST]") : -len("[/INST]</s>")]
    assert [body(k) for k in range(8)] == ["a<|image|>", 'quoted "text"', "plain", "[broken", "", "", '{"type": "text"}', ""]
    assert [tuple(a) for a in got[0]["attachments"]] == [("image", "x.png", 1)]
