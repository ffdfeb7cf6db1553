"""The registered queries themselves, on the smallest tables, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lumenspan.llm import ann, bpe, common, embdedup, langid, pii, quality
from lumenspan.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SPACE = "[^\x20\x09-\x0d]+"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
held = lambda i, n, k: zlib.crc32(str(i).encode()) % n == k


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name, *types):
    out = QUERIES[name](spark, SF)
    assert out.dtypes[: len(types)] == list(types)
    return out.collect()


def test_op1(spark, docs):
    words = {i: re.findall(SPACE, r["text"] or "") for i, r in docs.items()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    got = run(spark, "op1_substring_dedup", ("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string"))
    assert len(got) == len(docs)
    for r in got:
        w = words[r["doc_id"]]
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r["doc_id"] for j in range(50)}
        assert tuple(r)[1:] == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def _vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)


def test_op2(spark):
    ids, x = _vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert embdedup.lists(len(np.unique(x, axis=0)), len(ids)) > 1
    label = common.local_labels(len(ids), *np.nonzero(near))
    got = run(spark, "op2_embedding_near_dedup", ("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean"))
    assert sorted(map(tuple, got)) == [(int(i), int(near[k].sum() - 1), int(ids[label[k]]), bool(label[k] == k)) for k, i in enumerate(ids)]


def test_op4(spark, docs):
    ids = sorted(docs)
    prints = []
    for i in ids:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), docs[i]["text"] or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    p = np.array(prints, dtype=np.uint64)
    label = common.local_labels(len(p), *np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4))
    got = run(spark, "op4_simhash_near_dedup", ("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint"))
    assert sorted(map(tuple, got)) == [(i, f"{prints[k]:016x}", ids[label[k]]) for k, i in enumerate(ids)]


def test_op5(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in run(spark, "op5_quality_voting", ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int"))}
    assert set(got) == set(docs)
    # the same votes, one document after another
    from pyspark.sql import functions as F

    known = labels.where(~(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).select("doc_id", F.col("quality").alias("label"))
    m = quality.fit(known, spark.read.parquet(f"{SF}/documents.parquet"))
    for i, r in got.items():
        assert r["held_out"] == held(i, 3, 1) and r["predicted"] == (r["score"] >= 0.5)
        at, count = quality.features((docs[i]["text"] or "").encode())
        v = quality.weighted(at, count, m["idf"]) @ m["project"][at] if len(at) else np.zeros(1)
        if np.linalg.norm(v):
            cos = np.maximum(m["vectors"] @ (v / np.linalg.norm(v)), 0).astype(np.float64)
            near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
            w = cos[near] ** quality.SHARPNESS * m["weight"][near]
            assert abs(r["score"] - (w * m["label"][near]).sum() / w.sum()) < 0.02  # near ties may fall either way
        else:
            assert r["score"] == m["share"]
    asked = [i for i in truth if held(i, 3, 1)]
    assert np.mean([got[i]["predicted"] == truth[i] for i in asked]) > 0.8


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    got = run(spark, "op6_bpe_roundtrip", ("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert tuple(r)[1:4] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_op7(spark, docs):
    from tests.llm.test_operators import _base, _bootstrap

    want = defaultdict(list)
    for i, a, b in sorted(_bootstrap([(i, r["text"]) for i, r in docs.items()])):
        want[i].append(f"id:{a}:{b}")
    got = run(spark, "op7_pii_bootstrap", ("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in pii.KINDS], ("base_sha256", "string"), ("spans", "string"))
    assert len(got) == len(docs)
    for r in got:
        base = _base(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == sha(base) and r["spans"] == ",".join(filter(None, [base, *want[r["doc_id"]]])) and r["n_id"] == len(want[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(re.findall(rf"\b{k}:", base)) for k in pii.KINDS]


def test_op8(spark, docs):
    enc = bpe.encoder(vocabulary())
    ids = {i: np.append(enc.encode(r["text"] or ""), np.array([2], enc.dtype)) for i, r in docs.items()}
    got = run(spark, "op8_retrieval_packing", *[(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(x.astype("<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    gapless = lambda parts: all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    assert set(pieces) == set(docs) and all(gapless(p) and sum(n for _, n in p) == len(ids[i]) for i, p in pieces.items())
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    assert all(map(gapless, sequences.values())) and all(n == 4096 or n < 4096 and n & (n - 1) == 0 for n in sizes)


def test_op9(spark):
    ids, x = _vectors(spark)
    router, visits = ann.fit(x, len(x), 20)
    assert 1 < visits <= len(router.b) == ann.LEAST_PARTS
    got = defaultdict(list)
    for r in sorted(run(spark, "op9_ann_search", ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double"))):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = (x * x[k]).sum(1)
        s[k] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[int(ids[k])]
        assert [r for r, *_ in mine] == list(range(1, 21)) and all(abs(v - s[np.searchsorted(ids, i)]) < 1e-12 for _, i, v in mine)
        hits.append(len({i for _, i, _ in mine} & set(ids[best].tolist())) / 20)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9


def test_op10(spark, docs):
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.where(~(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).select("doc_id", "text", "lang"))
    names, rows = {g: i for (n, g), i in model["rows"].items() if not n}, model["rows"]
    got = run(spark, "op10_language_id", ("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"))
    assert len(got) == len(docs)
    right = []
    for r in got:
        d = docs[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"], 4, 2)
        total = np.zeros(len(model["languages"]))
        words = [w for w in re.findall(r"[^\W\d_]+", (d["text"] or "").lower()) if any(c.isalpha() for c in w)]
        for w in words:
            if w in names:
                total += model["table"][names[w]]
                continue
            for n in (4, 3, 2, 1):
                found = [i for g in langid.grams(w, n) if (i := rows.get((n, g)))]
                if found:
                    total += model["table"][found].mean(axis=0)
                    break
        if words:
            assert r["lang_pred"] == model["languages"][int(total.argmax())] and abs(r["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-3
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["held_out"] and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert np.mean(right) > 0.9


def test_op11(spark):
    ids, e = _vectors(spark)
    x = np.floor(e * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (x * n - s) / n
    v = c.T @ c / n
    values = np.linalg.eigvalsh(v)[::-1][:32]
    got = run(
        spark, "op11_embedding_whitening", ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")
    )
    place = {int(i): k for k, i in enumerate(ids)}
    w = np.zeros((n, 32))
    for r in got:
        w[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(int(a) ** 2 for a in x[place[r["vec_id"]]] * n - s)
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-9
    assert len(got) == n * 32
    # each component is c @ u / sqrt(e) of a unit eigenvector u
    u = np.linalg.lstsq(c, w * np.sqrt(values), rcond=None)[0]
    assert np.allclose(np.linalg.norm(u, axis=0), 1, atol=1e-8) and np.allclose(v @ u, u * values, atol=1e-6 * values[0])
    error = np.abs(w.T @ w / n - np.eye(32)).max()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9 and error < 1e-9


def _merkle(rows, fanout=16):
    """The manifest of (doc_id, source, lang, n_chars, text) rows, one node after another: (leaf, subroot, root, siblings, folded root) by row."""
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(frame(v) for v in (*r[:4], text)))
    first = lambda v: (v is not None, v if v is not None else 0)
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def climb(nodes):
        """The root, and for each node the steps (before, after) up to it."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k, p in enumerate(at):
                run = level[p // fanout * fanout : p // fanout * fanout + fanout]
                steps[k].append((run[: p % fanout], run[p % fanout + 1 :]))
            at = [p // fanout for p in at]
            level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        return level[0], steps

    order = sorted(range(len(rows)), key=lambda k: (first(rows[k][1]), first(rows[k][0]), leaf(rows[k], rows[k][4])))
    groups = [list(g) for _, g in itertools.groupby(order, key=lambda k: rows[k][1])]
    below = [climb([leaf(rows[k], rows[k][4]) for k in g]) for g in groups]
    root, above = climb([sub for sub, _ in below])
    out = {}
    for g, (sub, steps), top in zip(groups, below, above):
        for k, mine in zip(g, steps):
            tampered = rows[k][0] is not None and zlib.crc32(str(rows[k][0]).encode()) % 5 == 0
            node = leaf(rows[k], lower(rows[k][4]) if tampered else rows[k][4])
            for before, after in mine + top:
                node = sha("".join([*before, node, *after]))
            out[k] = (leaf(rows[k], rows[k][4]), sub, root, sha("".join(h for b, a in mine + top for h in b + a)), node)
    return out


def test_op12(spark, docs):
    ids = sorted(docs)
    want = _merkle([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in map(docs.get, ids)])
    got = run(spark, "op12_merkle_manifest", ("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean"))
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {i: (*want[k], want[k][4] == want[k][2]) for k, i in enumerate(ids)} and len(got) == len(ids)
    assert 0 < sum(not r["verified"] for r in got) < len(ids) / 3


def test_op13(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = run(spark, "op13_chat_parts", ("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint"))
    assert len(got) == len(turns)
    for r in got:
        t = sorted(turns[r["conv_id"]])
        learned = "".join(x for _, role, x in t if role == "assistant")
        assert tuple(r)[1:5] == (len(t), sha("".join(f"{role}\n{x}\n" for _, role, x in t)), len(learned), sha(learned))
        assert r["formatted_chars"] >= sum(len(role) + len(x) for _, role, x in t) + 20 * len(t)
