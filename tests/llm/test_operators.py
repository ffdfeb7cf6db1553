"""The ten operators against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenspan.llm import ann, bpe, common, embdedup, langid, licenses, packing, pii, quality, simhash, substring
from lumenspan.llm.queries import vocabulary

DOCS = "doc_id long, text string, block string, kept string, n_words string, predicted string, at string"


def docs_of(spark, rows):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 160))]
        if i % 3 == 0:
            cut = rng.randint(0, 30)
            w[5:5] = passage[cut : cut + rng.randint(45, 60)]
        rows.append((i, " ".join(w)))
    rows += [(n, rows[1][1]), (n + 1, rows[1][1].upper()), (n + 2, None), (n + 3, ""), (n + 4, " \t\n"), (n + 5, "one"), (n + 6, "long " * 30_000)]
    rows += [rows[4], rows[4]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_substring(spark, texts):
    got = defaultdict(list)
    for r in substring.remove_repeats(docs_of(spark, texts), 50, 16, carry=("doc_id", "block", "kept", "n_words")).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept"]))
        assert tuple(r["carried"]) == (r["doc_id"], "x", "x", "x")
    words = [(i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    removed = 0
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        removed += sum(gone)
        want = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
        assert want in got[i]
    assert removed > 0 and sum(map(len, got.values())) == len(texts)


def test_simhash(spark, texts):
    rng = random.Random(2)
    near = [(1000 + k, " ".join(w if rng.random() > 0.01 else "zz" for w in (texts[7][1] + " " + texts[8][1]).split())) for k in range(12)]
    rows = texts + near

    def fp(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fp(t)) for i, t in rows if len(t or "") < 10_000]
    got = {(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, [r for r in rows if len(r[1] or "") < 10_000])).collect()}
    a, b = zip(*[(x, y) for x in range(len(prints)) for y in range(x) if (prints[x][1] ^ prints[y][1]).bit_count() <= 4])
    order = sorted(range(len(prints)), key=lambda k: prints[k][0])
    place = {k: p for p, k in enumerate(order)}
    label = common.local_labels(len(prints), np.array([place[x] for x in a]), np.array([place[y] for y in b]))
    assert got == {(i, f, prints[order[label[place[k]]]][0]) for k, (i, f) in enumerate(prints)}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 5])
def test_links_at_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**62, 60, dtype=np.uint64)
    bits = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.choice(62, n, replace=False).astype(np.uint64)) if n else np.uint64(0)
    fps = np.unique(np.concatenate([base, np.array([0, 31], np.uint64), *[[b ^ bits(k) for b in base[:20]] for k in range(8)]]))
    rows = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = simhash.fingerprint_links(rows, len(fps), radius).collect()
    place = {int(x): i for i, x in enumerate(fps)}
    a, b = (np.array([place[r[c]] for r in links], dtype=np.int64) for c in "ab")
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    assert np.array_equal(common.local_labels(len(fps), a, b), common.local_labels(len(fps), near[:, 0], near[:, 1]))


def test_ball_collisions_in_small_steps(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(5)]))
    whole = simhash.ball_collisions(fps, 0, 0, 4)
    monkeypatch.setattr(simhash, "STEP_VARIANTS", 20_000)
    parts = simhash.ball_collisions(fps, 0, 0, 4)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = common.local_labels(len(fps), near[:, 0], near[:, 1])
    for a, b in (whole, parts):
        assert np.array_equal(common.local_labels(len(fps), a, b), want)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + k, 501 + k) for k in range(60)] + [(3, 3)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    a, b = map(np.array, zip(*edges))
    label = common.local_labels(600, a, b)
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: int(label[x]) for x in used}


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    rng = random.Random(1)
    parts = [*"abcDE fghü é'st'RE 12 ½ 漢字 ß İ Σς ﬁ \t\n\x1c\x85\xa0 ́ ̈ 😀👩‍👩 @#$%  ’ ", "<|endoftext|>", "<|startoftext|>", "é", "ΟΔΟΣ", "don't", "I'LL", "ẛ̣"]
    rows = [r for r in texts if len(r[1] or "") < 10_000] + [(5000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(1500)]
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs_of(spark, rows), vocabulary()), vocabulary()).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["text"] == lib.decode(ids, skip_special_tokens=False)


def test_forced_cuts():
    enc = bpe.encoder(vocabulary())
    names = [t.removesuffix("</w>") for t in enc.tokens]
    for word in ("qzxjvq", "abzqx"):
        parts = enc.cut(word)
        assert "".join(parts) == word
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1] + b[0] in t for t in names)


def test_plain_words_are_cut_as_columns(monkeypatch):
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(vocabulary()), bpe.Encoder(vocabulary())
    rng = random.Random(5)
    parts = [*"aZéÀÖØÞßöøÿ09!~<>|'#-  ", "'ll", "'RE", "'s", "the", "ção", "×", "÷", "qzxjvq", "<|endoftext|>", "\x85", "\xa0", "e\u0301"]
    texts = [None, "", " \n", "#", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    ends, ids = enc.encode_column(pa.array(["x", *texts])[1:])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    words = []
    monkeypatch.setattr(enc, "word", words.append)  # what takes words one at a time
    assert enc.encode("The house, l'été: Don't! (42) qzxjvq").tolist() == lib.encode("The house, l'été: Don't! (42) qzxjvq", add_special_tokens=False).ids
    assert words == []


def test_packing_counts_frequencies_while_it_encodes(spark, texts):
    enc = bpe.encoder(vocabulary())
    holding_end = next(t for t in ("#" + chr(c) for c in range(33, 127)) if 2 in enc.encode(t))
    rows = [*texts, (9000, holding_end), (9001, None), (None, "no id")]
    table = packing.encoded(docs_of(spark, rows).repartition(3), vocabulary(), 2).cache()
    want, docs = defaultdict(int), {}
    for i, t in rows:
        if i is not None:
            docs[i] = np.append(enc.encode(t or ""), np.array([2], enc.dtype))
            for token in set(docs[i].tolist()):
                want[token] += 1
    assert {r["token"]: r["df"] for r in packing.document_frequencies(table).collect()} == want
    rank = packing._ranking(len(enc.tokens))
    got = table.where("doc_id is not null").collect()
    assert len(got) == len(rows) - 1  # repeated rows, too
    for r in got:
        x = docs[r["doc_id"]]
        assert np.array_equal(packing._plain(bytes(r["ids"]), enc.dtype), x) and r["n_tokens"] == len(x) and r["df"] is None
        assert r["key"] == (rank[x[:-1]].min() if len(x) > 1 else 0)


def test_packing(spark, texts):
    rows = packing.pack(docs_of(spark, texts), vocabulary(), 256, 2).collect()
    enc = bpe.encoder(vocabulary())
    ids = {i: np.append(enc.encode(t or ""), np.array([2], enc.dtype)) for i, t in texts}
    sequences, total = defaultdict(list), 0
    for r in rows:
        x = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] and zlib.crc32(x.astype("<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(ids[i]) for i, _ in texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0


def test_packing_prefers_lexical_neighbours():
    idf = np.ones(100, np.float32)
    ids = [np.array(x, np.uint16) for x in ([1, 2, 3], [50, 51, 52], [1, 2, 9], [60, 61, 62])]
    pieces = list(packing.Shard(ids, idf, 3.0).pack(8))
    first = [d for s, d, *_ in pieces if s == 0]
    assert first[:2] == [0, 2]


def test_packing_scores_all_tokens_of_a_seed():
    idf = np.full(60, 1.0, np.float32)
    idf[24:40] = 0.9
    ids = [np.arange(40), np.array([0, *range(41, 56)]), np.arange(24, 40)]  # the last shares sixteen tokens lighter than the first 24
    shard = packing.Shard(ids, idf, 20.0)
    shard.done[0] = 40
    assert list(shard.neighbours(0)) == [2, 1]
    rng = np.random.default_rng(3)
    ids = [rng.zipf(1.3, rng.integers(1, 300)) % 500 for _ in range(80)]
    idf = rng.random(500).astype(np.float32)
    average = float(np.mean([len(x) for x in ids]))
    shard = packing.Shard(ids, idf, average)
    for seed in range(80):
        want = [sum(idf[t] * 2.2 * c / (c + 1.2 * (0.25 + 0.75 * len(x) / average)) for t in np.unique(ids[seed]) if (c := (x == t).sum())) for x in ids]
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)


def test_language(spark):
    words = {"en": ["the", "house", "water", "think"], "de": ["das", "haus", "wasser", "denken"], "fr": ["la", "maison", "eau", "penser"]}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(sorted(words) * 30)]
    model = langid.fit(spark.createDataFrame(rows + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string"))
    asked = [(1, "the house"), (2, "hauser wasserdenk"), (3, "maisons eaux pensera"), (4, None), (5, ""), (6, "12 ½ ²!"), (7, "THE WATER " * 50_000), (8, "漢字")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(spark, asked), model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert got[8][0] in words and all(0 <= s <= 1 for _, s in got.values())
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(docs_of(spark, asked), empty).where("lang_pred <> 'und'").count() == 0


def test_language_of_texts_without_letters(spark):
    rows = [(i, "½ ½ haus", "de") for i in range(8)] + [(20 + i, "house ² ٣", "en") for i in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(spark, [(1, "½"), (2, "² ½ ½"), (3, "½ haus")]), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "de"
    with pytest.raises(ValueError):
        langid.annotate(docs_of(spark, []), model)


def test_language_with_a_full_cache(spark, monkeypatch):
    words = {"en": ["the", "house", "water", "think"], "de": ["das", "haus", "wasser", "denken"]}
    rng = random.Random(4)
    model = langid.fit(spark.createDataFrame([(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(sorted(words) * 30)], "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice(words[rng.choice(sorted(words))]) + rng.choice("abcde") + rng.choice("xyz") for _ in range(n)) for n in (3, 7, 9, 40, 5, 120)]
    want = [langid.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(langid, "UNKNOWN_WORDS", 10)
    monkeypatch.setattr(langid, "CHUNK_WORDS", 7, raising=False)
    small = langid.Scorer(model)
    for t, (lang, score) in zip(texts, want):
        got = small.predict(t)
        assert got[0] == lang and abs(got[1] - score) < 1e-6


def test_quality(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(200):
        w = [word() for _ in range(60)]
        rows.append((i, " ".join(w) if i % 4 else "!! ".join(x.upper() for x in w)))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(120)] + [(7, None), (None, 1)], "doc_id long, label int")
    docs = docs_of(spark, rows + [(500, None), (501, "")])
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(labels, docs)).collect()}
    assert all((got[i] >= 0.5) == (i % 4 != 0) for i in range(120, 200)) and 0 <= got[500] == got[501] <= 1
    none = quality.fit(labels.where("label = 9"), docs)
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _holds(k, m[0]))


def test_pii_base(spark):
    rng = random.Random(3)
    parts = [*"a1@.-+ ()%_é😀0255", "4111111111111111", "a.b@c.d", "10.0.0.7", "+1 (988) 555-2485", " ", "..", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "1" * 50_000), (9003, "a" * 50_000 + "@"), (9004, "7 " * 20_000)]
    got = {r["doc_id"]: r["b"] for r in pii.find(docs_of(spark, rows)).select("doc_id", pii.rendered(F.col("base")).alias("b")).collect()}
    assert all(got[i] == _base(t) for i, t in rows)


TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}")


def _bootstrap(texts):
    """(doc, start, end) of the tokens that a plain version of the bootstrap accepts."""
    edges, spans = defaultdict(set), defaultdict(list)
    for i, text in texts:
        text = text or ""
        base, bad = [], []
        for kind, p in [*PATTERNS.items(), ("token", TOKEN.pattern)]:
            last, found = 0, list(re.finditer(p, text))
            for m, after in zip(found, [*found[1:], None]):
                squeeze = lambda x: re.sub(r"\s+", " ", x).lower()
                left = re.search(r"(?<!\w)(\w+\W*)$", text[last : m.start()])
                right = re.search(r"^(\W*\w+)", text[m.end() : after.start() if after else len(text)])
                left, right = squeeze(left[1]) if left else "", squeeze(right[1]) if right else ""
                last = m.end()
                meets = lambda of: any(a < m.end() and m.start() < b for a, b in of)  # noqa: B023, E731
                if kind != "token":
                    ok = _holds(kind, m[0])
                    if ok or kind != "card" or len(re.sub("[^0-9]", "", m[0])) >= 13:  # shorter runs of digits are no cards to be rejected
                        (base if ok else bad).append(m.span())
                    if not ok:
                        continue
                elif meets(base):
                    continue
                else:
                    kind_, telling = "id", bool(re.match(pii.TELLING, m[0]))
                    cue = re.match(r"\w+", left)
                    if telling:
                        kind_ = "no" if cue and cue[0] in pii.CHECKSUMS else "key"
                    else:
                        kind_ = "no" if meets(bad) else "id"
                    spans[m[0], kind_].append((i, *m.span()))
                name = (m[0], kind if kind != "token" else kind_)
                for pattern in ([f"L {left}"] if left else []) + ([f"R {right}"] if right else []) + ([f"B {left} _ {right}"] if left and right else []):
                    edges[pattern].add(name)
    sure = {}
    for _ in range(50):
        value = lambda n: 1.0 if n[1] in (*pii.KINDS, "key") else sure.get(n, 0.0)
        mean = {p: sum(map(value, ns)) / len(ns) for p, ns in edges.items() if sum(map(value, ns)) >= pii.LEAST_SUPPORT}
        doubt = defaultdict(lambda: 1.0)
        for p, m in mean.items():
            if m >= pii.LEAST_PATTERN:
                for n in edges[p]:
                    doubt[n] *= 1 - min(m, 0.99)
        sure = {n: 1 - d for n, d in doubt.items() if n[1] in ("id", "key")}
    return {s for n, c in sure.items() if c >= pii.LEAST_INSTANCE for s in spans[n]}


def test_pii_bootstrap_against_brute_force(spark):
    rng = random.Random(12)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    some = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
    rows = [(i, f'{some()} token = "{h}" {some()}') for i, h in enumerate(hexes[:6])]
    rows += [(20 + i, f"{some()} commit {h} {some()}") for i, h in enumerate(hexes[6:])]
    rows += [(39, 'digits within token = "5d190bd7c06284de91015a36974748794293dd8a" stay')]
    rows += [(40, 'x token = "short12345" then member SHORT-77777 said'), (41, "x member AB-1234567 said"), (42, "member CD-7654321 said"), (43, "a member {0}: said".format(hexes[0]))]
    rows += [(50 + i, f"{some()} card no {c} {some()}") for i, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "1234567890123456", "XY-99887766"])]
    rows += [(70 + i, f"{some()} member ZZ-{i}998877 {some()}, {rng.choice(hexes)}") for i in range(6)] + [(90, None), (91, ""), (92, " ".join(f"n{k}abcdefg" for k in range(3000)))]
    got = {(r["doc_id"], s["start"], s["end"]) for r in pii.find(docs_of(spark, rows)).collect() for s in r["ids"]}
    want = _bootstrap(rows)
    assert got == want and {i for i, *_ in want} >= {0, 1, 2, 3, 4, 5, 39, 40} and not {i for i, *_ in want} & {20, 21, 22}


def test_masking_long_texts(spark):
    rng = random.Random(5)
    parts = ["é" * rng.randint(0, 9000) + f" a{k}@b.cd " for k in range(600)]
    rows = [(1, "".join(parts)), (2, "😀" * 4095 + "x@y.zz" + "😀" * 8192), (3, "1.1.1.1@a.b 4111 1111 1111 1111")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, rows)).collect()}
    assert got[1] == re.sub(r"a\d+@b\.cd", "[EMAIL]", rows[0][1]) and got[2] == "😀" * 4095 + "[EMAIL]" + "😀" * 8192 and got[3] == "[IP] [CARD]"


def test_pii_bootstrap_and_redaction(spark):
    rows = [(i, f"please call account number {4000 + i}00.{i}@mail.example.com now or later") for i in range(6)]
    rows += [(10, "please call account number QX99812345 now or later"), (11, "the room had table BC12345678 inside"), (12, "plain words"), (13, None)]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: pii_ids for r in pii.find(docs).collect() if (pii_ids := [(s["start"], s["end"]) for s in r["ids"]])}
    assert got == {10: [(27, 37)]}
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[10]["text"] == "please call account number [ID] now or later" and out[0]["text"].count("[EMAIL]") == 1 and out[12]["text"] == "plain words" and out[13]["text"] is None
    assert out[0]["block"] == "x"


def _wrapped(text, mark, width=60):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD3 = """Copyright (c) 2020, A. N. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


def test_licenses(spark):
    rows, want = [], {}
    for text, name in ((APACHE, "Apache-2.0"), (GPL3, "GPL-3.0-or-later"), (GPL3.replace("software:", "software;").replace("version 3", "version 2"), "GPL-2.0-or-later"), (MPL, "MPL-2.0"), (BSD3, "BSD-3-Clause"), (BSD3[: BSD3.index("3. ")], "BSD-2-Clause")):
        for mark in ("", "// ", " * ", "# ", "  ;; "):
            want[len(rows)] = [name]
            rows.append((len(rows), "some words\n" + "\n".join(mark + line for line in text.split("\n")) + "\nand more"))
    for licence, rule in licenses.RULES:
        text = " ".join(licenses.SENTENCES[k] + "." for k in rule)
        for mark in ("", "// "):
            want[len(rows)] = licence
            rows.append((len(rows), "a line without a stop\n" + _wrapped(text, mark)))
    assert len({licence for licence, _ in licenses.RULES}) >= 25
    for text, names in (
        (None, []), ("", []), (APACHE[:60], []), ("x. " * 10_000, []), ("no stop here\nReleased under the MIT License\nnor here", ["MIT"]), ("All rights reserved.", ["Proprietary"]),
        ("All rights reserved. Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("We are not Released under the MIT License", []), ("word " * 30_000 + "\n# SPDX-License-Identifier: 0BSD", ["0BSD"]),
    ):
        want[len(rows)] = names
        rows.append((len(rows), text))
    got = defaultdict(list)
    for r in licenses.scan(docs_of(spark, rows + rows[:1])).collect():
        got[r["doc_id"]].append(r["licenses"])
    assert len(got[0]) == 2
    for i, names in want.items():
        assert got[i][0] == names if isinstance(names, list) else names in got[i][0], (i, rows[i][1], got[i])


def _vectors(spark, n=900, d=24):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d))
    x[600:750] = x[5] + 0.05 * rng.standard_normal((150, d))
    x[750:800] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5001, None), (5002, [0.0] * d), (5003, [float("nan")] * d), (5004, [1.0, None]), (5005, []), (5006, [float("inf")] * d), (5007, [1.0, 2.0])]
    return x, spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string")


def test_embedding_dedup(spark, monkeypatch):
    x, table = _vectors(spark)
    monkeypatch.setattr(embdedup, "LIST_VECTORS", 100)
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = common.local_labels(len(x), *np.nonzero(near))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(5001, 5008))
    assert embdedup.near_duplicates(table.where("vec_id < 0")).count() == 0


def test_embedding_dedup_of_all_lengths_and_sizes(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.001, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [1e200, 1e200]), (7, [1e200, 1.001e200]), (8, [1e-200, -1e-200]), (9, [5e-324, -5e-324]), (10, [1.0]), (11, [2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8), 10: (1, 10), 11: (1, 10)}


def test_ann(spark, monkeypatch):
    x, table = _vectors(spark)
    monkeypatch.setattr(ann, "PART_VECTORS", 200)
    rows = ann.search(table, F.col("vec_id") % 20 == 0, 20).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 900, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(v - s[i]) < 1e-9 for i, v in got[q])
        hits.append(len(set(want) & {i for i, _ in got[q]}) / 20)
    assert np.mean(hits) >= 0.9 and set(got) == set(range(0, 900, 20))
    assert ann.search(table.where("vec_id < 0"), F.lit(True)).count() == 0
    few = ann.search(table.where("vec_id < 5"), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 4


def test_ann_of_repeated_ids_and_all_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [4.0, 0.0, 1.0]), (4, None)]
    got = defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 2, 4), 20).collect()):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got == {0: [(1, 1, 3.0), (2, 1, 2.0), (3, 1, 2.0)], 2: [(1, 3, 4.0)]}


def test_empty_tables(spark):
    none = docs_of(spark, [])
    for out in (substring.remove_repeats(none), simhash.near_duplicates(none), bpe.encode(none, vocabulary()), packing.pack(none, vocabulary()), pii.find(none), pii.redact(none), licenses.scan(none), langid.annotate(none, langid.fit(none.select("doc_id", "text", F.lit("en").alias("lang"))), name="other"), bpe.decode(bpe.encode(none, vocabulary()), vocabulary()), quality.score(none, quality.fit(none.select("doc_id", F.lit(1).alias("label")), none))):
        assert out.count() == 0
    nulls = docs_of(spark, [(None, "a b c")])
    model = langid.fit(nulls.select("doc_id", "text", F.lit("en").alias("lang")))
    for out in (substring.remove_repeats(nulls), simhash.near_duplicates(nulls), packing.pack(nulls, vocabulary()), pii.find(nulls), licenses.scan(nulls), bpe.encode(nulls, vocabulary()), langid.predict(nulls, model), quality.score(nulls, quality.fit(nulls.select("doc_id", F.lit(1).alias("label")), nulls))):
        assert out.count() == 0
