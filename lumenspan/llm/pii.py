"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They seed the
bootstrap, and so do tokens whose shape alone tells a credential (``TELLING``: long mixed
hexadecimal strings, keys with a public prefix), unless a word of ``CHECKSUMS`` stands before them.
The words and signs left and right of each seed make lexical patterns, and so do those of every
other identifier-shaped token (letters, digits, ``-`` and ``_``; eight characters or more; a
digit among them). What a base pattern matched and its test rejected, such as a number that fails
the Luhn test, is known not to be one, unless it is part of a telling token: it counts against its contexts, as checksums do. Patterns
and instances form a graph, scored in rounds: a pattern is as sure as the mean certainty of the
distinct instances it extracts, an instance as sure as its accepted patterns leave it (noisy or).
Certainties only grow, and the rounds go on until none does; the driver learns counts and a sum.
Tokens sure enough at the end become spans of the kind ``id`` beside the base ones. A telling
shape alone adds no span: a pattern must have been accepted for it.

A context is the nearest word on a side with the signs between it and the token, however long, up
to the neighbouring match of the same pattern. One that a great share of all seeds have is one row
in each task before it is shuffled (partial aggregation); the joins of the graph carry distinct
pairs and are dealt anew by Spark where a pattern is hot. Spans and masked texts are put together in
groups of ``GROUP``, so that the work for a long text is not the square of its matches.

Cases: null counts as empty; empty texts have no spans; offsets are in code points, the end
exclusive; repeated rows get the same spans each; rows without an id are left out (``redact`` keeps
them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The kinds in the order in which spans are listed, and their patterns. The
#: look-behinds and possessive marks only keep a long run from being tried again at each of its
#: characters; matches are those of the plain patterns that the query's contract gives.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?=(?:[\x20-]?[0-9]){12})[0-9]*+(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
#: Shapes of credentials, and words before strings of such a shape that are none.
TELLING = r"^(?:(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|pk|rk)[_-][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{16,})$"
CHECKSUMS = ("blob", "checksum", "commit", "digest", "etag", "hash", "index", "integrity", "md5", "parent", "revision", "sha", "sha1", "sha256", "sha512", "tree")
#: A pattern is accepted with so many certain instances and such a mean; an instance with such a certainty.
LEAST_SUPPORT, LEAST_PATTERN, LEAST_INSTANCE = 3.0, 0.5, 0.8
#: Matches put together at once, and code points that a piece of a text holds.
GROUP, PIECE = 256, 4096
_ITEM = "struct<start:int,end:int,value:string,left:string,right:string>"
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++[^\p{L}\p{N}_]*+)$", r"^([^\p{L}\p{N}_]*+[\p{L}\p{N}_]+)"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` has it inside a function over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _piece(at: Column) -> Column:
    return F.shiftright(at, PIECE.bit_length() - 1)


def _groups(items: Column) -> Column:
    """An array in slices of ``GROUP``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int")), lambda k: F.slice(items, k * GROUP + 1, GROUP))


def _spans(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, value, left, right) of the matches ``found`` of a pattern: what lies between them tells where they are."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))

    def describe(gaps, m, i):
        gap, after = F.get(gaps, i), F.get(gaps, i + 1)
        left, right = F.regexp_extract(gap, _LEFT, 1), F.regexp_extract(after, _RIGHT, 1)
        return F.struct(F.length(gap).alias("gap"), m.alias("value"), plain(left).alias("left"), plain(right).alias("right"))

    def place(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    def shift(acc, group):
        moved = F.transform(group["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right")))
        return F.struct((acc["at"] + group["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_ITEM}>").alias("spans"))
    described = _let(F.split(text, pattern, -1), lambda gaps: F.transform(found, lambda m, i: describe(gaps, m, i)))
    groups = F.transform(_let(described, _groups), lambda g: F.aggregate(g, start, place))
    return F.when(F.size(found) > 0, F.aggregate(groups, start, shift, lambda acc: acc["spans"])).otherwise(F.array().cast(f"array<{_ITEM}>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with text) and email, ip, card, phone, token, rejected: arrays of (start, end, value)."""
    kept = rows.columns
    patterns = PATTERNS | {"token": TOKEN}
    needs = {k: F.contains("text", F.lit(c)) if (c := NEEDED.get(k)) else F.col("text").rlike("[0-9]") for k in patterns}
    none = F.array().cast("array<string>")
    out = rows.select(*kept, *[F.when(needs[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()])
    out = out.select(*kept, *[_spans(F.col("text"), p, F.col(f"m_{k}")).alias(k) for k, p in patterns.items()])
    valid = lambda kind: lambda s: _holds(kind, s["value"])
    failing = lambda kind: lambda s: ~_holds(kind, s["value"])
    rejected = F.concat(*[F.filter(k, failing(k)) for k in KINDS])
    return out.select(*kept, "token", rejected.alias("rejected"), *[F.filter(k, valid(k)).alias(k) for k in KINDS])


def _by_piece(text: Column, spans: Column) -> Column:
    """Spans by the pieces of the text that they lie in."""
    return _let(spans, lambda all_: F.transform(F.sequence(F.lit(0), _piece(F.length(text))), lambda k: F.filter(all_, lambda s: (_piece(s["start"]) <= k) & (_piece(s["end"] - 1) >= k))))


def _meets(held: Column, t: Column) -> Column:
    """Whether a span meets any of those that ``_by_piece`` gave."""
    mine = F.slice(held, _piece(t["start"]) + 1, _piece(t["end"] - 1) - _piece(t["start"]) + 1)
    return F.exists(mine, lambda p: F.exists(p, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def extract(docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, items) of each row: base spans in order, and seeds and other tokens in context.

    ``key`` tells rows of one id with different texts apart. One pass over the texts, which
    are not in the result.
    """
    rows = common.documents_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    found = base_spans(rows).withColumn("all", F.concat(*KINDS))
    item = lambda kind, s: F.struct(kind.alias("kind"), *[s[c].alias(c) for c in ("start", "end", "value", "left", "right")])
    listed = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

    def token_kind(rejected, t):
        cue = F.regexp_extract(t["left"], r"([\p{L}\p{N}_]+)", 1).isin(*CHECKSUMS)
        telling = t["value"].rlike(TELLING)
        return F.when(telling, F.when(cue, "no").otherwise("key")).when(_meets(rejected, t), "no").otherwise("id")

    open_tokens = _let(_by_piece(F.col("text"), F.col("all")), lambda held: F.filter("token", lambda t: ~_meets(held, t)))
    tokens = _let(_by_piece(F.col("text"), F.col("rejected")), lambda held: F.transform(open_tokens, lambda t: item(token_kind(held, t), t)))
    seed = lambda kind: lambda s: item(F.lit(kind), s)
    items = [F.transform(k, seed(k)) for k in KINDS] + [tokens]
    return found.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.concat(*[F.transform(k, listed(k)) for k in KINDS]).alias("base"), F.concat(*items).alias("items"))


def discovered(items: DataFrame) -> DataFrame:
    """(instance, sure) of the tokens that the bootstrap accepts; ``items`` as from the base pass."""
    pattern = F.explode(
        F.filter(
            F.array(
                F.when(F.col("left") != "", F.concat(F.lit("L "), "left")),
                F.when(F.col("right") != "", F.concat(F.lit("R "), "right")),
                F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), "left", F.lit(" _ "), "right")),
            ),
            lambda x: x.isNotNull(),
        )
    )
    edges = items.select(F.xxhash64("value", "kind").alias("instance"), F.col("kind").isin("id", "key").alias("open"), F.col("kind").isin(*KINDS, "key").alias("seed"), pattern.alias("pattern"))
    edges = common.materialize(edges.distinct(), "pii-edges")
    sure, mark, k = None, None, 0
    while True:
        if sure is None:
            known = edges.withColumn("sure", F.col("seed").cast("double"))
        else:
            known = edges.join(sure, "instance", "left").withColumn("sure", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("sure", F.lit(0.0))))
        scores = known.groupBy("pattern").agg(F.sum("sure").alias("support"), F.avg("sure").alias("mean"))
        scores = scores.where((F.col("support") >= LEAST_SUPPORT) & (F.col("mean") >= LEAST_PATTERN)).select("pattern", "mean")
        held = edges.where("open").join(scores, "pattern")
        last, k = sure, k + 1
        sure = held.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("mean", F.lit(0.99)))))).alias("sure"))
        sure = common.materialize(sure, f"pii-round{k}")
        if last is not None:
            common.release(last)
        now = sure.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sure") >= LEAST_INSTANCE).alias("accepted"), F.round(F.sum("sure"), 4).alias("sum")).first()
        if now == mark:
            return sure.where(F.col("sure") >= LEAST_INSTANCE)
        mark = now


def find(docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, ids) for each row: base spans in order of kind and start, and those that the method adds."""
    found = common.materialize(extract(docs), "pii-found")
    items = found.where(F.size("items") > 0).select("doc_id", "key", F.explode("items").alias("i")).select("doc_id", "key", "i.*")
    accepted = discovered(items)
    # the few rows with added spans, by document
    added = items.where("kind in ('id', 'key')").withColumn("instance", F.xxhash64("value", "kind")).join(accepted, "instance", "left_semi")
    added = added.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ids"))
    as_id = lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    ids = F.transform(F.coalesce("ids", F.array().cast("array<struct<start:int,end:int>>")), as_id)
    return found.select("key", "doc_id", "base").join(added, ["doc_id", "key"], "left").select("key", "doc_id", "base", ids.alias("ids"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) and all its columns, each span of a text replaced by its kind in brackets."""
    spans = find(docs).select("doc_id", "key", F.concat("base", "ids").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"])
    at, key, found = (common.fresh(n, docs.columns) for n in ("__id", "__key", "__spans"))
    keyed = docs.withColumns({at: F.col("doc_id").cast("long"), key: F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))})
    out = keyed.join(spans.select(F.col("doc_id").alias(at), F.col("key").alias(key), F.col("spans").alias(found)), [at, key], "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(found)))
    return out.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def rendered(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in pieces, without counting from its beginning."""
    inside = F.substring(F.get(pieces, _piece(a)), a % PIECE + 1, b - a)
    across = F.concat(
        F.substring(F.get(pieces, _piece(a)), a % PIECE + 1, F.lit(PIECE)),
        F.array_join(F.slice(pieces, _piece(a) + 2, F.greatest(_piece(b) - _piece(a) - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(pieces, _piece(b)), F.lit(1), b % PIECE), F.lit("")),
    )
    return F.when(b <= a, "").when(_piece(a) == _piece(b), inside).otherwise(across)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins inside an earlier one is dropped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def reach(acc, g):
        """Where the text before each group of spans ends, and at last the text before the rest."""
        end = F.array_max(F.transform(g, lambda s: s["end"]))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    def step(pieces):
        def put(acc, s):
            mark = F.concat(acc["out"], _between(pieces, acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], mark).otherwise(acc["out"]).alias("out"))

        return put

    def joined(groups, begins, pieces):
        parts = F.transform(groups, lambda g, k: F.aggregate(g, F.struct(F.get(begins, k).alias("at"), F.lit("").alias("out")), step(pieces), lambda acc: acc["out"]))
        return F.concat(F.array_join(parts, ""), _between(pieces, F.element_at(begins, -1), F.length(text)))

    def whole(groups):
        begins = F.aggregate(groups, none, reach, lambda acc: F.concat(acc["begins"], F.array(acc["at"])))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return _let(begins, lambda b: _let(pieces, lambda p: joined(groups, b, p)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_let(ordered, _groups), whole))
