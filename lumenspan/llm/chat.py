"""Chat formatting of typed content: a visitor flattens parts into text with ordered placeholders.

A turn is ``<s>`` role ``[INST]`` body ``[/INST]</s>``. Its content is a list of typed parts; the
visitor writes text parts escaped, and each image, audio or document part as a placeholder, whose
attachment (kind, reference, expanded token count) is recorded in the placeholders' order. A backslash
goes behind the first character of whatever could be a control string, and behind each backslash, so that
no text holds one and taking out each backslash before another character gives the text back.
The loss mask of an assistant's turn spans its body, in code points of the formatted turn.

Turns are formatted row by row, without a shuffle. A conversation is its turns in the order of (turn,
formatted), concatenated; ``read_back`` deals them by conversation, sorts them and streams them through parser
and hashes, so a task holds a batch and not a conversation, however long that is. (A digest of a conversation in
order can't be worked out in parts.)

Cases: null text, null lists of parts and null parts are empty; a null role is an empty one; a part of another
type is a placeholder of kind ``other``; missing measures of a part cost its kind's default; a null turn comes
first; turns that repeat a number, or are wholly equal, all stand; rows without a conversation id are one
conversation; texts are never cut; an empty table gives no rows; other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The control strings of the template.
BEGIN, BODY, BODY_END, END = "<s>", "[INST]", "[/INST]", "</s>"
KINDS = ("image", "audio", "document", "other")

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
ATTACHMENTS = "array<struct<kind: string, ref: string, tokens: bigint>>"

_CONTROL = r"\\|<(?=/?s>|\|)|\[(?=/?INST\])"
_PLACEHOLDER = r"<\|(?:image|audio|document|other)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def placeholder(kind: str) -> str:
    return f"<|{kind}|>"


@dataclass(frozen=True)
class Visitor:
    """What each kind of part is worth in tokens once its placeholder is expanded."""

    patch: int = 28  # of an image, in pixels each way
    image_tokens: int = 256  # of an image of unknown size
    audio_rate: float = 25.0  # tokens a second
    audio_tokens: int = 750
    page_tokens: int = 576
    document_tokens: int = 576
    other_tokens: int = 0

    def image(self, part: Column) -> Column:
        side = lambda name: F.ceil(part[name] / F.lit(self.patch))
        return F.coalesce(side("width") * side("height"), F.lit(self.image_tokens))

    def audio(self, part: Column) -> Column:
        return F.coalesce(F.ceil(part["seconds"] * F.lit(self.audio_rate)), F.lit(self.audio_tokens))

    def document(self, part: Column) -> Column:
        return F.coalesce(part["pages"] * F.lit(self.page_tokens), F.lit(self.document_tokens))

    def other(self, part: Column) -> Column:
        return F.lit(self.other_tokens)

    def kind(self, part: Column) -> Column:
        """``text``, or one of ``KINDS``."""
        return F.when(part["type"].isin("text", *KINDS), part["type"]).otherwise("other")

    def tokens(self, part: Column) -> Column:
        cost = F.lit(0)
        for name in KINDS:
            cost = F.when(self.kind(part) == name, getattr(self, name)(part)).otherwise(cost)
        return cost.cast("long")

    def written(self, part: Column) -> Column:
        return F.when(self.kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), self.kind(part), F.lit("|>")))

    def attachment(self, part: Column) -> Column:
        return F.struct(self.kind(part).alias("kind"), part["ref"].alias("ref"), self.tokens(part).alias("tokens"))

    def body(self, parts: Column) -> Column:
        return F.array_join(F.transform(parts, self.written), "")

    def attachments(self, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: self.kind(p) != "text"), self.attachment).cast(ATTACHMENTS)


def text_parts(text: Column) -> Column:
    """A plain text as content of one part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(k) for k, t in none.items()]))


def json_parts(content: Column) -> Column:
    """Content of parts from JSON: a list of objects with the names of ``PARTS``, or a string, which is one text part.

    What is neither (or broken) is a text as it stands; null is an empty list.
    """
    listed = F.from_json(F.when(content.rlike(r"^\s*\["), content), PARTS)
    quoted = F.get_json_object(F.concat(F.lit('{"x":'), F.when(content.rlike(r'^\s*"'), content), F.lit("}")), "$.x")
    return F.when(content.isNotNull(), F.coalesce(listed, text_parts(F.coalesce(quoted, content)).cast(PARTS)))


def format_turns(
    table: DataFrame, content: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", learned: tuple[str, ...] = ("assistant",), visitor: Visitor = Visitor()
) -> DataFrame:
    """(id, turn, formatted, loss_start, loss_end, attachments, expanded_tokens) of each row.

    ``content`` is a list of parts (``PARTS``). The mask is null where the role isn't learned.
    """
    parts = F.filter(F.coalesce(content.cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = table.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.concat(F.lit(BEGIN), escape(role), F.lit(BODY)).alias("head"), parts.alias("parts"), role.isin(*learned).alias("learned"))
    rows = rows.withColumns({"body": visitor.body(F.col("parts")), "attachments": visitor.attachments(F.col("parts"))})
    start = F.when(F.col("learned"), F.length("head"))
    return rows.select(
        F.col("id").alias(id_col), F.col("turn").alias(turn_col), F.concat("head", "body", F.lit(BODY_END + END)).alias("formatted"),
        start.alias("loss_start"), (start + F.length("body")).alias("loss_end"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turn(formatted: Column) -> tuple[Column, Column]:
    """(role, body) of a formatted turn; the body is still escaped."""
    turn = r"(?s)^<s>(.*?)\[INST\](.*)\[/INST\]</s>$"
    return unescape(F.regexp_extract(formatted, turn, 1)), F.regexp_extract(formatted, turn, 2)


def read_parts(body: Column, attachments: Column) -> Column:
    """A body's parts in order, (kind, text or reference): neighbouring texts are one, empty ones are none."""
    texts = F.split(body, _PLACEHOLDER, -1)
    part = lambda kind, value: F.struct(kind.alias("kind"), value.cast("string").alias("value"))
    both = lambda t, k: F.array(part(F.lit("text"), unescape(t)), part(F.get(attachments, k)["kind"], F.get(attachments, k)["ref"]))
    return F.filter(F.flatten(F.transform(texts, both)), lambda p: p["kind"].isNotNull() & ~((p["kind"] == "text") & (p["value"] == "")))


_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


class _Reader:
    """Reads one conversation, turn after turn, keeping counts and hashes alone."""

    def __init__(self, key):
        self.key, self.turns, self.loss, self.chars, self.tokens = key, 0, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def take(self, text: str, start: int | None, end: int | None, tokens: int) -> None:
        self.chars += len(text)
        self.tokens += tokens
        for role, body in _TURN.findall(text):
            self.turns += 1
            self.all.update(f"{_ESCAPED.sub(r'\1', role)}\n{_ESCAPED.sub(r'\1', body)}\n".encode())
        if start is not None:
            learned = _ESCAPED.sub(r"\1", text[start:end])
            self.loss += len(learned)
            self.masked.update(learned.encode())

    def result(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.tokens


def read_back(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, expanded_tokens) of each conversation, read from its formatted turns."""
    common.ship_package(turns.sparkSession)
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for key, text, start, end, tokens in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now is None or key != now.key:
                    done += [now.result()] if now else []
                    now = _Reader(key)
                now.take(text, start, end, tokens)
            yield from _batch(done, b.schema.field(0).type)
        yield from _batch([now.result()] if now else [], b.schema.field(0).type) if now else ()

    def _batch(done: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if done:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    rows = turns.repartition(F.col(id_col)).sortWithinPartitions(id_col, turn_col, "formatted")
    rows = rows.select(id_col, "formatted", "loss_start", "loss_end", "expanded_tokens")
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(read, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long")


#: The turns that the query adds: control strings inside texts, on both sides.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def oracle_sql() -> str:
    """Digests of conversations from the table itself, for DuckDB; of the template only lengths are needed."""
    held = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}"
    length = lambda c: f"length({c}) + " + " + ".join(held(c, x) for x in ("\\", BEGIN, END, "<|", BODY, BODY_END))
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')) p(a, b, c, d))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256, sum({len(BEGIN + BODY + BODY_END + END)} + {length("role")} + {length("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""
