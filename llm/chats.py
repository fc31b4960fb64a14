"""Formatting chats whose messages have typed content parts, and reading them back.

A message is a row (conversation, turn, role, content); content is a text or an array of parts. A visitor goes through
the parts in order: text is escaped, an image, a sound or a document becomes a placeholder, and what it stands for is
recorded: its kind and URI, and how many tokens the placeholder expands to (an image: one for each patch; a sound: so many a
second; a document: so many a page). The n-th placeholder of a conversation belongs to its n-th attachment.

A template marks the turns. Control strings inside texts and role names lose their meaning by a stroke after their first
character, and a stroke becomes two, so escaping is reversible: unescaped() drops one stroke of each that starts an escape.
As a control string has its first character nowhere else, none can arise across a seam. The loss mask is exactly the
assistants' texts, without the marks around them.

A conversation never becomes one value: it is the sequence of its turns' pieces, each with its place and its offset in the
whole, in code points. Pieces are made where the rows lie. Rows are then dealt by ranges of (conversation, turn), so a
conversation of any size is spread over tasks; tasks count places, offsets and attachments on their own, and are shifted by
what the tasks before hold of the conversation that a border cuts. Only read() follows a conversation from end to end: a
digest of a whole needs its turns one after another. It does so as a stream, with one batch in memory.

Turns come in the order of their numbers, null last, equal ones by role and text. A null text or an array without parts is
empty, null parts are skipped, a part with an unknown type is an error. A null role is one of its own that reads back as
empty. A null conversation id is an id. Repeated rows are turns each. No rows give no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import saved

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:bigint,kind:string,uri:string,at:bigint,tokens:bigint>"
PIECE = f"conv_id long, turn long, role string, text string, chars long, body_at long, body_chars long, attachments array<{ATTACHMENT}>"


@dataclass(frozen=True)
class Template:
    """Marks of turns. Every mark and placeholder consists of control strings, which begin with < or [, and spaces."""

    user: tuple[str, str] = ("[INST] ", " [/INST]")
    assistant: tuple[str, str] = ("", "</s>")
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")  # before the role's name, after it, after the text
    placeholder: str = "<|{}|>"
    kinds: tuple[str, ...] = ("image", "audio", "document")
    more: tuple[str, ...] = ("<s>",)  # other strings that mean something to a tokenizer
    stroke: str = "\\"
    patch: int = 14
    sound_tokens: int = 25
    page_tokens: int = 512

    def controls(self) -> list[str]:
        marks = [m.strip() for m in (*self.user, *self.assistant, *self.other, *self.more) if m.strip()]
        return [*marks, *(self.placeholder.format(k) for k in self.kinds)]

    def checked(self) -> Template:
        for c in self.controls():
            if c[0] not in "<[" or any(x in c[1:] for x in "<[") or self.stroke in c or len(c) < 2:
                raise ValueError(f"{c}: a control string starts with < or [, has neither again, and no stroke")
        return self


def escaped(text: str, t: Template) -> str:
    """text without control strings; unescaped() gives it back."""
    text = text.replace(t.stroke, 2 * t.stroke)
    for c in t.controls():
        text = text.replace(c, f"{c[0]}{t.stroke}{c[1:]}")
    return text


def unescaped(text: str, t: Template) -> str:
    return re.sub(re.escape(t.stroke) + "(.)", r"\1", text, flags=re.DOTALL)


class Flattener:
    """Visits the parts of one message: text gathers in order, attachments beside it."""

    def __init__(self, t: Template) -> None:
        self.t, self.text, self.size, self.attachments = t, [], 0, []

    def visit(self, part: dict[str, Any]) -> None:
        how: Callable[[dict[str, Any]], None] | None = getattr(self, f"visit_{part['type']}", None)
        if how is None:
            raise ValueError(f"content part of unknown type {part['type']!r}")
        how(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        self._add(escaped(part["text"] or "", self.t))

    def visit_image(self, part: dict[str, Any]) -> None:
        self._attach(part, -(-(part["width"] or 0) // self.t.patch) * -(-(part["height"] or 0) // self.t.patch))

    def visit_audio(self, part: dict[str, Any]) -> None:
        self._attach(part, -int(-(part["seconds"] or 0.0) * self.t.sound_tokens // 1))

    def visit_document(self, part: dict[str, Any]) -> None:
        self._attach(part, (part["pages"] or 0) * self.t.page_tokens)

    def _add(self, s: str) -> None:
        self.text.append(s)
        self.size += len(s)

    def _attach(self, part: dict[str, Any], tokens: int) -> None:
        self.attachments.append({"number": len(self.attachments), "kind": part["type"], "uri": part["uri"], "at": self.size, "tokens": tokens})
        self._add(self.t.placeholder.format(part["type"]))


def piece(role: str | None, content: str | list[dict[str, Any] | None] | None, t: Template) -> dict[str, Any]:
    """One turn: its text with marks, and within it the span of its content and the attachments."""
    f = Flattener(t)
    for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
        if part is not None:
            f.visit(part)
    body = "".join(f.text)
    if role == "user":
        before, after = t.user
    elif role == "assistant":
        before, after = t.assistant
    else:
        before, after = f"{t.other[0]}{escaped(role or '', t)}{t.other[1]}", t.other[2]
    text = f"{before}{body}{after}"
    return {"text": text, "chars": len(text), "body_at": len(before), "body_chars": len(body), "attachments": [{**a, "at": a["at"] + len(before)} for a in f.attachments]}


def parsed(text: str, t: Template) -> list[tuple[str, str]]:
    """The turns of a formatted text, as (role, text): the inverse of piece() for turns of text."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(t.user[0], at):
            role, begin, close = "user", at + len(t.user[0]), t.user[1]
        elif text.startswith(t.other[0], at):
            end = text.index(t.other[1], at)
            role, begin, close = unescaped(text[at + len(t.other[0]) : end], t), end + len(t.other[1]), t.other[2]
        else:
            role, begin, close = "assistant", at + len(t.assistant[0]), t.assistant[1]
        end = text.index(close, begin)
        out.append((role, unescaped(text[begin:end], t)))
        at = end + len(close)
    return out


def formatted(messages: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """messages to the turns' pieces: conv_id, place (from 0), role, text, start (offset in the conversation), loss_start and
    loss_chars, attachments (numbered through the conversation, at: offset in the piece)."""
    t, kinds = template.checked(), (pa.int64(), pa.string(), pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [piece(r, c, t) for r, c in zip(b.column("role").to_pylist(), b.column("content").to_pylist(), strict=True)]
            cols = [pa.array([m[k] for m in made], kind) for k, kind in (("text", kinds[1]), ("chars", kinds[0]), ("body_at", kinds[0]), ("body_chars", kinds[0]), ("attachments", kinds[2]))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), *cols], ["conv_id", "turn", "role", "text", "chars", "body_at", "body_chars", "attachments"])

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places, offsets and attachments counted within the task; rows come sorted."""
        last, place, start, n = object(), 0, 0, 0
        for b in it:
            places, starts, ns = [], [], []
            for c, chars, a in zip(b.column("conv_id").to_pylist(), b.column("chars").to_pylist(), b.column("n").to_pylist(), strict=True):
                if c != last:
                    last, place, start, n = c, 0, 0, 0
                places.append(place)
                starts.append(start)
                ns.append(n)
                place, start, n = place + 1, start + chars, n + a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, kinds[0]), pa.array(starts, kinds[0]), pa.array(ns, kinds[0])], [*b.schema.names, "place", "start", "before"])

    given = messages.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{content}`").alias("content"))
    rows = saved(given.mapInArrow(make, PIECE), "pieces")
    # equal turns go by their texts as they were; only they are ever unescaped for that
    said = F.regexp_replace(F.substring(F.col("text"), F.col("body_at") + 1, F.col("body_chars")), "(?s)" + re.escape(t.stroke) + "(.)", "$1")
    order = ("conv_id", F.asc_nulls_last("turn"), "role", said)
    dealt = rows.withColumn("n", F.size("attachments").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    dealt = saved(dealt.mapInArrow(number, f"{PIECE}, n long, task int, place long, start long, before long"), "numbered")
    # what tasks hold of conversations that go on in a later task: one such conversation a task at most
    held = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("turns"), F.sum("chars").alias("size"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("conv_id", "task", *(F.sum(c).over(earlier).alias(f"{c}_before") for c in ("turns", "size", "n"))).where("turns_before is not null")
    shift = F.broadcast(shift.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), "turns_before", "size_before", "n_before"))
    out = dealt.join(shift, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")), "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    start, first = F.col("start") + more("size_before"), F.col("before") + more("n_before")
    attachments = F.transform("attachments", lambda a: a.withField("number", a["number"] + first))
    return out.select("conv_id", (F.col("place") + more("turns_before")).alias("place"), "role", "text", "chars", start.alias("start"), (start + F.col("body_at")).alias("loss_start"), F.when(F.col("role") == "assistant", F.col("body_chars")).otherwise(0).alias("loss_chars"), attachments.alias("attachments"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def read(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Pieces to one row a conversation, from the formatted text alone: turns and what lies under the loss mask."""
    t = template.checked()

    def follow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = None
        state: list[Any] = []
        out: list[tuple[Any, ...]] = []

        def close() -> None:
            if state:
                out.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        def sent() -> pa.RecordBatch:
            names = [x.split()[0] for x in READ.split(", ")]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, cols, strict=True)], names)

        for b in it:
            for c, text, at, loss_at, n, number, tokens in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "start", "loss_start", "loss_chars", "n", "tokens")), strict=True):
                if not state or c != last:
                    close()
                    last, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if at != state[4]:
                    raise ValueError(f"conversation {c}: a piece at {at} where {state[4]} follows")
                for role, said in parsed(text, t):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                said = unescaped(text[loss_at - at : loss_at - at + n], t)
                state[2] += len(said)
                state[3].update(said.encode())
                state[4], state[5], state[6] = state[4] + len(text), state[5] + number, state[6] + tokens
            yield sent()
        close()
        yield sent()

    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    rows = pieces.select("conv_id", "place", "text", "start", "loss_start", "loss_chars", F.size("attachments").cast("long").alias("n"), tokens.alias("tokens"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(follow, READ)


#: A conversation that the contract adds: its texts consist of control strings.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    parts = F.array(F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).cast(k).alias(n) for n, k in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return read(formatted(messages.unionByName(added).select("conv_id", "turn", "role", parts.alias("text"))))


def _oracle(t: Template = Template()) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    longer = " + ".join([f"length(text) - length(replace(text, {quoted(t.stroke)}, ''))", *(f"(length(text) - length(replace(text, {quoted(c)}, ''))) // {len(c)}" for c in t.controls())])
    role = longer.replace("(text", "(role")
    return f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(text) + {longer} + CASE role WHEN 'user' THEN {len("".join(t.user))} WHEN 'assistant' THEN {len("".join(t.assistant))}
    ELSE {len("".join(t.other))} + length(role) + {role} END AS chars FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM f GROUP BY conv_id
"""


ORACLE = _oracle()
