"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio, document.  A visitor flattens them, in order, into text and
placeholders, and records for every attachment where it stands and how many tokens it expands to.  A turn becomes

    <|turn|> role <|content|> text and placeholders <|end|>

without the blanks.  Control strings inside roles and texts (those of this template and of other common ones) are
escaped: a backslash goes behind their first character, behind any that are there already; dropping one backslash
restores them.  The loss mask covers what assistants say: text and placeholders between the marks.

Rows of a conversation meet in one partition, sorted there by Spark, and are formatted as they stream by: memory
holds one batch of rows, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
# Control strings: "<|" opens every one of this template; the others are marks of common templates.
CONTROL = re.compile(r"(<|\[)(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(\||/?s>|/?INST\])")
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
MESSAGE = re.compile(r"<\|turn\|>(.*?)<\|content\|>(.*)<\|end\|>", re.DOTALL)
LEARNT = "assistant"

PARTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("uri", T.StringType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("seconds", T.DoubleType()),
            T.StructField("pages", T.IntegerType()),
        ]
    )
)
ATTACHMENTS = "array<struct<number:int,kind:string,uri:string,start:long,tokens:long>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


@dataclass
class Flattener:
    """Visits the parts of a message; ``out`` is the flat content, ``attachments`` what it refers to.

    Token counts: an image has one per patch of ``patch`` by ``patch`` pixels, a second of audio ``per_second``,
    a page of a document ``per_page``.  Unknown sizes count as one patch, second or page.  Parts of another kind,
    and text parts, are text.
    """

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 1024
    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 1) / self.patch) for k in ("width", "height"))
        self._attach(part, max(1, across) * max(1, down))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part.get("seconds") or 1.0) * self.per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part.get("pages") or 1) * self.per_page)

    def _attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        record = {"number": number, "kind": part["kind"], "uri": part.get("uri"), "start": self.length, "tokens": tokens}
        self.attachments.append(record)
        self._add(f"<|{part['kind']}:{number}|>")

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def format_message(role: str | None, parts: list[dict], flattener: Flattener) -> tuple[str, int, int]:
    """The formatted message, and where its content starts and ends in it."""
    for part in parts:
        flattener.visit(part or {})
    content = "".join(flattener.out)
    head = f"{TURN}{escape(role or '')}{CONTENT}"
    return head + content + END, len(head), len(head) + len(content)


def read_message(formatted: str) -> tuple[str, str]:
    """Role and content, unescaped; placeholders stay as they are."""
    role, content = MESSAGE.fullmatch(formatted).groups()
    return unescape(role), unescape(content)


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per message, in order within each partition.

    ``messages`` has ``conv_id``, ``turn``, ``role``, ``text`` and may have ``parts`` (see ``PARTS``), which then
    follow the text; other columns are left out.  Rows go by turn (null first), then role, text: rows that agree
    in all of these are equal and stay, one after the other.  Null texts and roles are empty.  Null ids form one
    conversation.

    Columns: ``conv_id``, ``turn``, ``place`` (0, 1, ... in the conversation), ``formatted``, ``start`` (characters
    of the conversation before it), ``loss_start`` and ``loss_end`` (characters within ``formatted`` under the loss
    mask; equal if none), ``attachments`` (start: character within the content) and ``attachment_tokens``.
    """
    has_parts = "parts" in messages.columns
    parts = F.col("parts").cast(PARTS) if has_parts else F.lit(None).cast(PARTS)
    rows = messages.select("conv_id", "turn", "role", "text", parts.alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "text", F.to_json("parts")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = (
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, place long, formatted string, start long, loss_start long, "
        f"loss_end long, attachments {ATTACHMENTS}, attachment_tokens long"
    )
    names = ["conv_id", "turn", "place", "formatted", "start", "loss_start", "loss_end", "attachments", "attachment_tokens"]
    attachment = pa.list_(
        pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("start", pa.int64()),
                   ("tokens", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, start = object(), 0, 0
        for batch in batches:
            types = [batch.schema.field("conv_id").type, batch.schema.field("turn").type, pa.int64(), pa.string(),
                     pa.int64(), pa.int64(), pa.int64(), attachment, pa.int64()]
            made = []
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    current, place, start = row["conv_id"], 0, 0
                flattener = Flattener()
                said = [{"kind": "text", "text": row["text"]}, *(row["parts"] or [])]
                formatted, low, high = format_message(row["role"], said, flattener)
                if row["role"] != LEARNT:
                    high = low
                tokens = sum(a["tokens"] for a in flattener.attachments)
                made.append((current, row["turn"], place, formatted, start, low, high, flattener.attachments, tokens))
                place, start = place + 1, start + len(formatted)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made), types)] if made else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ordered.mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted messages: turns, digests of turns and of the loss text.

    ``formatted`` must come straight from ``format_conversations``: messages of a conversation follow each other.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "attachment_tokens long"
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, id_type = None, None

        def packed(done: list) -> pa.RecordBatch:
            rows = [(s["id"], s["n"], s["turns"].hexdigest(), s["loss"], s["said"].hexdigest(), s["chars"], s["tokens"])
                    for s in done]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if state is not None:
                        done.append(state)
                    state = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": 0, "said": hashlib.sha256(),
                             "chars": 0, "tokens": 0}
                role, content = read_message(row["formatted"])
                masked = unescape(row["formatted"][row["loss_start"] : row["loss_end"]])
                state["n"] += 1
                state["turns"].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                state["loss"] += len(masked)
                state["said"].update(masked.encode("utf-8", "surrogatepass"))
                state["chars"] += len(row["formatted"])
                state["tokens"] += row["attachment_tokens"]
            if done:
                yield packed(done)
        if state is not None:
            yield packed([state])

    return formatted.mapInArrow(run, schema)
