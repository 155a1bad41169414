"""Chat formatting with typed content parts (operator 7).

A message's content is a list of parts: text, image, audio or document.  A visitor turns
each part into text: a text part is escaped; any other becomes one placeholder, whose
attachment is recorded in order with its reference and the number of tokens a model
will put in its place.  Turns are written one after another as

    ### <role>: <content></turn>\\n

Control strings begin with ``#`` or ``<``, so these two and the escape character ``\\`` get a
``\\`` in front of them inside texts and roles (in roles ``:`` too); nothing in a text can then be
taken for a mark, and dropping the escapes gives every text back.  The loss mask is a list of
spans, in code points of the formatted string: the contents of assistant turns.

Defined results: turns go by turn number, of equal numbers by role and text, null first; a
null text, part list or part is empty; a part without a type is a text, one of an unknown type is a placeholder
``other`` of one token; a null width, height, length or number of pages counts 0, and no attachment has less than one token; a
null role is the empty role; a null turn comes first; a conversation whose id is null is one of its own; an empty table gives
no rows; extra columns, also those named like the result's, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, MID = "### ", "</turn>\n", ": "
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_ESCAPE = re.compile(r"[\\#<]")
_ESCAPE_ROLE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_HOLE = r"<\|(?:image|audio|document|other)_\d+\|>"
# possessive: a run of plain characters is one step and nothing is kept to go back to, so memory doesn't grow with a text
_TURN = re.compile(rf"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.|{_HOLE})*+)</turn>\n", re.DOTALL)
_MARK = re.compile(rf"\\(.)|{_HOLE}", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """The text of a formatted content, without its placeholders."""
    return _MARK.sub(lambda m: m[1] or "", text)


@dataclass
class Formatter:
    """Visits parts and collects the formatted string, the mask and the attachments."""

    patch: int = 28  # pixels of a square that is one token
    per_second: float = 12.5
    per_page: int = 512
    out: list[str] = field(default_factory=list)
    size: int = 0
    mask: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, part: dict) -> None:
        getattr(self, "visit_" + str(part.get("type") or "text"), self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, -int(-(part.get("seconds") or 0) * self.per_second // 1))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.per_page)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.size, "tokens": max(1, tokens)})
        self.write(f"<|{kind}_{len(self.attachments) - 1}|>")

    def turn(self, role: str | None, parts: list[dict] | None) -> None:
        role = role or ""
        self.write(OPEN + _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role) + MID)
        begin = self.size
        for part in parts or []:
            self.visit(part or {})
        if role == "assistant":
            self.mask.append({"start": begin, "end": self.size})
        self.write(CLOSE)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_UNESCAPE.sub(lambda x: x[1], m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, formatted string, loss_mask array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,position:int,tokens:int>>, n_tokens_attached long"


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> a row a conversation: FORMATTED.

    A conversation is one string, so its turns meet in one task; they are collected with
    map-side partials in the JVM and sorted there.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int32())]))), ("n_tokens_attached", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                for row in whole.slice(at, 500).to_pylist():
                    f = Formatter()
                    for t in row["turns"]:
                        f.turn(t["role"], t["parts"])
                    rows.append({"conv_id": row["conv_id"], "formatted": "".join(f.out), "loss_mask": f.mask, "attachments": f.attachments, "n_tokens_attached": sum(a["tokens"] for a in f.attachments)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    turns = messages.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("parts").cast(PART_TYPE).alias("parts")))).alias("turns"))
    return turns.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: n_turns, digests of the turns and of the text under the mask, sizes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, text, mask in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                for column, value in zip(out, (conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_parts(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) with each text as its one part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return messages.select("conv_id", "turn", "role", F.array(part).alias("parts"))
