"""Chat formatting with typed content parts.

A turn's content is a list of parts. A visitor walks it and lays out one string: text as
it is, other parts as numbered placeholders in order; each attachment's reference is
recorded with the tokens that it will expand to. Turns stand between control strings;
inside texts and roles these are escaped reversibly (backslash doubled, ``<|`` becomes
``<\\|``), so no text can open or close a turn, nor be taken for an attachment: what stands
unescaped between ``<|`` and ``|>`` is a placeholder, and ``parse_parts`` gives texts and
attachments back apart.

Formatting is row-wise: one piece of output per turn, in order one conversation. Reading
back streams over sorted rows, so a conversation of any length needs the memory of one
turn.

Defined cases: null text is one empty text part; a null role is an empty one; repeated
turns are ordered by role and text; an unknown part type is a document of unknown size; a
part that is a string is a text; another that is no object is the text of its JSON; parts
that are no JSON are one text, a single object is a list of one; a size that is no finite
number counts as unknown; a null id is a conversation of its own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512  # pixels a patch side, tokens a second, tokens a page


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict] = field(default_factory=list)


def _size(value: object) -> float:
    """A size as it was declared; 0 for what is none."""
    fine = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
    return min(max(value, 0), 1e9) if fine else 0


class PartVisitor:
    """Flattens parts; one method a type."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: object) -> None:
        if not isinstance(part, dict):
            part = {"type": "text", "text": part if isinstance(part, str) else json.dumps(part, ensure_ascii=False)}
        {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio}.get(str(part.get("type")), self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.out.append(escape(text if isinstance(text, str) else "" if text is None else json.dumps(text, ensure_ascii=False)))

    def visit_image(self, part: dict) -> None:
        width, height = _size(part.get("width")), _size(part.get("height"))
        self._attach(part, "image", max(1, math.ceil(width / PATCH) * math.ceil(height / PATCH)))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio", max(1, math.ceil(_size(part.get("seconds")) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", max(1, math.ceil(_size(part.get("pages")))) * PAGE_TOKENS)

    def _attach(self, part: dict, kind: str, tokens: int) -> None:
        index = len(self.attachments)
        self.out.append(f"<|{kind}_{index}|>")
        ref = part.get("ref")
        ref = ref if ref is None or isinstance(ref, str) else json.dumps(ref, ensure_ascii=False)
        self.attachments.append({"kind": kind, "ref": ref, "index": index, "tokens": tokens})

    def result(self) -> Flattened:
        return Flattened("".join(self.out), self.attachments)


def listed(parts: str | None, text: str | None) -> list:
    """A column of parts as a list; the text as the one part where there are none."""
    if not parts:
        return [{"type": "text", "text": text}]
    try:
        found = json.loads(parts)
    except ValueError:
        found = parts
    return found if isinstance(found, list) else [found]


def flatten(parts: list) -> Flattened:
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    return visitor.result()


def format_turn(role: str | None, parts: list) -> tuple[str, int, int, list[dict]]:
    """The turn's piece, its loss span (start, length) and its attachments.

    The span covers an assistant's content, without control strings.
    """
    flat = flatten(parts)
    head = OPEN + escape(role or "").replace("\n", "\\n") + "\n"  # a role has one line
    span = len(flat.text) if role == "assistant" else 0
    return head + flat.text + CLOSE, len(head), span, flat.attachments


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and content (unescaped; placeholders stay) of one piece."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError("not a turn")
    role, _, content = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(content)


_PLACEHOLDER = re.compile(r"<\|(image|audio|document)_(\d+)\|>")


def parse_parts(piece: str) -> tuple[str, list[tuple[str, str | int]]]:
    """Role, and content as ("text", text) and (kind, number of the attachment), in order."""
    role, _ = parse_turn(piece)
    content = piece[len(OPEN) : -len(CLOSE)].partition("\n")[2]
    found: list[tuple[str, str | int]] = []
    at = 0
    for m in _PLACEHOLDER.finditer(content):  # a text has no unescaped <|
        found += [("text", unescape(content[at : m.start()]))] if m.start() > at else []
        found.append((m[1], int(m[2])))
        at = m.end()
    return role, found + ([("text", unescape(content[at:]))] if at < len(content) else [])


SCHEMA = (
    "conv_id long, turn long, piece string, loss_start int, loss_length int, "
    "attachments array<struct<kind:string,ref:string,index:int,tokens:long>>"
)


def format_turns(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
) -> DataFrame:
    """One formatted piece a turn. ``parts_col`` holds parts as a JSON list; without it the text is the one part."""
    content = F.col(parts_col).cast("string") if parts_col else F.lit(None).cast("string")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
        content.alias("parts"),
    )
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("ref", pa.string()), ("index", pa.int32()), ("tokens", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for role, text, parts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                made.append(format_turn(role, listed(parts, text)))
            piece, start, span, attached = zip(*made, strict=True) if made else ((),) * 4
            yield pa.record_batch(
                {
                    "conv_id": batch.column(0),
                    "turn": batch.column(1),
                    "piece": pa.array(piece, pa.string()),
                    "loss_start": pa.array(start, pa.int32()),
                    "loss_length": pa.array(span, pa.int32()),
                    "attachments": pa.array(attached, kind),
                }
            )

    return rows.mapInArrow(run, SCHEMA)


def attachments(pieces: DataFrame) -> DataFrame:
    """conv_id, turn, role, texts (read back, without placeholders), kinds and numbers (read back), refs, tokens of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [parse_parts(x) for x in batch.column(2).to_pylist()]
            own = [[(k, v) for k, v in parts if k != "text"] for _, parts in read]
            known = batch.column(3).to_pylist()
            yield pa.record_batch(
                {
                    "conv_id": batch.column(0),
                    "turn": batch.column(1),
                    "role": pa.array([role for role, _ in read], pa.string()),
                    "texts": pa.array(["".join(v for k, v in parts if k == "text") for _, parts in read], pa.string()),
                    "placeholders": pa.array([" ".join(f"{k}_{v}" for k, v in x) for x in own], pa.string()),
                    "refs": pa.array([" ".join(a[v]["ref"] or "" for _, v in x) for x, a in zip(own, known, strict=True)], pa.string()),
                    "tokens": pa.array([sum(a[v]["tokens"] for _, v in x) for x, a in zip(own, known, strict=True)], pa.int64()),
                }
            )

    schema = "conv_id long, turn long, role string, texts string, placeholders string, refs string, tokens long"
    return pieces.select("conv_id", "turn", "piece", "attachments").mapInArrow(run, schema)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its pieces alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: list | None = None

        def close() -> None:
            if now is not None:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 4)]
            for conv, piece, start, span in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, sha256(), 0, sha256(), 0]
                role, content = parse_turn(piece)
                masked = unescape(piece[start : start + span])
                now[1] += 1
                now[2].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(masked)
                now[4].update(masked.encode("utf-8", "surrogatepass"))
                now[5] += len(piece)
            if len(done) >= 4096:
                yield _digest_batch(done)
                done.clear()
        close()
        if done:
            yield _digest_batch(done)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    return ordered.mapInArrow(run, DIGESTS)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [part.strip().split(" ")[0] for part in DIGESTS.split(",")]
    return pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})
