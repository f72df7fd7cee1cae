"""Chat formatting: render conversations with a compiled template, with the spans a model is trained on.

Control strings inside roles and texts are escaped: a mark goes behind the first character of each place where one begins, and
backslashes are doubled, so that no text can open or close a turn and every text can be read back exactly.

Turns are rendered in order of ``turn`` (equal or null turns by role and text, nulls first); a null text or role is empty; rows of a
null conversation id are one conversation; a repeated row is a turn of its own; an empty table gives no rows. Columns besides
``conv_id, turn, role, text`` are ignored. A conversation's turns meet in one task, which renders them one by one: a conversation of any
length needs memory for its longest turn only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.shared import arrow_schema
from stockloom.llm.templates import TemplateError, compile_template

# Strings that some tokenizer or template gives a meaning.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TURN, TEXT, END = CONTROL[:3]

TEMPLATE = """
{%- for message in messages -%}
  {{ turn }}{{ message.role | escape }}{{ text }}
  {%- if message.role == 'assistant' -%}
    {% generation %}{{ message.content | escape }}{% endgeneration %}
  {%- else -%}
    {{ message.content | escape }}
  {%- endif -%}
  {{ end }}
{%- endfor -%}
"""
CONSTANTS = {"turn": TURN, "text": TEXT, "end": END}

PIECE_CHARS = 1 << 16


class Escape:
    """Reversible escaping of control strings.

    No control string may hold a backslash or begin inside another's end, else one could arise where text meets template.
    """

    def __init__(self, control: tuple[str, ...] = CONTROL):
        for a in control:
            if len(a) < 2 or "\\" in a:
                raise TemplateError(f"{a!r} cannot be escaped")
            for b in control:
                if any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a)):
                    raise TemplateError(f"{b!r} can begin inside {a!r}")
        begins = "|".join(map(re.escape, control))
        self.find = re.compile(rf"(\\)|(?=(?:{begins}))(.)", re.S)
        self.back = re.compile(r"\\(\\|_)")

    def __call__(self, text: str | None) -> str:
        return self.find.sub(lambda m: r"\\" if m[1] else m[2] + r"\_", text or "")

    def undo(self, text: str) -> str:
        return self.back.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def turns(conversations: DataFrame) -> DataFrame:
    """The rows by conversation and turn, each conversation in one partition."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True)


PIECES = "conv_id long, piece int, formatted string, start long, loss array<struct<start:long,end:long>>"


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, constants: dict[str, str] | None = None, control: tuple[str, ...] = CONTROL
) -> DataFrame:
    """Formatted conversations with the spans of generated text.

    One row for every 64 K characters or so of a conversation: ``piece`` counts from 0, ``start`` is the place of the piece in the
    conversation and ``loss`` has the spans inside the piece, counted from the conversation's start. No output of the template is
    cut. Rows keep the order of conversations and pieces inside a partition.
    """
    target = arrow_schema(PIECES)
    names = dict(CONSTANTS if constants is None else constants)
    compile_template(template, {"escape": str, "trim": str}, names)  # a wrong template fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape(control)
        render = compile_template(template, {"escape": escape, "trim": lambda x: (x or "").strip()}, names)
        out: list[dict] = []
        held = 0
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": r[2], "content": r[3]} for r in rows)
            piece = start = 0
            texts: list[str] = []
            at, loss = 0, []
            for text, generated in render({"messages": messages}):
                if at - start >= PIECE_CHARS:
                    out.append({"conv_id": conv_id, "piece": piece, "formatted": "".join(texts), "start": start, "loss": loss})
                    piece, start, texts, loss = piece + 1, at, [], []
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out, held = [], 0
                texts.append(text)
                if generated:
                    loss.append({"start": at, "end": at + len(text)})
                at += len(text)
            out.append({"conv_id": conv_id, "piece": piece, "formatted": "".join(texts), "start": start, "loss": loss})
            held += at - start
            if held > PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return turns(conversations).mapInArrow(run, PIECES)


def read_turns(pieces: Iterator[tuple[str, list[dict], int]], escape: Escape) -> Iterator[tuple[str, str]]:
    """Role and text of every turn in the pieces of one conversation of the default template."""
    marks = re.compile("(" + "|".join(map(re.escape, (TURN, TEXT, END))) + ")")
    role, kept, inside = "", [], False
    for formatted, _, _ in pieces:
        for part in marks.split(formatted):
            if part == TURN or part == TEXT:
                if part == TEXT:
                    role = escape.undo("".join(kept))
                kept, inside = [], True
            elif part == END:
                yield role, escape.undo("".join(kept))
                kept, inside = [], False
            elif inside:
                kept.append(part)
            elif part:
                raise ValueError("text outside of turns")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from the rows of :func:`format_conversations`, in their order."""
    target = arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = Escape()
        out = []
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            turns_, loss = hashlib.sha256(), hashlib.sha256()
            count = {"turns": 0, "loss": 0, "chars": 0}

            def pieces(rows=rows, loss=loss, count=count) -> Iterator[tuple[str, list[dict], int]]:
                for _, _, text, start, spans in rows:
                    count["chars"] += len(text)
                    for s in spans:
                        learned = escape.undo(text[s["start"] - start : s["end"] - start])
                        count["loss"] += len(learned)
                        loss.update(learned.encode("utf-8", "surrogatepass"))
                    yield text, spans, start

            for role, text in read_turns(pieces(), escape):
                count["turns"] += 1
                turns_.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            out.append((conv_id, count["turns"], turns_.hexdigest(), count["loss"], loss.hexdigest(), count["chars"]))
            if len(out) >= 1000:
                yield _batch(out, target)
                out = []
        if out:
            yield _batch(out, target)

    return formatted.mapInArrow(run, DIGEST)


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

