"""Conversations formatted for training by a compiled template, and read back.

The template (see ``templates``) renders a conversation's turns as a stream of pieces; pieces between
generation tags are the ones to learn from. The output is a table of chunks: conv_id, chunk (from 0),
text, and loss, the (start, end) code points in the chunk of what is learned. A chunk is closed at
``CHUNK`` characters, and holds pieces whole; a conversation that holds a third of all rows is so many
chunks, and a task holds one of them at a time. Its turns are rendered by one task, since a template
may look at their number and their end; Spark sorts them.

The standard template marks turns with ``<|im_start|>`` and ``<|im_end|>``. Texts and roles are escaped
reversibly: each ``<`` that is followed by backslashes, or none, and a bar gets one backslash more, so
no text holds a mark; in roles, backslashes and line breaks are written ``\\\\`` and ``\\n``.

Defined results: turns are ordered by turn (nulls first), then role and text; null roles and texts
are empty; a null conversation id is a conversation like others; repeated rows are turns of their own;
texts are whole, however long. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlight.llm.repair import batched, conversations
from hearthlight.llm.templates import compile_template

CHUNK = 1 << 20
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TEMPLATE = f"""{{% for message in messages %}}{OPEN}{{{{ message.role | line }}}}
{{% if message.role == 'assistant' %}}{{% generation %}}{{{{ message.text | escape }}}}{{% endgeneration %}}{{% else %}}{{{{ message.text | escape }}}}{{% endif %}}{CLOSE}
{{% endfor %}}"""
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(?=\\*\|)", r"<\\", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(?=\\*\|)", "<", text)


def escape_line(text: str) -> str:
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS = {"escape": escape, "line": escape_line}


def chunks(pieces: Iterable[tuple[str, bool]], most: int = CHUNK) -> Iterator[tuple[int, str, list[dict]]]:
    """(chunk, text, loss) of a rendered conversation."""
    texts: list[str] = []
    loss: list[dict] = []
    number = at = 0
    for text, marked in pieces:
        if marked and text:
            loss.append({"start": at, "end": at + len(text)})
        texts.append(text)
        at += len(text)
        if at >= most:
            yield number, "".join(texts), loss
            texts, loss, number, at = [], [], number + 1, 0
    if texts or not number:
        yield number, "".join(texts), loss


def _sorted(rows: DataFrame, *order) -> DataFrame:
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    return rows.select(key, *rows.columns).repartition("conv").sortWithinPartitions("conv", *order)


def format_conversations(rows: DataFrame, template: str = TEMPLATE, chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk, text, loss of all conversations."""
    compile_template(template, FILTERS)  # a wrong template ends here, not in a task
    kind = rows.schema["conv_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)

        def formatted() -> Iterator[tuple]:
            for first, turns in conversations(batches, ("conv", "role", "text")):
                messages = ({"role": role, "text": text} for _, role, text in turns)
                for row in chunks(render(messages), chunk):
                    yield first, row

        yield from batched(formatted(), (pa.int64(), pa.string(), spans), ["conv_id", "chunk", "text", "loss"])

    plain = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return _sorted(plain, F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(
        work, f"conv_id {kind}, chunk bigint, text string, loss array<struct<start: bigint, end: bigint>>"
    )


def _turns(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; a turn may lie in several chunks."""
    held: list[str] = []
    for part in parts:
        held.append(part)
        if not part.endswith(f"{CLOSE}\n") and CLOSE not in part:
            continue
        text, end = "".join(held), 0
        for match in _TURN.finditer(text):
            if match.start() != end:
                raise ValueError("text between turns")
            yield unescape_line(match[1]), unescape(match[2])
            end = match.end()
        held = [text[end:]]
    if "".join(held):
        raise ValueError("a turn is not closed")


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of what the standard template has formatted."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for first, rows in conversations(batches, ("conv", "text")):
                for place, (role, text) in enumerate(_turns(text for _, text in rows)):
                    yield first, (place, role, text)
        yield from batched(turns(), (pa.int64(), pa.string(), pa.string()), ["conv_id", "place", "role", "text"])

    return _sorted(formatted, "chunk").mapInArrow(work, f"conv_id {kind}, place bigint, role string, text string")


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the formatted text, one row per conversation: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(rows: Iterable[tuple]) -> tuple:
        turns, loss, n, learned, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def parts() -> Iterator[str]:
            nonlocal learned, size
            for _, text, spans in rows:
                size += len(text)
                for span in spans:
                    plain = unescape(text[span["start"]:span["end"]])
                    learned += len(plain)
                    loss.update(plain.encode())
                yield text

        for role, text in _turns(parts()):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        return n, turns.hexdigest(), learned, loss.hexdigest(), size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((first, read(rows)) for first, rows in conversations(batches, ("conv", "text", "loss")))
        yield from batched(
            found, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()),
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    return _sorted(formatted, "chunk").mapInArrow(work, (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    ))
