"""Chat formatting from event logs.

A log row is one event of a conversation: ``message`` opens a message, ``delta`` appends streamed
text to one, ``edit`` replaces a message's text, ``regenerate`` empties a message and withdraws all
that were opened after it. Logs are partitioned by conversation and sorted by sequence; one pass over
the sorted rows folds each conversation into its final messages and renders them. A worker holds one
conversation at a time, whatever its partition holds.

Template: every message is ``### <role>: <text></turn>`` and a newline. In texts and roles a backslash
stands before each backslash and each control string (in roles also before colons), so the rendered
form can be read back exactly. The loss mask holds the assistant's texts.

Cases: a null text or role counts as empty; a null conversation id is a conversation of its own;
events of equal sequence go by message, event, role and text; a ``delta``, ``edit`` or ``regenerate`` of
an unknown message opens it; a null message id opens a new message with every event; an unknown event
counts as ``message``; ids may have any type that sorts; repeated rows are events of their own; an empty log gives no rows; only the
named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches

OPEN, CLOSE = "### ", "</turn>\n"
LOSS_ROLE = "assistant"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: The next control string that is not part of a text, or one that is.
TEXT_TOKEN = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")
ROLE_TOKEN = re.compile(r"\\(?:\\|###|</turn>|:)|: ")


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def fold(events: Iterator[tuple[str, object, str, str]]) -> list[tuple[str, str]]:
    """The final (role, text) messages of one conversation's events (event, message, role, text) in order."""
    messages: list[list] = []  # [role, pieces of text]
    place: dict[object, int] = {}
    for event, message, role, text in events:
        at = place.get(message) if message is not None else None
        if at is None:
            if message is not None:
                place[message] = len(messages)
            messages.append([role, [text]])
        elif event == "delta":
            messages[at][1].append(text)
        elif event == "regenerate":
            for gone in [m for m, i in place.items() if i > at]:
                del place[gone]
            del messages[at + 1 :]
            messages[at][1] = [text]
        else:
            messages[at] = [role or messages[at][0], [text]]
    return [(role, "".join(parts)) for role, parts in messages]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and start and length of the stretches under the loss mask."""
    parts, starts, lengths, at = [], [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role, ROLE_CONTROL)}: ", escape(text)
        if role == LOSS_ROLE:
            starts.append(at + len(head))
            lengths.append(len(body))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), starts, lengths


def _until(formatted: str, at: int, token: re.Pattern, stop: str) -> tuple[str, int]:
    begin = at
    while True:
        found = token.search(formatted, at)
        if found is None:
            raise ValueError("a formatted conversation is cut off")
        if found[0] == stop:
            return unescape(formatted[begin : found.start()]), found.end()
        at = found.end()


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    messages, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a message does not begin as the template has it")
        role, at = _until(formatted, at + len(OPEN), ROLE_TOKEN, ": ")
        text, at = _until(formatted, at, TEXT_TOKEN, CLOSE)
        messages.append((role, text))
    return messages


def format_conversations(events: DataFrame, conv: str = "conv_id", seq: str = "seq", event: str = "event", message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: its id, ``formatted``, and ``loss_start`` and ``loss_length`` (arrays, in code points)."""
    bound_batches(events.sparkSession)
    kind = events.schema[conv].dataType.simpleString()
    read = events.select(
        F.col(conv).alias("conv"),
        F.col(seq).alias("seq"),
        F.coalesce(F.col(event), F.lit("message")).alias("event"),
        F.col(message).cast("string").alias("message"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    ordered = read.repartition("conv").sortWithinPartitions("conv", "seq", "message", "event", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True))
        names = ["conv", "formatted", "loss_start", "loss_length"]
        made: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            kinds = [kind_of_conv, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        first = next(rows, None)
        while first is not None:
            current, following = first[0], []

            def own(first=first, current=current, following=following):
                yield first[1:]
                for row in rows:
                    if row[0] != current:
                        following.append(row)
                        return
                    yield row[1:]

            made.append((current, *render(fold(own()))))
            size += len(made[-1][1])
            first = following[0] if following else None
            if size > 4 << 20 or len(made) >= 2000:
                yield packed()
                made, size = [], 0
        if made:
            yield packed()

    kind_of_conv = to_arrow_type(events.schema[conv].dataType)
    out = ordered.mapInArrow(run, f"conv {kind}, formatted string, loss_start array<bigint>, loss_length array<bigint>")
    return out.withColumnRenamed("conv", conv)


def digests(formatted: DataFrame) -> DataFrame:
    """Read every formatted conversation back, and return counts and digests of what it holds."""

    def sha(parts: list[str]) -> str:
        total = hashlib.sha256()
        for part in parts:
            total.update(part.encode("utf-8", "surrogatepass"))
        return total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, starts, lengths in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                messages = read_back(text)
                loss = [unescape(text[a : a + n]) for a, n in zip(starts, lengths, strict=True)]
                made.append((len(messages), sha([x for r, t in messages for x in (r, "\n", t, "\n")]), sum(map(len, loss)), sha(loss), len(text)))
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    read = formatted.select("conv_id", "formatted", "loss_start", "loss_length")
    return read.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
