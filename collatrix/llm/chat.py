"""Chat formatting by event-sourced reconstruction.

A log has one event a row: its conversation, its place in the sequence, a kind and a target message. Logs are dealt out
by conversation and sorted by sequence, outside memory if need be, and folded one event after another:

* message: a new message with role and text (the default kind; a plain table of turns is a log of such events);
* delta: text that is appended to the target message;
* edit: text that replaces the target's;
* regenerate: as edit, and later messages of the conversation go, as an answer made anew drops what followed it.

The target is a message number of the conversation, counted from 0; null means the last one. A delta, edit or
regeneration without a message to act on is a message itself. Final messages are rendered as

    <|turn:ROLE|> TEXT <|end|>

without the blanks. In roles and texts `\\` becomes `\\\\`, `<` becomes `\\l`, `[` `\\b` and `|` `\\p`, so that no control
string of this template or of another (`</s>`, `[INST]`) can stand in a text, and `unescape` gets back what was there.
The loss mask is the spans of assistant texts as they stand in the output.

Every log goes through one fold. Of a log without kinds each message is final when the next one comes, so a conversation
of any length takes no more memory than its longest text. In a log with kinds a conversation holds its own messages until
it ends, as an edit may reach back to any of them.

Defined results: null roles and texts are empty; a null conversation is one of its own; equal places in the sequence
are ordered by role and text, so reruns agree and repeated rows are messages of their own; a null place comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"
ASSISTANT = "assistant"
ROWS_OUT = 2000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b").replace("|", "\\p")


def unescape(text: str) -> str:
    """The inverse of `escape`."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\l", "<").replace("\\b", "[").replace("\\p", "|") for part in text.split("\\\\"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """(output of one message, where its text begins and ends in it)."""
    head, body = f"{OPEN}{escape(role)}{CLOSE}", escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def read_back(chunk: str) -> tuple[str, str]:
    """(role, text) of the output of one message."""
    if not chunk.startswith(OPEN) or not chunk.endswith(END):
        raise ValueError("not the output of one message")
    role, _, body = chunk[len(OPEN) : -len(END)].partition(CLOSE)
    return unescape(role), unescape(body)


class Fold:
    """The state of one conversation's messages between its events.

    `feed` takes an event and returns the messages that no later event can reach, `close` the rest. In a log that can
    edit, any message can still change; in one of messages alone, each is final when the next one comes.
    """

    def __init__(self, edits: bool) -> None:
        self.edits, self.held = edits, []

    def feed(self, kind: str, target: int | None, role: str, text: str) -> list[tuple[str, str]]:
        at = len(self.held) - 1 if target is None else target
        if kind == "message" or not 0 <= at < len(self.held):
            done = [] if self.edits else self.close()
            self.held.append([role, text])
            return done
        if kind == "delta":
            self.held[at].append(text)
        else:
            self.held[at] = [self.held[at][0], text]
            if kind == "regenerate":
                del self.held[at + 1 :]
        return []

    def close(self) -> list[tuple[str, str]]:
        done = [(m[0], "".join(m[1:])) for m in self.held]
        self.held = []
        return done


CHUNKS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("output", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)


def format_chats(
    log: DataFrame,
    conversation: str = "conv_id",
    sequence: str = "turn",
    role: str = "role",
    text: str = "text",
    kind: str | None = None,
    target: str | None = None,
) -> DataFrame:
    """One row for each final message: the conversation, part (from 0), output, and where the loss mask begins and ends
    in it (null outside assistant messages). A conversation's output is its parts, one after another; rows of a
    conversation stand in one partition, in order."""
    if log.schema[sequence].dataType == T.StringType():
        raise ValueError("the sequence must have a numeric or time order")
    kind_column = F.coalesce(F.col(kind), F.lit("message")) if kind else F.lit("message")
    target_column = F.col(target).cast("long") if target else F.lit(None).cast("long")
    rows = log.select(
        F.col(conversation).alias("_conversation"),
        F.col(sequence).alias("_sequence"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        kind_column.alias("_kind"),
        target_column.alias("_target"),
    )
    dealt = rows.repartition("_conversation").sortWithinPartitions("_conversation", "_sequence", "_role", "_text")
    schema = T.StructType([T.StructField(conversation, log.schema[conversation].dataType), *CHUNKS.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [f.name for f in schema.fields]

        def put(conversation_id, part: int, role_text: tuple[str, str]) -> None:
            chunk, start, end = render(*role_text)
            loss = role_text[0] == ASSISTANT
            out.append((conversation_id, part, chunk, start if loss else None, end if loss else None))

        def flush(types: list[pa.DataType]) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        current, part, begun = None, 0, False
        state, types = Fold(kind is not None), None
        for batch in batches:
            types = types or [batch.schema.field("_conversation").type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for id_, *event in zip(*(batch.column(c).to_pylist() for c in ("_conversation", "_kind", "_target", "_role", "_text"))):
                if not begun or id_ != current:
                    for part, m in enumerate(state.close(), part):
                        put(current, part, m)
                    current, part, begun = id_, 0, True
                for m in state.feed(*event):
                    put(id_, part, m)
                    part += 1
                if len(out) >= ROWS_OUT:
                    yield flush(types)
        for part, m in enumerate(state.close(), part):
            put(current, part, m)
        if out:
            yield flush(types)

    return dealt.mapInArrow(run, schema)


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """For each conversation what its output says, read back from it; the rows must stand as `format_chats` left them."""
    kind = formatted.schema[conversation].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        begun, current = False, None
        key_type = None
        turns = loss = None
        counts = [0, 0, 0]

        def end() -> None:
            out.append((current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        def flush() -> pa.RecordBatch:
            types = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return made

        for batch in batches:
            key_type = key_type or batch.schema.field(conversation).type
            for id_, chunk, start, stop in zip(*(batch.column(c).to_pylist() for c in (conversation, "output", "loss_start", "loss_end"))):
                if not begun or id_ != current:
                    if begun:
                        end()
                    begun, current, turns, loss, counts = True, id_, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, text = read_back(chunk)
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
                counts[2] += len(chunk)
                if start is not None:
                    masked = unescape(chunk[start:stop])
                    loss.update(masked.encode())
                    counts[1] += len(masked)
            if len(out) >= ROWS_OUT:
                yield flush()
        if begun:
            end()
            yield flush()

    return formatted.mapInArrow(run, f"{conversation} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 16
            + length(regexp_replace(role || text, '[^\\<\[|]', '', 'g')) AS formatted
  FROM log
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
