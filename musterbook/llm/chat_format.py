"""Chat turns as marked text that parses back to exactly the turns.

Grammar (a turn is opened and closed by control strings, texts lie between)::

    conversation = turn*
    turn         = "<s>[INST] " text " [/INST]"              role user
                 | "<s>[ANSW] " text " [/ANSW]</s>"           role assistant
                 | "<s>[ROLE] " text " [:] " text " [/ROLE]"  any other role, its name first
    text         = characters; a backslash makes the next one literal

Round trip: a turn is rendered as it is and parsed again; while the parse differs from the
source, more of the text is escaped: first backslashes, then the first character of
every control string, then every character of one. The parser is deterministic and reads a
turn up to its own closing string, so turns parse the same alone and in a row.

Each turn is rendered by itself, so a conversation of any length is never held in one place. Reading
back sorts a conversation's turns and digests them one after the other.

Defined results: a NULL text is empty, a NULL role is the empty role; turns that share a number keep a
fixed order (that of their marked texts); a NULL conversation id is a conversation of its own; a NULL turn
comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = {"user": "<s>[INST] ", "assistant": "<s>[ANSW] "}
CLOSE = {"user": " [/INST]", "assistant": " [/ANSW]</s>"}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "<s>[ROLE] ", " [:] ", " [/ROLE]"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ANSW]", "[/ANSW]", "[ROLE]", "[/ROLE]", "[:]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str, level: int) -> str:
    """0: as it is; 1: backslashes; 2: also the first character of control strings; 3: all special characters."""
    if level >= 1:
        text = text.replace("\\", "\\\\")
    if level == 2:
        text = _CONTROL.sub(lambda m: "\\" + m[0], text)
    if level >= 3:
        text = re.sub(r"[<>\[\]/: ]", lambda m: "\\" + m[0], text)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends."""
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        head, tail = f"{OTHER_OPEN}{escape(role, level)}{OTHER_MIDDLE}", OTHER_CLOSE
    body = escape(text, level)
    return head + body + tail, len(head), len(head) + len(body)


def _until(s: str, at: int, stop: str) -> int | None:
    """Place of the next unescaped ``stop``; None if another control string comes before it, or the end does."""
    while at < len(s):
        if s[at] == "\\":
            at += 2
        elif s.startswith(stop, at):
            return at
        elif s[at] in "<[" and _CONTROL.match(s, at):
            return None
        else:
            at += 1
    return None


def parse(s: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, start, end of the text in ``s``) of a marked text; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(s):
        for role, head in [*OPEN.items(), (None, OTHER_OPEN)]:
            if s.startswith(head, at):
                break
        else:
            return None
        at += len(head)
        if role is None:
            stop = _until(s, at, OTHER_MIDDLE)
            if stop is None:
                return None
            role, at, tail = unescape(s[at:stop]), stop + len(OTHER_MIDDLE), OTHER_CLOSE
            if role in OPEN:
                return None
        else:
            tail = CLOSE[role]
        stop = _until(s, at, tail)
        if stop is None:
            return None
        turns.append((role, unescape(s[at:stop]), at, stop))
        at = stop + len(tail)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The least escaped rendering that parses back to the turn."""
    for level in range(4):
        marked, start, end = render(role, text, level)
        if parse(marked) == [(role, text, start, end)]:
            return marked, start, end
    raise ValueError("a turn does not survive its round trip")


def format_turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per turn: ``conv_id``, ``turn``, ``formatted`` and the loss mask inside it (``loss_start``, ``loss_end``).

    A conversation's marked text is its rows' ``formatted`` in order, nothing between. The mask
    covers the texts of the assistant; it is empty elsewhere.
    """

    def run(batches):
        for batch in batches:
            out = [
                format_turn(r or "", t or "")
                for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())
            ]
            learned = [r == "assistant" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array([m for m, _, _ in out], pa.string()),
                    pa.array([a if x else 0 for (_, a, _), x in zip(out, learned)], pa.int64()),
                    pa.array([b if x else 0 for (_, _, b), x in zip(out, learned)], pa.int64()),
                ],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )

    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    )
    return turns.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of what a reader of the marked text and its mask recovers.

    A task streams its sorted turns and holds one at a time. A digest over a conversation is one
    sequence by definition, so a conversation is read by one task, in bounded memory.
    """

    def run(batches):
        state = None
        done = []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")))
            for conv, marked, a, b in rows:
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(marked)
                if turns is None:
                    raise ValueError(f"conversation {conv} does not follow the grammar")
                for role, text, _, _ in turns:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(marked[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(marked)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if state is not None:
            yield batch_of([*done, closed(state)])

    def closed(s):
        return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema)
