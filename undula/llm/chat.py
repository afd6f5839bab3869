"""Chat formatting: budgeted, turn-aligned windows with a loss mask over each assistant turn once.

A window holds the system turn, the last turns before it that fit ``history`` tokens, repeated and without loss, and
as many new turns as prefix sums of their tokens allow within ``budget``; a turn longer than that is a window of its
own. The system turn is in every window, whatever its size: where it leaves less than ``history`` tokens for new turns,
windows hold that many all the same and go over the budget by what it needs, so the output grows with the system turn's
size times the conversation's. Control strings inside roles and texts are escaped reversibly: a backslash is doubled, and one is put behind the
first character of every control string, so no text can end its turn or open another.

Rows of a conversation are sorted (spilling if need be) and streamed, so a conversation of any length takes bounded
memory; a conversation's digest is a sequence, so one conversation is one task's work.

Defined results: a null text or role is empty; turns go by (turn, role, text), nulls first; repeated rows are turns
of their own; a system turn that isn't first is a turn like any other; null conversation ids are one conversation;
ids keep their type; a text of any length is one turn, which a worker holds a few times; an empty table gives an empty
table; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that are escaped inside texts (fixed values).
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET = 1024
HISTORY = 128
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
#: Turns looked at together; windows may span several such blocks.
BLOCK_TURNS = 4096
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def tokens(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text)) + TURN_TOKENS


@dataclass
class Window:
    text: str
    repeated: int  # leading turns that an earlier window holds too
    loss: list[tuple[int, int]]  # spans of characters


def spans(sizes: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Turn-aligned spans of at most ``room`` tokens, or one turn, by prefix sums."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + room, "right")) - 1)
        yield a, b
        a = b


def render(turns: list[tuple[str, str]], repeated: int) -> Window:
    out, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if i >= repeated and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return Window("".join(out), repeated, loss)


def windows(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, count=tokens) -> Iterator[Window]:
    """The windows of one conversation, whose turns are (role, text)."""
    turns = iter(turns)
    held = list(itertools.islice(turns, BLOCK_TURNS))
    system = held[:1] if held and held[0][0] == "system" else []
    begins = len(system)
    room = max(1, budget - history - sum(count(t) for _, t in system), min(history, budget - history))
    past: list[tuple[str, str]] = []
    first = True
    while held:
        more = list(itertools.islice(turns, BLOCK_TURNS))
        done = 0
        for a, b in spans(np.array([count(t) for _, t in held], np.int64), room):
            if b == len(held) and more and a:  # the next block may go on with this window
                break
            again = _tail(past, history, count)
            kept = [] if first else system
            yield render([*kept, *again, *held[a:b]], len(kept) + len(again))
            past = [*past, *held[a:b][begins if first else 0 :]][-max(1, history // TURN_TOKENS) :]
            first, done = False, b
        held = held[done:] + more


def _tail(past: list[tuple[str, str]], history: int, count) -> list[tuple[str, str]]:
    total = np.cumsum([count(t) for _, t in reversed(past)])
    n = int(np.searchsorted(total, history, "right"))
    return past[len(past) - n :] if n else []


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a window; raises ``ValueError`` for other strings."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(text):
        raise ValueError("the window doesn't follow the template")
    return out


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, its rows) of rows that come sorted by their first column."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        own = row[0]

        def group(own=own):
            nonlocal row
            while row is not None and row[0] == own:
                yield row
                row = next(rows, None)

        g = group()
        yield own, g
        for _ in g:
            pass


def _out(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) + 64
        if size > 4 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def format_windows(df: DataFrame, key: str, turn: str, role: str, text: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(key, window, formatted, repeated, loss array<struct<start, end>>) of all conversations, in order within a task."""

    kind = df.schema[key].dataType

    def run(batches):
        def rows():
            for own, group in _conversations(batches):
                for n, w in enumerate(windows(((r or "", t or "") for _, r, t in group), budget, history)):
                    yield own, n, w.text, w.repeated, [{"start": a, "end": b} for a, b in w.loss]

        yield from _out(rows(), ["key", "window", "formatted", "repeated", "loss"], [to_arrow_type(kind), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))])

    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    return ordered.mapInArrow(run, f"key {kind.simpleString()}, window int, formatted string, repeated int, loss array<struct<start int, end int>>").withColumnRenamed("key", key)


def read_back(windows_: DataFrame, key: str) -> DataFrame:
    """Digests of each conversation from the rows of ``format_windows``, which must follow it without a shuffle."""
    kind = windows_.schema[key].dataType

    def run(batches):
        def rows():
            for own, group in _conversations(batches):
                turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, text, repeated, spans_ in group:
                    size += len(text)
                    for role, said, _, _ in parse(text)[repeated:]:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans_:
                        under = unescape(text[s["start"] : s["end"]])
                        loss.update(under.encode())
                        chars += len(under)
                yield own, n, turns.hexdigest(), chars, loss.hexdigest(), size

        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield from _out(rows(), names, [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    out = f"key {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return windows_.select(key, "formatted", "repeated", "loss").mapInArrow(run, out).withColumnRenamed("key", key)
