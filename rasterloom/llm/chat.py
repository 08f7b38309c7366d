r"""Chat formatting in budgeted windows.

A conversation's turns, in order, become windows of at most `budget` tokens. Prefix sums of the
turns' token counts choose spans that begin and end with whole turns. Each window opens with the
system turns, repeats earlier turns worth at most `history` tokens, then goes on with turns that no
window had. The loss mask covers assistant texts once: those repeated as history are masked out.

Template: `<|role|>` newline text `<|end|>` newline. In roles and texts `\` becomes `\\` and `|` becomes
`\|`, so control strings never occur inside them and the texts can be read back.

Conversations are sorted, not gathered: a task streams through its rows and holds the system turns
and one window, however long a conversation is. The turns of one conversation do meet in one task,
since its digest runs over all of them in order.

Defined results: null text and null role count as empty; null turns come last; turns that tie are
ordered by role and text; a turn above the budget gets a window of its own, whole; rows without
conv_id form one conversation; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOWS = "conv_id long, window int, text string, turn_from long, first_new int, loss array<int>, tokens long"
_TURN = re.compile(r"<\|((?:[^|\\]|\\.)*)\|>\n((?:[^|\\]|\\.)*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> str:
    return f"<|{escape(role)}|>\n{escape(text)}<|end|>\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first, end) of each turn; first and end bound the escaped text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return out


def count_tokens(text: str) -> int:
    """Words and single marks: the default measure of a turn."""
    return len(re.findall(r"\w+|[^\w\s]", text))


class _Windows:
    """Streams one conversation's turns into windows."""

    def __init__(self, budget: int, history: int, measure: Callable[[str], int]):
        self.budget, self.history, self.measure = budget, history, measure
        self.system: list[tuple[str, str]] = []
        self.system_tokens = self.window = self.seen = 0
        self.turns: list[tuple[str, str]] = []  # repeated history, then new turns
        self.sums = [0]  # prefix sums of their tokens
        self.old = 0  # how many of them are history

    def add(self, role: str, text: str):
        """Takes a turn; returns a window if the turn doesn't fit in it any more."""
        n = self.measure(role) + self.measure(text) + 2
        if role == "system" and not self.turns:
            self.system.append((role, text))
            self.system_tokens += n
            self.seen += 1
            return None
        done = None
        if len(self.turns) > self.old and self.system_tokens + self.sums[-1] + n > self.budget:
            done = self.close()
            # History: the longest run of whole turns within its limit that leaves room for the new turn.
            room = min(self.history, self.budget - self.system_tokens - n)
            first = int(np.searchsorted(np.array(self.sums), self.sums[-1] - max(room, 0), "left"))
            self.turns = self.turns[first:]
            self.sums = [s - self.sums[first] for s in self.sums[first:]]
            self.old = len(self.turns)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + n)
        self.seen += 1
        return done

    def close(self):
        """The window so far: (number, text, place of its first turn after the system turns, its first new turn, loss bounds, tokens)."""
        new = len(self.turns) - self.old
        if not new and (self.window or not self.system):
            return None
        parts, loss, at = [], [], 0
        for k, (role, text) in enumerate([*self.system, *self.turns]):
            piece = render(role, text)
            if role == "assistant" and k >= len(self.system) + self.old:
                first = at + len(f"<|{escape(role)}|>\n")
                loss += [first, at + len(piece) - len("<|end|>\n")]
            parts.append(piece)
            at += len(piece)
        fresh = len(self.system) + self.old if self.window else 0
        out = (self.window, "".join(parts), self.seen - len(self.turns) + 0, fresh, loss, self.system_tokens + self.sums[-1])
        self.window += 1
        return out


def format_chats(df: DataFrame, budget: int = 512, history: int = 96, measure: Callable[[str], int] = count_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The windows of every conversation. `first_new`: the first turn of a window that no earlier window had; `loss`: character bounds, pairwise."""
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(batches):
        key, state, out, held = object(), None, [], 0

        def take(window):
            nonlocal held
            if window is not None:
                out.append((key, *window))
                held += len(window[1])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if state is None or conv != key:
                    if state is not None:
                        take(state.close())
                    key, state = conv, _Windows(budget, history, measure)
                take(state.add(role, text))
                if held > 2 << 20:
                    yield _batch(out)
                    out, held = [], 0
        if state is not None:
            take(state.close())
        if out:
            yield _batch(out)

    return rows.mapInArrow(run, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
    names = [f.split()[0] for f in WINDOWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=names)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted texts and masks alone."""
    rows = windows.select("conv_id", "window", "text", "first_new", "loss").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")

    def run(batches):
        key, acc = object(), None

        def done():
            return (key, acc[0], acc[1].hexdigest(), acc[2], acc[3].hexdigest(), acc[4])

        for batch in batches:
            out = []
            for conv, text, new, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if acc is None or conv != key:
                    if acc is not None:
                        out.append(done())
                    key, acc = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                for role, said, _, _ in turns[new:]:
                    acc[0] += 1
                    acc[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(loss[::2], loss[1::2]):
                    plain = unescape(text[a:b])
                    acc[2] += len(plain)
                    acc[3].update(plain.encode("utf-8", "surrogatepass"))
                acc[4] += len(text)
            if out:
                yield _digest_batch(out)
        if acc is not None:
            yield _digest_batch([done()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=names)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts look like another template's control strings."""
    odd = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    cols = [F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    return conversations.select(*cols).unionByName(probe)
