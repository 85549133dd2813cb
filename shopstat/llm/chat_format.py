"""Chat formatting in budgeted windows (operator 3).

Turns are counted in tokens (operator 6's encoder) before any shuffle, then
streamed per conversation in turn order.  Prefix sums of the counts choose
each window's span of whole turns: the system turn (a first turn with that
role) is kept in every window, then come as many earlier turns as fit into
``history`` tokens, then the new turns that the rest of ``budget`` holds.  A
turn that alone exceeds the budget gets a window with the system turn only.
The loss mask covers the texts of the window's new assistant turns, so each
is a target once; repeated turns are context.

A turn is written ``<|im_start|>role``, a line feed, the text and
``<|im_end|>``, a line feed.  Inside texts and roles ``<|`` gets a backslash
between its two characters (and ``<\\|`` one more), which is undone when
reading; roles also escape backslashes and line feeds.

A conversation is sequential (its windows depend on each other), but it
streams: a task holds the turns of one window and its history only.

Defined results: null texts and roles are empty; turns are ordered by turn,
then role, then text (nulls first); repeated rows are turns of their own; a
null ``conv_id`` is one conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.llm import bpe
from shopstat.llm.common import materialise

BUDGET, HISTORY = 1024, 256
TURN_TOKENS = 6                 # what markers and role add to a turn
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of a window's turns, start and end of the written text."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


class _Conversation:
    """The open part of one conversation: history and turns not yet written."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []    # history, then pending
        self.sums = [0]                                # prefix sums of the turns' tokens
        self.new = 0                                   # where the pending turns begin
        self.windows = 0
        self.started = False

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        if not self.started:
            self.started = True
            if role == "system":
                # a target of its own window, context of the later ones
                self.system = (role, text, tokens)
                return
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)
        # a window is complete once the pending turns can't fit into any
        while self.sums[-1] - self.sums[self.new] > self.budget and len(self.turns) - self.new > 1:
            yield self._window()

    def finish(self) -> Iterator[dict]:
        while self.new < len(self.turns):
            yield self._window()
        if self.system is not None and not self.windows:
            yield self._window()

    def _window(self) -> dict:
        fixed = self.system[2] if self.system else 0
        sums, new = np.asarray(self.sums), self.new
        first = int(np.searchsorted(sums, sums[new] - self.history)) if new else 0
        room = self.budget - fixed - int(sums[new] - sums[first])
        last = int(np.searchsorted(sums, sums[new] + room, side="right")) - 1
        if last <= new < len(self.turns):
            # the next turn doesn't fit beside the history: without it, and alone if need be
            first = new
            last = max(new + 1, int(np.searchsorted(sums, sums[new] + self.budget - fixed, side="right")) - 1)
        last = min(max(last, new), len(self.turns))
        shown = self.turns[first:last]
        context = new - first
        if self.system is not None:
            shown = [self.system, *shown]
            context += 1 if self.windows else 0
        out, spans, at = [], [], 0
        for k, (role, text, _) in enumerate(shown):
            written, a, b = write_turn(role, text)
            # with the system turn new, the history before it is empty, so context turns always lead
            if k >= context and role == "assistant":
                spans.append({"start": at + a, "end": at + b})
            out.append(written)
            at += len(written)
        row = {"conv_id": self.conv_id, "window": self.windows, "context_turns": context,
               "n_tokens": fixed + int(sums[last] - sums[first]), "text": "".join(out), "loss_spans": spans}
        self.windows += 1
        # keep what later windows may repeat
        keep = int(np.searchsorted(sums, sums[last] - self.history))
        self.turns, self.sums, self.new = self.turns[keep:], (sums[keep:] - sums[keep]).tolist(), last - keep
        return row


def _window_schema(conv: T.StructField) -> T.StructType:
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return T.StructType([T.StructField("conv_id", conv.dataType), T.StructField("window", T.LongType()),
                         T.StructField("context_turns", T.IntegerType()), T.StructField("n_tokens", T.LongType()),
                         T.StructField("text", T.StringType()), T.StructField("loss_spans", T.ArrayType(span))])


def _with_tokens(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    vocabulary = bpe.broadcast_vocabulary(turns.sparkSession, path, pattern)
    schema = T.StructType([*turns.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (_, starts) in bpe.encoded_batches(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(starts) + TURN_TOKENS, pa.int64())], names=schema.names)
    return turns.mapInArrow(run, schema)


def format_conversations(turns: DataFrame, path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of every conversation: ``conv_id, window, context_turns,
    n_tokens, text, loss_spans`` (code points of ``text``)."""
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (_with_tokens(given, path, pattern).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    schema = _window_schema(turns.schema["conv_id"])
    arrow = pa.schema([("conv_id", _arrow_type(turns.schema["conv_id"].dataType)), ("window", pa.int64()), ("context_turns", pa.int32()),
                       ("n_tokens", pa.int64()), ("text", pa.string()),
                       ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Conversation | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if open_ is None or row["conv_id"] != open_.conv_id:
                    if open_ is not None:
                        out += open_.finish()
                    open_ = _Conversation(row["conv_id"], budget, history)
                out += open_.add(row["role"], row["text"], row["n_tokens"])
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist(list(open_.finish()), arrow)
    return ordered.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from the windows alone."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    conv = windows.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [_arrow_type(conv), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def closed() -> dict:
            return dict(zip(names, [state["conv_id"], state["n"], state["all"].hexdigest(), state["loss_chars"],
                                    state["loss"].hexdigest(), state["chars"], state["windows"]]))
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != state["conv_id"]:
                    if state is not None:
                        done.append(closed())
                    state = {"conv_id": row["conv_id"], "n": 0, "all": hashlib.sha256(), "loss_chars": 0,
                             "loss": hashlib.sha256(), "chars": 0, "windows": 0}
                for role, text, _, _ in read_turns(row["text"])[row["context_turns"]:]:
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for span in row["loss_spans"]:
                    target = unescape(row["text"][span["start"]:span["end"]])
                    state["loss_chars"] += len(target)
                    state["loss"].update(target.encode())
                state["chars"] += len(row["text"])
                state["windows"] += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)
    ddl = f"conv_id {conv.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    return ordered.mapInArrow(run, ddl)


def report(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Format all conversations, write the windows, read them back."""
    windows = materialise(format_conversations(turns, path, pattern), "chat-windows")
    return read_back(windows)
