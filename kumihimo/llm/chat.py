"""Operator 5: chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of the turns'
token counts give, for each window, the last turn that still fits the budget;
each window opens with the system turn, repeats as many of the turns before
its first new one as fit ``history`` tokens, and then holds new turns. Only
new assistant turns are under the loss mask, so each is a target once.

Template: ``<s>role\\ntext</s>`` for each turn. Reversible escapes keep texts
and roles from looking like the template: each backslash is doubled, and a
backslash goes after the first character of each control string in CONTROL.

Rows are dealt by conversation and sorted by turn, and each task reads them as
a stream, a turn at a time: a conversation of any length needs the memory of
one window. (Its digest is one pass over its turns in order, so one task.)

Defined cases: null text and null role are empty; a turn that alone exceeds
the budget has a window of its own; rows with the same conv_id and turn are
all kept, ordered by role and text; null turn numbers come first; a conversation
without assistant turns has no targets (loss digest of the empty text); a
null conv_id is a conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGET = 512
HISTORY = 128
CONTROL = ("<<SYS>>", "<</SYS>>", "[/INST]", "[INST]", "</s>", "<s>")

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<s>(.*?)\n(.*?)</s>", re.S)

WINDOWS = "conv_id long, window long, first_turn long, n_repeated int, n_turns int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """Double backslashes, then break control strings with one."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _escape_role(role: str) -> str:
    """A role also has no line break of its own: it ends at the first one."""
    return escape(role.replace("&", "&amp;").replace("\n", "&#10;"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("&#10;", "\n").replace("&amp;", "&")


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The tokenizer's pattern runs out of stack on longer runs of white space.
_RUN = 10_000
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % _RUN)


def encode(coder, text: str) -> list[int]:
    """Token ids of a text. A long run of white space is encoded as the piece that the pattern takes it for: all of it but the last character, if more follows."""
    if len(text) < _RUN:
        return coder.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in _SPACES.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += coder.encode_ordinary(text[at : m.start()])
        out += coder._encode_single_piece(text[m.start() : end])
        at = end
    return out + coder.encode_ordinary(text[at:])


class _Cut:
    """Cuts one conversation's turns, as they come, into windows; holds a window's turns and the history only."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.turns: list[tuple[str, str, int]] = []  # held turns: role, text, tokens
        self.first = 0  # number of the first held turn
        self.new = 0  # number of the first turn that is in no window yet
        self.system: tuple[str, str, int] | None = None
        self.n = 0

    def add(self, turn: tuple[str, str, int]):
        if self.n == 0 and turn[0] == "system":
            self.system = turn
        self.turns.append(turn)
        self.n += 1
        while sum(t[2] for t in self.turns[self.new - self.first :]) > 2 * self.budget and self.n - self.new > 1:
            yield self._next()

    def end(self):
        while self.new < self.n:
            yield self._next()

    def _next(self):
        lead = self.system is not None and self.first > 0
        held = ([self.system] if lead else []) + self.turns
        shift = self.first - (1 if lead else 0)
        at = self.new - shift
        tokens = [t[2] for t in held]
        back, _, end = _window_at(tokens, at, self.system is not None, self.budget, self.history)
        window = [self.system] * (self.system is not None and at > 0) + held[back:end]
        made = (self.new, len(window) - (end - at), window)
        self.new += end - at
        # of the turns in windows, those that the next one may repeat stay
        low, kept = self.new - self.first, 0
        while low > 0 and kept + self.turns[low - 1][2] <= self.history:
            low -= 1
            kept += self.turns[low][2]
        self.turns, self.first = self.turns[low:], self.first + low
        return made


def _window_at(tokens: list[int], at: int, system: bool, budget: int, history: int) -> tuple[int, int, int]:
    total = np.append(0, np.cumsum(np.asarray(tokens, np.int64)))
    n, low = len(tokens), int(system)
    head = int(tokens[0]) if system and at > 0 else 0
    back = at
    if at > low:
        back = min(max(int(np.searchsorted(total, total[at] - history, "left")), low), at)
    end = int(np.searchsorted(total, total[back] + budget - head, "right")) - 1
    while end <= at and back < at:  # the first new turn matters more than history
        back += 1
        end = int(np.searchsorted(total, total[back] + budget - head, "right")) - 1
    return back, at, min(max(end, at + 1), n)


def _row(conv, number: int, first: int, repeated: int, turns) -> tuple:
    text, loss = [], []
    at = 0
    for k, (role, body, _) in enumerate(turns):
        head, tail = f"<s>{_escape_role(role)}\n", escape(body)
        if k >= repeated and role == "assistant":
            loss.append({"start": at + len(head), "end": at + len(head) + len(tail)})
        text.append(f"{head}{tail}</s>")
        at += len(head) + len(tail) + 4
    return conv, number, first, repeated, len(turns), sum(t[2] for t in turns), "".join(text), loss


def _format(budget: int, history: int, vocabulary: str):
    def run(batches):
        count = encoder(vocabulary)
        cut, conv, number = None, None, 0
        out: list[tuple] = []
        size = 0

        def made():
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "window", "first_turn", "n_repeated", "n_turns", "n_tokens", "text", "loss"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for c, role, text in zip(*(part.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if cut is None or c != conv:
                        for w in cut.end() if cut else ():
                            out.append(_row(conv, number, *w))
                            number += 1
                        cut, conv, number = _Cut(budget, history), c, 0
                    role, text = role or "", text or ""
                    tokens = len(encode(count, f"{role}\n{text}")) + 2
                    for w in cut.add((role, text, tokens)):
                        out.append(_row(conv, number, *w))
                        number += 1
                    size += len(text)
                if out and size > 1 << 20:
                    yield made()
                    out, size = [], 0
        for w in cut.end() if cut else ():
            out.append(_row(conv, number, *w))
            number += 1
        if out:
            yield made()

    return run


def format_chat(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, turn, role, text -> one row for each window: its text, and the spans under the loss mask (code points, end exclusive)."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(budget, history, vocabulary), WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, unescaped."""
    return [(_unescape_role(a), unescape(b)) for a, b in _TURN.findall(text)]


def _read(batches):
    conv, state = None, None
    done: list[tuple] = []

    def result():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    def made():
        columns = list(zip(*done, strict=True))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

    encode = lambda s: s.encode("utf-8", "surrogatepass")
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for c, repeated, text, loss in zip(*(part.column(k).to_pylist() for k in (0, 3, 6, 7)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(result())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(encode(f"{role}\n{body}\n"))
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(encode(target))
                state[4] += len(text)
                state[5] += 1
        if len(done) > 1000:
            yield made()
            done = []
    if state is not None:
        done.append(result())
    if done:
        yield made()


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that tries to forge control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", forged), (-7, 1, "assistant", forged)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(given.unionByName(more)))
