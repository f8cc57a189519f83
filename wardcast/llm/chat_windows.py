"""Conversations as training windows under a token budget.

Prefix sums of the turns' tokens choose spans of whole turns; every window starts with the
system turn, repeats a limited stretch of history, and masks what it repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: a turn is OPEN role NEWLINE text CLOSE. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates, which no text may contain as such.
CONTROL = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes and puts ``\\-`` into each control string after its first character."""
    return _STARTS.sub(lambda m: m[0] + "\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\\-n])", lambda m: {"\\": "\\", "-": "", "n": "\n"}[m[1]], text)


def escape_role(role: str) -> str:
    """As a text, and on one line, since the role ends at the line's end."""
    return escape(role).replace("\n", "\\n")


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how many of them may repeat earlier turns."""

    tokens: int = 2048
    history: int = 512


WINDOWS = (
    "conv_id bigint, window int, text string, tokens bigint, repeated int, turns int, "
    "loss array<struct<start:bigint,end:bigint>>"
)


def token_counts(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``turns`` with the tokens of each turn under a byte-level vocabulary of ranks."""

    def run(batches: Iterator):
        import pyarrow as pa

        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(encoding.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int32())], names=[*batch.schema.names, "tokens"]
            )

    return turns.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, tokens int")


def _encoding(vocabulary: str, pattern: str):
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Conversation:
    """Builds the windows of one conversation turn by turn; holds one window at most."""

    def __init__(self, conv_id, budget: Budget):
        self.id, self.budget = conv_id, budget
        self.window = 0
        self.system: tuple[str, str, int] | None = None
        self.history: list[tuple[str, str, int]] = []  # earlier turns that this window repeats
        self.fresh: list[tuple[str, str, int]] = []
        self.sum = 0  # tokens of the window so far
        self.begun = False

    def add(self, role: str, text: str, tokens: int):
        turn = (role, text, tokens)
        if not self.begun and role == "system":
            self.begun, self.system, self.sum = True, turn, tokens
            self.fresh.append(turn)
            return
        self.begun = True
        if self.fresh and self.sum + tokens > self.budget.tokens:
            yield self.close()
            self.carry(tokens)
        self.fresh.append(turn)
        self.sum += tokens

    def carry(self, coming: int) -> None:
        """The last turns, as many as the history budget and the coming turn leave room for."""
        fixed = self.system[2] if self.system else 0
        room = min(self.budget.history, self.budget.tokens - fixed - coming)
        past = [*self.history, *self.fresh]
        if past and past[0] is self.system:
            past = past[1:]
        self.history, used = [], 0
        for turn in reversed(past):
            if used + turn[2] > room:
                break
            self.history.insert(0, turn)
            used += turn[2]
        self.fresh, self.sum = [], fixed + used
        self.window += 1

    def close(self):
        """The window as a row; the mask has the assistant texts that it shows first."""
        again = ([self.system] if self.system and self.window else []) + self.history
        parts, loss, at = [], [], 0
        for k, (role, text, _) in enumerate([*again, *self.fresh]):
            head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
            if k >= len(again) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        return (self.id, self.window, "".join(parts), self.sum, len(again), len(self.fresh), loss)


def windows(turns: DataFrame, vocabulary: str, pattern: str, budget: Budget = Budget()) -> DataFrame:
    """Windows (conv_id, window, text, tokens, repeated, turns, loss) of all conversations.

    ``text`` is the formatted window, ``repeated`` its turns that earlier windows show
    (system turn and history), ``turns`` the new ones, ``loss`` the places of the targets in
    code points. Each turn is new in exactly one window, each assistant text is in one mask.
    A turn is never cut: one over the budget has a window of its own with the system turn.

    Turns are ordered by turn, a null first, then role and text, so repeated rows and ties
    have one order. Null roles and texts count as empty; a null conv_id is a conversation
    too. Further columns are not read; empty tables give an empty result. A conversation is
    streamed through a task in order, which holds a window at a time.
    """
    plain = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = token_counts(plain, vocabulary, pattern)
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator):
        import pyarrow as pa

        out = _Rows(pa)
        current = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")]
            for conv_id, role, text, tokens in zip(*columns, strict=True):
                if current is None or conv_id != current.id:
                    if current is not None:
                        yield from out.add(current.close())
                    current = _Conversation(conv_id, budget)
                for row in current.add(role, text, tokens):
                    yield from out.add(row)
        if current is not None:
            yield from out.add(current.close())
        yield from out.rest()

    return ordered.mapInArrow(run, WINDOWS)


class _Rows:
    """Rows as batches of a few megabytes."""

    def __init__(self, pa, most: int = 1 << 22):
        self.pa, self.most, self.rows, self.chars = pa, most, [], 0

    def add(self, row):
        self.rows.append(row)
        self.chars += len(row[2])
        if self.chars >= self.most:
            yield from self.rest()

    def rest(self):
        if self.rows:
            pa = self.pa
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), spans]
            names = ["conv_id", "window", "text", "tokens", "repeated", "turns", "loss"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)], names=names
            )
            self.rows, self.chars = [], 0


def parsed(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_windows bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read from windows as :func:`windows` leaves them.

    The windows of a conversation must be together and in order, which the result of
    :func:`windows` is; windows read from a file go through :func:`in_order` first.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        names = [f.split()[0] for f in DIGESTS.split(", ")]
        current, rows = None, []
        for batch in batches:
            for w in batch.to_pylist():
                if current is None or w["conv_id"] != current.id:
                    if current is not None:
                        rows.append(current.row())
                    current = _Digest(w["conv_id"])
                current.add(w)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_digest_schema(pa))
            rows = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, current.row(), strict=True))], schema=_digest_schema(pa))

    return formatted.mapInArrow(run, DIGESTS)


def in_order(formatted: DataFrame) -> DataFrame:
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")


def _digest_schema(pa):
    return pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
            ("n_windows", pa.int64()),
        ]
    )


class _Digest:
    def __init__(self, conv_id):
        self.id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_windows = 0

    def add(self, w: dict) -> None:
        for role, text in parsed(w["text"])[w["repeated"] :]:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in w["loss"]:
            target = unescape(w["text"][span["start"] : span["end"]])
            self.loss.update(target.encode())
            self.loss_chars += len(target)
        self.chars += len(w["text"])
        self.n_windows += 1

    def row(self) -> tuple:
        return (self.id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_windows)
