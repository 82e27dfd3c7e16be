r"""Chat formatting on token ids.

A turn is laid out as  [turn] role ids [says] text ids [end]. Role and text are encoded apart from each other and
the marks are ids above the tokenizer's own, so nothing in a text can become a mark. The loss mask is the running sum
of +1 where an assistant's text starts and -1 where it ends, over all ids of an Arrow batch at once.

Marks also have a written form for people and text-only tools: "### role: text</turn>". Where a text holds such a
control string, a backslash is put before it, and backslashes that stand right before it are doubled: k become 2k+1;
those at a text's end, where a mark follows, become 2k. So a mark has an even number of backslashes before it and a
control string of a text an odd one. Taking the escapes out again halves them: every text, escaped-looking ones
included, comes back as it was, from the ids (`Reader`) and from the written form (`parsed`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, tidy, tokenizer_path

CONTROL = re.compile(r"(\\*)(###|</turn>)|(\\+)\Z")
#: A role ends with a mark of its own.
CONTROL_IN_ROLE = re.compile(r"(\\*)(###|</turn>|: )|(\\+)\Z")
#: Reserved ids, counted from the size of the tokenizer's vocabulary, and their written forms.
TURN, SAYS, END = 0, 1, 2
WRITTEN = ("### ", ": ", "</turn>\n")

_FORMATTED = "conv_id long, turn long, role string, ids array<int>, mask array<byte>"


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: m[3] * 2 if m[3] else m[1] * 2 + "\\" + m[2], text)


def unescaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" * (len(m[3] or m[1]) // 2) + (m[2] or ""), text)


def parsed(written: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in the written form."""
    out, at = [], 0
    while at < len(written):
        if not written.startswith(WRITTEN[0], at):
            raise ValueError("no turn begins here")
        at += len(WRITTEN[0])
        for mark in WRITTEN[1:]:
            end = written.index(mark, at)
            while (end - at - len(written[at:end].rstrip("\\"))) % 2:
                end = written.index(mark, end + 1)
            out.append(written[at:end])
            at = end + len(mark)
    return [(unescaped(r, CONTROL_IN_ROLE), unescaped(t)) for r, t in zip(out[::2], out[1::2], strict=True)]


@tidy
def _layout(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, marks_as_text=True)
    vocab = encode.tokenizer.get_vocab_size()
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        n = len(texts)
        segments = [x for r, t in zip(roles, texts, strict=True) for x in (escaped(r, CONTROL_IN_ROLE), escaped(t))]
        ids, sizes = [], np.zeros(2 * n, np.int64)
        for first, some, bounds in encode.encode(pa.array(segments, pa.string())):
            ids.append(some)
            sizes[first : first + len(bounds) - 1] = np.diff(bounds)
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        # role ids come after one mark, text ids after two, and three marks after each turn
        shift = np.arange(n) * 3
        ends = np.cumsum(sizes)
        role_at, text_at = ends[::2] - sizes[::2] + shift + 1, ends[::2] + shift + 2
        turn_end = ends[1::2] + shift + 2
        out = np.empty(int(ends[-1]) + 3 * n if n else 0, np.int32)
        own = np.ones(len(out), bool)
        for mark, at in ((TURN, role_at - 1), (SAYS, text_at - 1), (END, turn_end)):
            out[at] = vocab + mark
            own[at] = False
        out[own] = ids
        heard = np.array([r == "assistant" for r in roles], bool)
        edge = np.zeros(len(out) + 1, np.int8)
        np.add.at(edge, text_at[heard], 1)
        np.add.at(edge, turn_end[heard], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8)
        offsets = pa.array(np.concatenate(([0], turn_end + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (out, mask)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), *lists], ["conv_id", "turn", "role", "ids", "mask"])


def formatted(turns: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per turn: conv_id, turn, role, ids, mask; a conversation's ids are those of its turns in order.

    Null role or text: empty. A null turn sorts first. Repeated rows stay turns of their own. A conversation is never
    gathered into one value, so neither its length nor that of a text is limited. Other columns are not used.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_layout, path=tokenizer_path(tokenizer)), _FORMATTED)


class Reader:
    """Reads turns back from ids and mask."""

    def __init__(self, path: str) -> None:
        self.tokenizer = encoder(path, marks_as_text=True).tokenizer
        self.vocab = self.tokenizer.get_vocab_size()
        self.bytes = [bytes(_BYTE[c] for c in self.tokenizer.id_to_token(i)) if i not in self.tokenizer.get_added_tokens_decoder() else self.tokenizer.id_to_token(i).encode() for i in range(self.vocab)]

    def _parts(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn, escapes in them."""
        role_end = int(np.flatnonzero(ids == self.vocab + SAYS)[0])
        if ids[0] != self.vocab + TURN or ids[-1] != self.vocab + END or (ids >= self.vocab).sum() != 3:
            raise ValueError("not the ids of a turn")
        return self._text(ids[1:role_end]), self._text(ids[role_end + 1 : -1])

    def written(self, ids: np.ndarray) -> str:
        """A turn in the written form; those of a conversation one after the other are the conversation's."""
        role, text = self._parts(ids)
        return WRITTEN[0] + role + WRITTEN[1] + text + WRITTEN[2]

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, text under the mask, characters of the written form)."""
        role, text = self._parts(ids)
        heard = ids[mask.astype(bool)]
        return unescaped(role, CONTROL_IN_ROLE), unescaped(text), unescaped(self._text(heard)) if len(heard) else "", len(role) + len(text) + sum(map(len, WRITTEN))

    def _text(self, ids: np.ndarray) -> str:
        # The decoder takes off a first blank where it adds one, so it is not used: ids go back to their bytes.
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8")


def _byte_signs() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


_BYTE = _byte_signs()


@tidy
def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn; a conversation's running state is all that is kept."""
    reader, state = Reader(path), None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    result = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
    for batch in batches:
        rows = []
        offsets, values = np.asarray(batch.column("ids").offsets), np.asarray(batch.column("ids").values)
        mask_offsets, masks = np.asarray(batch.column("mask").offsets), np.asarray(batch.column("mask").values)
        for k, conv in enumerate(batch.column("conv_id").to_pylist()):
            role, text, heard, chars = reader.turn(values[offsets[k] : offsets[k + 1]], masks[mask_offsets[k] : mask_offsets[k + 1]])
            if state is None or state[0] != conv:
                if state is not None:
                    rows.append(result(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(heard)
            state[4].update(heard.encode())
            state[5] += chars
        if rows:
            yield closed(rows)
    if state is not None:
        yield closed([result(state)])


def read_back(formatted_turns: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Per conversation, from ids and masks alone: counts and digests of its turns and of the text under the mask.

    Turns go in the order of turn, equal ones in that of role and ids. Rows without conv_id are one conversation. One
    conversation is read by one task, as a digest asks for, in a stream that holds a batch of it at a time.
    """
    rows = formatted_turns.select("conv_id", "turn", "role", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "ids", "mask").mapInArrow(partial(_digest, path=tokenizer_path(tokenizer)), out)
