"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Control strings inside roles and texts, and backslashes,
get a backslash in front of their second (for backslashes: first) byte, so no text can open or close a turn and a backslash always
stands for the byte behind it. Segment lengths, running offsets and the place of every byte are computed in numpy for a
slice of turns at once, and headers, contents and escapes are copied into one preallocated Arrow buffer.

Scale: turns are dealt out by range of (conv_id, turn), so a conversation of any size is spread over tasks and comes out as
consecutive parts of about ``PART`` bytes; only a single longer turn makes a longer part. Digests of a whole conversation are
sequential by nature: its parts stream through one task in order, which holds one batch of them at a time.

Defined cases: null texts and roles are empty; a null turn comes first, a null conv_id is a conversation of its own; turns of the
same number are ordered by role and text; repeated rows are turns like any other; an empty table has no conversations."""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import scan

# Control strings of common chat templates
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
CONTROL = [b"<|im_start|>", b"<|im_end|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>"]
PART = 1 << 14
_ESCAPE = 0x5C
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _escapes(data: np.ndarray, offsets: np.ndarray, also: int | None = None) -> np.ndarray:
    """True for every byte that needs a backslash in front."""
    need = data == _ESCAPE
    if also is not None:
        need |= data == also
    for text in CONTROL:
        at = np.flatnonzero(data[:max(0, len(data) - len(text) + 1)] == text[0])
        for j in range(1, len(text)):
            at = at[data[at + j] == text[j]]
        end = offsets[np.searchsorted(offsets, at, "right")]
        need[at[at + len(text) <= end] + 1] = True
    return need


class _Column:
    """A text column's bytes with escapes counted, ready to be copied to given places."""

    def __init__(self, col: pa.Array, also: int | None = None):
        self.data, self.offsets = scan.buffers(col)
        self.need = _escapes(self.data, self.offsets, also)
        self.run = np.concatenate([[0], np.cumsum(self.need)])
        self.length = np.diff(self.offsets) + np.diff(self.run[self.offsets])

    def copy(self, out: np.ndarray, to: np.ndarray) -> None:
        lengths = np.diff(self.offsets)
        shift = to - self.offsets[:-1] - self.run[self.offsets[:-1]]
        place = np.arange(len(self.data)) + self.run[1:] + np.repeat(shift, lengths)
        out[place] = self.data
        out[place[self.need] - 1] = _ESCAPE


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns formatted, the offset of each, and start and end of each text in it."""
    role, text, n = _Column(role, ord("\n")), _Column(text), len(role)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, b"\n", CLOSE)]
    lengths = np.stack([np.full(n, len(fixed[0])), role.length, np.full(n, 1), text.length, np.full(n, len(fixed[2]))], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())]).astype(np.int64)
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    start = offsets[:-1].reshape(n, 5) if n else np.zeros((0, 5), np.int64)
    for k, piece in zip((0, 2, 4), fixed):
        out[start[:, k, None] + np.arange(len(piece))] = piece
    role.copy(out, start[:, 1])
    text.copy(out, start[:, 3])
    return buffer, np.concatenate([start[:, 0], offsets[-1:]]), start[:, 3], start[:, 4]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _formatter(size: int):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = scan.buffers(batch.column(2))
            for a, b in scan.slices(offsets):
                conv, role, text = (batch.column(i).slice(a, b - a) for i in range(3))
                buffer, at, t_start, t_end = assemble(role, text)
                code = conv.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                new = np.concatenate([[True], code[1:] != code[:-1]])
                within = at[:-1] - at[np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))]
                new[1:] |= within[1:] // size != within[:-1] // size
                first = np.flatnonzero(new)
                cuts = np.concatenate([at[first], at[-1:]])
                parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int32)), buffer)
                said = np.asarray([r == "assistant" for r in role.to_pylist()])
                own = np.cumsum(new) - 1
                spans = pa.StructArray.from_arrays([pa.array((x - cuts[own])[said]) for x in (t_start, t_end)], fields=list(_SPAN))
                loss = scan.list_array(spans, scan.per_row(own[said], len(first)))
                turns = np.diff(np.concatenate([first, [len(code)]]))
                number = (task << 32) + made + np.arange(len(first))
                made += len(first)
                yield pa.record_batch([conv.take(pa.array(first)), pa.array(number.astype(np.int64)), pa.array(turns.astype(np.int64)), parts, loss], ["conv_id", "part", "n_turns", "formatted", "loss"])
    return run


def format_conversations(conversations: DataFrame, size: int = PART) -> DataFrame:
    """conv_id, part (ascending within a conversation), n_turns, formatted and loss: byte spans of assistant texts in ``formatted``."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_formatter(size), f"conv_id {kind}, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data) if b"\\" in data else data


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn of a formatted part."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        head = len(OPEN)
        while turn[head] != 0x0A:  # the first newline that is not escaped ends the role
            head += 2 if turn[head] == _ESCAPE else 1
        out.append((unescape(turn[len(OPEN):head]), unescape(turn[head + 1:])))
    return out


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digest(batches):
    conv, state = None, None

    def row():
        return {"conv_id": conv[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    for batch in batches:
        out, kinds = [], pa.schema([pa.field("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for key, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if conv is None or key != conv[0]:
                if conv is not None:
                    out.append(row())
                conv, state = (key,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = formatted.encode()
            for role, text in read_turns(data):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for span in loss:
                text = unescape(data[span["start"]:span["end"]])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted)
        yield pa.RecordBatch.from_pylist(out, kinds)
    if conv is not None:
        yield pa.RecordBatch.from_pylist([row()], kinds)


def digests(parts: DataFrame) -> DataFrame:
    """What the parts say when read back, one row per conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(_digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def judge(conversations: DataFrame) -> DataFrame:
    return digests(materialize(format_conversations(conversations), "formatted"))
