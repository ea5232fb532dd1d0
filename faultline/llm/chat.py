"""Chat formatting by columnar byte assembly.

A batch of conversations is written into one preallocated Arrow buffer: the lengths of
all headers, contents and ends give cumulative offsets, and scatter indices place every
byte at once.  Control strings inside roles and texts are broken by a backslash after
their first character, and backslashes are doubled; dropping each backslash and taking
the next character as it is restores the text.  Therefore a control string in the
output is always markup, and the output can be read back without any side channel.

Edge cases: a null role or text is empty; turns are ordered by (turn, role, text), so
ties and repeated rows have a fixed place; long conversations are assembled alone, and a
conversation may hold what one string can, 2 GB; rows of a null conv_id form one conversation;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import textscan as ts

#: Template: START role \n text END for each turn.
START, HEAD_END, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Strings that must not occur inside roles and texts (fixed values of common templates).
CONTROLS = (b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
ESCAPE = 0x5C

FORMATTED = "conv_id long, formatted string, loss_starts array<long>, loss_ends array<long>"
#: Bytes of roles and texts that are assembled at once; a longer conversation is assembled alone.
ASSEMBLED = 64 << 20


def escape(data: np.ndarray, offsets: np.ndarray, line_ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
    r"""Escaped bytes and offsets of a batch of strings.  line_ends: also write \n as an escape and n, for roles."""
    before = [np.flatnonzero(data == ESCAPE)]
    for control in CONTROLS:
        at = np.flatnonzero(data[: len(data) - len(control) + 1] == control[0])
        for k, byte in enumerate(control[1:], 1):
            at = at[data[at + k] == byte]
        whole = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(control) - 1, "right")
        before.append(at[whole] + 1)
    if line_ends:
        feeds = np.flatnonzero(data == 0x0A)
        before.append(feeds)
        data = data.copy()
        data[feeds] = ord("n")
    insert = np.unique(np.concatenate(before))
    shift = np.zeros(len(data) + 1, np.int64)
    shift[insert] = 1
    out = np.full(len(data) + len(insert), ESCAPE, np.uint8)
    out[np.arange(len(data)) + np.cumsum(shift)[: len(data)]] = data
    return out, offsets + np.searchsorted(insert, offsets)


def unescape(text: str, line_ends: bool = False) -> str:
    if "\\" not in text:
        return text
    parts = text.split("\\")
    out, i = [parts[0]], 1
    while i < len(parts):
        if parts[i] == "" and i + 1 < len(parts):  # a doubled backslash
            out.append("\\" + parts[i + 1])
            i += 2
            continue
        out.append("\n" + parts[i][1:] if line_ends and parts[i][:1] == "n" else parts[i])
        i += 1
    return "".join(out)


def assemble(bounds: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations; and each turn's first and last character of its text in them.  bounds: first turn of each conversation, and one more."""
    role, role_at = escape(*ts.string_buffers(roles), line_ends=True)
    text, text_at = escape(*ts.string_buffers(texts))
    n = len(role_at) - 1
    fixed = [np.frombuffer(x, np.uint8) for x in (START, HEAD_END, END)]
    parts = [(fixed[0], None), (role, role_at), (fixed[1], None), (text, text_at), (fixed[2], None)]
    lengths = np.stack([np.diff(at) if at is not None else np.full(n, len(data)) for data, at in parts], 1)
    starts = (np.cumsum(lengths) - lengths.ravel()).reshape(n, len(parts)) if n else np.zeros((0, len(parts)), np.int64)
    total = int(lengths.sum())
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    out.flags.writeable or (out := np.ndarray(total, np.uint8, memoryview(buffer)))
    for k, (data, at) in enumerate(parts):
        if at is None:
            out[(starts[:, k, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
        else:
            out[ts.ragged(starts[:, k], lengths[:, k])] = data[at[0] : at[-1]]
    ends = np.concatenate([starts[:, 0], [total]])[bounds]
    strings = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), buffer)
    characters = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    base = characters[ends[owner]] if n else np.zeros(0, np.int64)
    return strings, characters[starts[:, 3]] - base, characters[starts[:, 4]] - base


def format_chats(turns: DataFrame, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the formatted text, and the character ranges of it that a loss counts (see FORMATTED)."""
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                roles = batch.column(1).flatten()
                strings, first, last = assemble(bounds, roles, batch.column(2).flatten())
                counted = np.array([r == loss_role for r in roles.to_pylist()], bool)
                cuts = pa.array(np.concatenate([[0], np.cumsum(counted)])[bounds].astype(np.int32))
                ranges = [pa.ListArray.from_arrays(cuts, pa.array(x[counted].astype(np.int64))) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([batch.column(0), strings.cast(pa.string()), *ranges], names=["conv_id", "formatted", "loss_starts", "loss_ends"])

    return chats.mapInArrow(write, FORMATTED)


def by_bytes(batch: pa.RecordBatch, limit: int = ASSEMBLED) -> Iterator[pa.RecordBatch]:
    """Runs of conversations of about so many bytes, so that no buffer of strings reaches the limit of its offsets."""
    bounds = batch.column(1).offsets.to_numpy().astype(np.int64)
    sizes = [pc.fill_null(pc.binary_length(batch.column(k).flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
    total = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])[bounds - bounds[0]]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the output alone."""
    turns = []
    for part in formatted.split(START.decode())[1:]:
        head, _, body = part.partition(HEAD_END.decode())
        turns.append((unescape(head, line_ends=True), unescape(body[: -len(END)])))
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: turns, loss text and length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                said = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
