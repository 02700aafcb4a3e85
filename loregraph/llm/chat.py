"""Chat formatting by columnar byte assembly.

Rows of a conversation, in order of turn, become one string: for each turn a header that names its role, the text and
an end mark. numpy writes a batch of turns at once: segment lengths, their cumulative offsets, then for each kind of
segment one scatter into a single preallocated buffer, which Arrow takes over as the string column.

Template: a turn is ``<|role|>\\n`` + text + ``<|end|>\\n``. In roles and texts a backslash is doubled and one is put after
each ``<``, ``|`` and ``[``. So no mark of this template, nor ``</s>`` or ``[INST]``, survives inside a text, and
``unescape`` gives the text back. The loss mask is the list of [start, end) byte spans of assistant texts.

Turns are sorted within hash partitions of the conversation's id; they stream through in batches and one conversation
is held at a time, as its one output row must be.

Defined results: a null text or role is empty; equal turns are ordered by role, then text; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.llm.store import bounded_batches
from loregraph.llm.words import text_buffers

HEAD, MID, TAIL = "<|", "|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"([<|\[])\\|\\(\\)")
_TURN = re.compile(r"<\|(?!end\|>\n)(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"


def escape(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(column, "\\", "\\\\")
    for mark in "<|[":
        column = pc.replace_substring(column, mark, mark + "\\")
    return column


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


Piece = tuple[np.ndarray, np.ndarray, np.ndarray]


def _column(column: pa.Array) -> Piece:
    data, offsets = text_buffers(column)
    return data, offsets[:-1], np.diff(offsets)


def _constant(text: str, n: int) -> Piece:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.zeros(n, np.int64), np.full(n, len(data), np.int64)


def assemble(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Write each row's pieces one after another: (the buffer, the offset of each piece in each row and of the end)."""
    lengths = np.stack([n for _, _, n in pieces], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(int(offsets[-1]), np.uint8)
    to = offsets[:-1].reshape(lengths.shape)
    for j, (data, start, n) in enumerate(pieces):
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[:, j], n) + within] = data[np.repeat(start, n) + within]
    return out, offsets


def _format(turns: pa.Table) -> pa.RecordBatch:
    """Whole conversations, sorted -> one row each."""
    n = turns.num_rows
    turns = turns.combine_chunks()
    conv = turns["conv_id"].combine_chunks()
    ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
    first = np.ones(n, bool)
    first[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(first)
    role, text = (turns[c].combine_chunks().fill_null("") for c in ("role", "text"))
    pieces = [_constant(HEAD, n), _column(escape(role)), _constant(MID, n), _column(escape(text)), _constant(TAIL, n)]
    buffer, offsets = assemble(pieces)
    rows = offsets[:: len(pieces)]
    edges = np.append(rows[first], rows[-1])
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(buffer))
    loss = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
    owner = np.searchsorted(first, np.flatnonzero(loss), side="right") - 1
    at = offsets[:-1].reshape(n, len(pieces))[loss][:, 3:5] - edges[owner][:, None]
    spans = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)), spans)
    counts = np.diff(np.append(first, n))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(counts), strings, lists], ["conv_id", "n_turns", "formatted", "loss_spans"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if not held or held[-1]["conv_id"][-1] == batch["conv_id"][batch.num_rows - 1]:
            if not held:
                held.append(batch)
                continue
            if held[0]["conv_id"][0] == batch["conv_id"][0]:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch])
        last = batch["conv_id"][batch.num_rows - 1]
        ids = table["conv_id"].combine_chunks()
        same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
        cut = pc.index(same, True).as_py()
        if cut:
            yield _format(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield _format(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted and loss_spans of each conversation."""
    bounded_batches(turns.sparkSession)
    t = turns.select(*(F.col(c).alias(n) for c, n in ((conv_id, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.select("conv_id", "role", "text").mapInArrow(_stream, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for conv, whole, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
            turns = parse(whole)
            raw = whole.encode()
            loss = "".join(unescape(raw[s["start"] : s["end"]].decode()) for s in spans)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest their turns and the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, schema)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return read_back(format_conversations(turns.union(added)))
