"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A conversation is begin, then for each turn: role_open role role_close text end.

    All five are control strings.  Inside roles and texts a control string gets a backslash after its first character; one
    that already has k backslashes there gets another, so unescaping (one less) restores every text.
    """

    begin: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    end: str = "</s>"

    def escape(self, texts: pa.Array) -> pa.Array:
        return _each(texts, self, True)

    def unescape(self, texts: pa.Array) -> pa.Array:
        return _each(texts, self, False)


def re_quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def _each(texts: pa.Array, t: Template, add: bool) -> pa.Array:
    for c in (t.begin, t.end, t.role_open, t.role_close):
        head, tail = re_quote(c[0]), re_quote(c[1:])
        if add:
            texts = pc.replace_substring_regex(texts, rf"({head})(\\*)({tail})", r"\1\2\\\3")
        else:
            texts = pc.replace_substring_regex(texts, rf"({head})\\(\\*)({tail})", r"\1\2\3")
    return texts


def assemble(columns: list[pa.Array | bytes], n: int) -> tuple[pa.Array, np.ndarray]:
    """Concatenate columns row by row: string arrays and constants; also the byte offset of each column in each row.

    Segment lengths and their cumulative sums give each segment's place in one preallocated buffer; the bytes of a column are then copied
    by one scatter with computed indices.
    """
    sizes = np.empty((n, len(columns)), np.int64)
    raw: list[tuple[np.ndarray, np.ndarray] | bytes] = []
    for k, c in enumerate(columns):
        if isinstance(c, bytes):
            sizes[:, k] = len(c)
            raw.append(c)
        else:
            c = c.cast(pa.large_string())
            _, offsets, data = c.buffers()
            at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + n + 1] if n else np.zeros(1, np.int64)
            sizes[:, k] = np.diff(at)
            body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and n and at[-1] > at[0] else np.zeros(0, np.uint8)
            raw.append((body, at))
    inside = np.cumsum(sizes, axis=1) - sizes
    total = sizes.sum(axis=1)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(total, out=offsets[1:])
    place = offsets[:-1, None] + inside
    out = np.empty(int(offsets[-1]), np.uint8)
    for k, c in enumerate(raw):
        if isinstance(c, bytes):
            out[place[:, k, None] + np.arange(len(c))] = np.frombuffer(c, np.uint8)
        else:
            body, _ = c
            length = sizes[:, k]
            shift = np.repeat(place[:, k] - (np.cumsum(length) - length), length)
            out[shift + np.arange(len(body))] = body
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)), inside


def format_turns(turns: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """One row per turn, partitions sorted by conversation and turn: conv_id, first (of its conversation), piece, loss_from, loss_to.

    A conversation's formatted text is its pieces one after the other; code points loss_from to loss_to of a piece are under
    the loss mask (the text of trained roles, else none).  Rows go by turn (null first; ties by role and text); null roles and texts are
    empty.  A conversation is streamed through one task, so its length is not bounded by memory.
    """
    kinds = "conv_id long, first boolean, piece string, loss_from long, loss_to long"
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            conv = batch["conv_id"].to_pylist()
            first = [(c,) != p for c, p in zip(conv, [last, *[(c,) for c in conv[:-1]]], strict=True)]
            last = (conv[-1],)
            role, text = template.escape(batch["role"]), template.escape(batch["text"])
            start = pc.if_else(pa.array(first), template.begin, "")
            piece, _ = assemble([start, template.role_open.encode(), role, template.role_close.encode(), text, template.end.encode()], n)
            head = pc.add(pc.add(pc.utf8_length(start), pc.utf8_length(role)), len(template.role_open) + len(template.role_close)).cast(pa.int64())
            under = pc.equal(batch["role"], trained)
            stop = pc.add(head, pc.if_else(under, pc.utf8_length(text), 0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(first), piece.cast(pa.string()), head, stop], names=["conv_id", "first", "piece", "loss_from", "loss_to"])

    return rows.mapInArrow(run, kinds)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse pieces, as format_turns gives them, into a digest per conversation.

    n_turns; turns_sha256 over role, newline, text, newline of each turn; loss_chars and loss_sha256 of the unescaped text under the loss mask;
    formatted_chars.
    """
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        now: list | None = None

        def close() -> None:
            for column, value in zip(out, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]), strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            for c in out:
                c.clear()
            return got

        for batch in batches:
            pieces = batch["piece"].to_pylist()
            firsts, lows, highs = batch["first"].to_pylist(), batch["loss_from"].to_pylist(), batch["loss_to"].to_pylist()
            roles, texts, masked = [], [], []
            for piece, first, lo, hi in zip(pieces, firsts, lows, highs, strict=True):
                at = (len(template.begin) if first else 0) + len(template.role_open)
                mid = piece.index(template.role_close, at)
                roles.append(piece[at:mid])
                texts.append(piece[mid + len(template.role_close) : len(piece) - len(template.end)])
                masked.append(piece[lo:hi])
            roles, texts, masked = (template.unescape(pa.array(x, pa.string())).to_pylist() for x in (roles, texts, masked))
            for conv, first, piece, role, text, mask in zip(batch["conv_id"].to_pylist(), firsts, pieces, roles, texts, masked, strict=True):
                if first:
                    if now:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(mask)
                now[4].update(mask.encode())
                now[5] += len(piece)
            if len(out[0]) >= 5000:
                yield flush()
        if now:
            close()
            yield flush()

    return formatted.mapInArrow(run, kinds)


def format_chat(turns: DataFrame, template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """Format all conversations and return the digest that reading the output back gives; an empty table gives an empty result."""
    return read_back(format_turns(turns, template, trained), template)
