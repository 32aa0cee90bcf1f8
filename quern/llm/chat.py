"""Chat formatting at token level: segments encoded separately, reserved ids spliced in, masks by prefix sums.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Markers are reserved ids above
the vocabulary, which no text can encode to. In the text form, content is escaped so that it
never holds ``<|``: a backslash goes between ``<`` with any backslashes after it and ``|``. Roles
are escaped alike, after ``\\`` and line breaks in them, so that the first line break ends a role.

A conversation is written in parts of at most PART_IDS ids or one turn, so that no conversation
has to fit in memory. Of each part its ids, the prefix sums of its segments' lengths, and the
kind of each segment are kept; the loss mask is derived from them.

Nulls, ties, empties: null texts and roles are empty, null turns come first, turns with the same
number are ordered by role, then text; null conv_ids form one conversation; an empty table gives
no rows; columns other than conv_id, turn, role and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, token_bytes
from .common import stored, texts_of

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of segments.
MARK_START, ROLE, LINE_BREAK, TEXT, LOSS_TEXT, MARK_END = range(6)
PART_IDS = 1 << 16
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def loss_mask(bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """True for the ids of segments under the loss; bounds: prefix sums of the segments' lengths, from 0."""
    step = np.zeros(int(bounds[-1]) + 1, np.int64)
    under = (kinds == LOSS_TEXT).astype(np.int64)
    np.add.at(step, bounds[:-1], under)
    np.add.at(step, bounds[1:], -under)
    return np.cumsum(step)[:-1] > 0


def format_chats(turns: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, part, ids (binary, little-endian uint32), bounds and kinds (arrays), of each part of each conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text=True)
        for b in batches:
            roles, texts = texts_of(b, "role"), texts_of(b)
            role_ids = enc.encode_batch([escape_role(x) for x in roles])
            text_ids = enc.encode_batch([escape(x) for x in texts])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text"), pa.array(role_ids, pa.binary()), pa.array(text_ids, pa.binary())], [*b.schema.names, "role_ids", "text_ids"])

    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary")
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    dealt = encoded.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "role_ids", "text_ids")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text=True)
        size = enc.tokenizer.get_vocab_size()
        start, end = np.array([size], "<u4").tobytes(), np.array([size + 1], "<u4").tobytes()
        line = enc.whole("\n")
        conv, part, segments, kinds, n, begun = None, 0, [], [], 0, False

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in segments])])
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([b"".join(segments)], pa.binary()), pa.array([bounds.tolist()], pa.list_(pa.int64())), pa.array([kinds], pa.list_(pa.int8()))], ["conv_id", "part", "ids", "bounds", "kinds"])

        for b in batches:
            for r in b.to_pylist():
                if begun and (r["conv_id"] != conv or n >= PART_IDS):
                    yield close()
                    part = part + 1 if r["conv_id"] == conv else 0
                    segments, kinds, n = [], [], 0
                conv, begun = r["conv_id"], True
                turn = [start, r["role_ids"], line, r["text_ids"], end, line]
                segments += turn
                kinds += [MARK_START, ROLE, LINE_BREAK, LOSS_TEXT if r["role"] in loss_roles else TEXT, MARK_END, LINE_BREAK]
                n += sum(map(len, turn)) // 4
        if begun:
            yield close()

    return dealt.mapInArrow(assemble, "conv_id long, part long, ids binary, bounds array<bigint>, kinds array<tinyint>")


def read_chats(parts: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from ids, bounds and kinds."""
    dealt = parts.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer)
        size = len(table)
        text = [*table, START.encode(), END.encode()]
        decode = lambda ids: b"".join(map(table.__getitem__, ids)).decode("utf-8", "surrogatepass")
        conv, state, out = None, None, []

        def close() -> None:
            n, turns, loss_chars, loss, chars = state
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for b in batches:
            for r in b.to_pylist():
                if state is None or r["part"] == 0:
                    if state is not None:
                        close()
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(r["ids"], "<u4")
                kinds = np.array(r["kinds"], np.int8)
                mask = loss_mask(np.array(r["bounds"]), kinds)
                state[4] += len(b"".join(text[i] for i in ids.tolist()).decode())
                for at in np.split(np.arange(len(ids)), np.flatnonzero(ids == size)[1:]):  # turn by turn
                    turn = ids[at].tolist()
                    line = _role_end(turn, table)
                    role = unescape_role(decode(turn[1:line]))
                    content = unescape(decode(turn[line + 1 : len(turn) - 1 - turn[::-1].index(size + 1)]))
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                    under = unescape(decode(ids[at][mask[at]].tolist()))
                    state[2] += len(under)
                    state[3].update(under.encode())
            if len(out) >= 5000:
                yield _rows(out)
                out = []
        if state is not None:
            close()
        yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds_of, strict=True)], names)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _role_end(turn: list[int], table: list[bytes]) -> int:
    """Where the line break after the role stands: the first id that is one; roles hold none."""
    return next(i for i, x in enumerate(turn) if i and table[x] == b"\n")


def chats(turns: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Writes the formatted conversations to the shared folder and returns what is read back."""
    return read_chats(stored(format_chats(turns, tokenizer, loss_roles), "chats"), tokenizer)
