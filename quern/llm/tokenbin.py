"""Token ids in binary files: Simple-8b words with escapes and per-block offsets.

A word of 64 bits holds a selector in its top 4 bits and, in the other 60, as many ids as that
selector says, each of as many bits. An id of 2**60 or more is an escape: its word holds the
place of the full value among the escapes that follow the block's words, so that each word can
be decoded by itself and a whole file by a few array operations.

A file: MAGIC; for each block its words, then its escapes (little-endian uint64); a footer with
the block table (first word, words, escapes, ids of each block), then doc_id, whether it isn't
null, and the number of ids of each document; a trailer of six uint64: blocks, documents, ids,
the footer's place, its crc32, END.

Nulls, ties, empties: a null text is an empty one (its end id alone); rows with a null doc_id
come first; rows with the same doc_id are ordered by a hash of the text, then the text; an empty
table gives files without documents; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import GROUP, encoder
from .common import filesystem, new_path, parts_of, publish, stored, texts_of

MAGIC, END = b"QIDS8B1\0", 0x51554944533842
BLOCK = 1024
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 1])
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 60])
ESCAPE = 15
#: Ids that are packed or unpacked at a time.
STEP = 1024 * BLOCK


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Ids in blocks of BLOCK (the last may be shorter): bytes, and the words and escapes of each block."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(ids.max())
    kind = np.uint32 if most < 1 << 32 else np.uint64
    grid = np.zeros((rows, BLOCK + 60), dtype=kind)  # beyond a block's end zeros may fill a word
    whole = n // BLOCK
    grid[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, : n - whole * BLOCK] = ids[whole * BLOCK :]
    # Where a word may take the ids of selector s it may take those of s - 1: each that fits adds one.
    best = np.zeros(grid.shape, dtype=np.uint8)
    for s in range(1, 14):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        if most < 1 << width:
            best += 1
            continue
        fits, have = grid < kind(1 << width), 1
        while have < count:  # fits[i]: the ids i to i + have - 1 are narrow enough
            step = min(have, count - have)
            fits[:, :-step] &= fits[:, step:]
            have += step
        if not fits[:, :BLOCK].any():
            break
        best += fits.view(np.uint8)
    if most >= 1 << 60:
        best[grid >= (1 << 60)] = ESCAPE
    ends = np.full(rows, BLOCK)
    ends[-1] = n - (rows - 1) * BLOCK
    at, lanes = np.zeros(rows, dtype=np.int64), np.arange(rows)
    starts, chosen, owner = [], [], []
    while len(lanes):  # all blocks move by one word at a time
        s = best[lanes, at]
        starts.append(lanes * (BLOCK + 60) + at)
        chosen.append(s)
        owner.append(lanes)
        at = at + COUNTS[s]
        if (over := at >= ends[lanes]).any():
            lanes, at = lanes[~over], at[~over]
    start, sel, row = np.concatenate(starts), np.concatenate(chosen), np.concatenate(owner)
    order = np.argsort(row, kind="stable")
    start, sel, row = start[order], sel[order], row[order]
    flat = grid.reshape(-1)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(14):
        if len(mine := np.flatnonzero(sel == s)):
            value, width, at = np.zeros(len(mine), dtype=np.uint64), int(WIDTHS[s]), start[mine]
            for k in range(int(COUNTS[s])):
                value |= flat[at + k].astype(np.uint64) << np.uint64(k * width)
            words[mine] |= value
    n_words = np.bincount(row, minlength=rows)
    escaped = np.flatnonzero(sel == ESCAPE)
    n_escapes = np.bincount(row[escaped], minlength=rows)
    if not len(escaped):
        return words.astype("<u8").tobytes(), n_words, n_escapes
    first = np.cumsum(n_escapes) - n_escapes
    words[escaped] |= (np.arange(len(escaped)) - first[row[escaped]]).astype(np.uint64)
    raw, out, a = flat[start[escaped]].astype(np.uint64), [], 0
    for r in range(rows):
        out += [words[a : a + n_words[r]], raw[first[r] : first[r] + n_escapes[r]]]
        a += n_words[r]
    return np.concatenate(out).astype("<u8").tobytes(), n_words, n_escapes


def unpack(data: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, whose words and escapes data holds."""
    rows = len(n_words)
    starts = np.cumsum(n_words + n_escapes) - (n_words + n_escapes)
    row = np.repeat(np.arange(rows), n_words)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    words = data[starts[row] + within]
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == 14).any():
        raise ValueError("selector 14 has no meaning")
    counts = COUNTS[sel]
    got = np.bincount(row, weights=counts, minlength=rows).astype(np.int64)
    if (got < n_ids).any():
        raise ValueError("a block has fewer ids than its table says")
    # A block's last word may hold more than its ids: each block has room for that.
    first = np.cumsum(counts) - counts
    first += row * (BLOCK + 60) - np.repeat(np.cumsum(got) - got, n_words)
    out = np.zeros(rows * (BLOCK + 60), dtype=np.uint64 if ((sel == 0) | (sel == ESCAPE)).any() else np.uint32)
    for s in range(14):
        if len(mine := np.flatnonzero(sel == s)):
            width, at, word = int(WIDTHS[s]), first[mine], words[mine]
            mask = np.uint64((1 << width) - 1)
            for k in range(int(COUNTS[s])):
                out[at + k] = (word >> np.uint64(k * width)) & mask
    if len(mine := np.flatnonzero(sel == ESCAPE)):
        r = row[mine]
        out[first[mine]] = data[starts[r] + n_words[r] + (words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    out = out.reshape(rows, BLOCK + 60)
    if (n_ids[:-1] == BLOCK).all():
        return out[:, :BLOCK].reshape(-1)[: int(n_ids.sum())]
    return np.concatenate([x[:n] for x, n in zip(out, n_ids.tolist(), strict=True)])


class Writer:
    """Writes one file; it has its name only once it is whole."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tried = f"{self.path}.tried-{attempt}"
        self.out = self.fs.open_output_stream(self.tried)
        self.out.write(MAGIC)
        self.word, self.held, self.n_held, self.n_ids = 0, [], 0, 0
        self.blocks: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= STEP:
            self._flush(self.n_held // STEP * STEP)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint64)
        for i in range(0, n, STEP):
            data, words, escapes = pack(ids[i : min(n, i + STEP)])
            self.out.write(data)
            size = words + escapes
            counts = np.full(len(words), BLOCK)
            if len(counts):
                counts[-1] = min(n, i + STEP) - i - BLOCK * (len(words) - 1)
            self.blocks.append(np.stack([self.word + np.cumsum(size) - size, words, escapes, counts], axis=1))
            self.word += int(size.sum())
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._flush(self.n_held)
        table = np.concatenate([np.zeros((0, 4), np.int64), *self.blocks])
        footer = table.astype("<i8").tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        footer += np.array([d is not None for d, _ in self.docs], "u1").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes()
        self.out.write(footer)
        at = len(MAGIC) + 8 * self.word
        self.out.write(np.array([len(table), len(self.docs), self.n_ids, at, zlib.crc32(footer), END], "<u8").tobytes())
        size = self.out.tell()
        self.out.close()
        publish(self.fs, self.tried, self.path)
        return {"n_docs": len(self.docs), "n_ids": self.n_ids, "n_bytes": size}


class Reader:
    """Reads one file. blocks() yields ids; documents() yields doc_id and its ids in pieces of bounded size."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n_blocks, n_docs, self.n_ids, at, crc, end = (int(x) for x in np.frombuffer(self._read(size - 48, 48), "<u8"))
        footer = self._read(at, size - 48 - at)
        if self._read(0, 8) != MAGIC or end != END or zlib.crc32(footer) != crc:
            raise ValueError(f"{uri} isn't whole")
        self.table = np.frombuffer(footer, "<i8", 4 * n_blocks).reshape(-1, 4)
        rest = 32 * n_blocks
        self.doc_ids = np.frombuffer(footer, "<i8", n_docs, rest)
        self.valid = np.frombuffer(footer, "u1", n_docs, rest + 8 * n_docs)
        self.lengths = np.frombuffer(footer, "<i8", n_docs, rest + 9 * n_docs)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def blocks(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        t = self.table[lo:hi]
        if not len(t):
            return np.zeros(0, np.uint64)
        first, last = int(t[0, 0]), int(t[-1, :3].sum())
        data = np.frombuffer(self._read(len(MAGIC) + 8 * first, 8 * (last - first)), "<u8")
        return unpack(data, t[:, 1], t[:, 2], t[:, 3])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray, bool]]:
        """doc_id, its start in this file, some of its ids, whether they are its last."""
        at_block, held, start = 0, np.zeros(0, np.uint64), 0
        for doc, ok, n in zip(self.doc_ids.tolist(), self.valid.tolist(), self.lengths.tolist(), strict=True):
            left = n
            while True:
                if left > len(held) and len(held) == 0 and at_block < len(self.table):
                    held = self.blocks(at_block, at_block + STEP // BLOCK)
                    at_block += STEP // BLOCK
                part, held = held[:left], held[left:]
                left -= len(part)
                yield doc if ok else None, start, part, left == 0
                if left == 0:
                    break
            start += n

    def close(self) -> None:
        self.file.close()


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and writes docs in ascending doc_id order; the manifest, a row for each file, in order of file_no."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, enc = TaskContext.get(), None, encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                no = task.partitionId()
                out = Writer(uri := f"{folder}/part-{no:07d}.ids", task.taskAttemptId())
            for part in parts_of(b, GROUP):
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode_batch(texts_of(part)), strict=True):
                    out.add(doc, np.frombuffer(ids + end, "<u4"))
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"file_no": no, "uri": uri, **out.close()}], schema=pa.schema([("file_no", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    return stored(rows.mapInArrow(run, "file_no long, uri string, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian uint32), from the files."""
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                reader = Reader(f["uri"])
                rows: list[tuple] = []
                crc = n = 0
                for doc, start, ids, last in reader.documents():
                    crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                    if last:
                        rows.append((doc, f["base"] + start, n, crc))
                        crc = n = 0
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)
                reader.close()

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("uri", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs to files in the shared folder and returns what the files hold, by document."""
    return read_ids(write_ids(docs, tokenizer, end_id, new_path(docs.sparkSession, "ids")))
