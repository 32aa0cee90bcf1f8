"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are the sets to be contained, of shingles of up to SHINGLE words. Shingles
are ordered by rarity, which is their number of documents, counted over all documents. For
exact containment one shingle is a necessary prefix: the rarest of each window. Documents put out
a row, with the words around it, where they may hold a prefix; these rows are joined with the windows on
the prefix, windows that would start before the document or end after it are out, and the others are
compared word by word.

Windows, shingles and prefixes are rows; nothing of the benchmark comes to the driver but two filters of a fixed
size (FILTER_BITS), which keep shingles that are in no window, or are no prefix, from the shuffle. The fuller
they are the more rows are shuffled; results are the same.

Nulls, ties, empties: null and empty texts have no words and no hits; items without words have
no windows; a window of several items, or an item id that repeats, counts for each id once;
windows of an item without an id mark words but name no item; an empty benchmark marks nothing;
repeated documents and null doc_ids are separate rows; rows are told apart by doc_id and text; of columns other
than those named none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, apart, bytes_of, dropped, in_struct, quoted, stored

SHINGLE = 3
#: Bits of each filter.
FILTER_BITS = 1 << 26
#: Shingles that a task holds until it adds them up.
HELD = 1 << 21
#: Words of texts that are looked at together.
TOGETHER = 1 << 14
# Bytes that end a word become spaces, A-Z become a-z; bytes of other characters stay.
_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.translate(_WORDS).split()


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []


class Shingles:
    """Hashes of shingles. A word is hashed each time: that is quicker than to look it up among many."""

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A hash of each word."""
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))

    def __call__(self, words: list[bytes], width: int) -> np.ndarray:
        """Of the shingles of so many words that start at each word."""
        return self.joined(self.hashes(words), width)

    def joined(self, h: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the shingles of so many words, given those of the words."""
        n = len(h) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.full(n, width, np.uint64)
        spare = np.empty_like(out)
        for i in range(width):
            out *= _P
            out ^= h[i : i + n]
            out ^= np.right_shift(out, np.uint64(29), out=spare)
            out *= _Q
        out ^= np.right_shift(out, np.uint64(32), out=spare)
        return out.view(np.int64)


def shingles_met(batch: pa.RecordBatch, of: Shingles, bits: Bits, sizes: list[int]) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: their words, and of each shingle that may be one of the keys its text, its place there and its hash.

    Texts are taken together, as most are short; shingles that run from one into the next are left out.
    """
    texts = bytes_of(batch)
    lo = 0
    while lo < len(texts):
        some, flat = [], []
        while lo < len(texts) and len(flat) < TOGETHER:
            some.append(words_of(texts[lo]))
            flat += some[-1]
            lo += 1
        own = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(own)
        h, parts = of.hashes(flat), [(np.zeros(0, np.int64),) * 3]
        for k in sizes:
            found = of.joined(h, k)
            at = np.flatnonzero(bits.have(found))
            text = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[text]
            at, text = at[inside], text[inside]
            parts.append((text, at - (ends - own)[text], found[at]))
        yield some, *(np.concatenate(x) for x in zip(*parts, strict=True))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, hi, lo (the window's hash), width, words (space-joined), shingles (of min(SHINGLE, width) words) of each item's windows."""
    names = ["item_id", "hi", "lo", "width", "words", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        from xxhash import xxh3_128_digest

        of = Shingles()
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), bytes_of(b), strict=True):
                words = words_of(text)
                own = windows_of(words, width)
                size = min(width, len(words))
                k = min(SHINGLE, size)
                shingles = of(words, k).tolist() if words else []
                for s in range(0, len(own), 5000):
                    part = [b" ".join(w) for w in own[s : s + 5000]]
                    hashes = [struct.unpack("<qq", xxh3_128_digest(w)) for w in part]
                    n = len(part)
                    cols = [[item] * n, [h[0] for h in hashes], [h[1] for h in hashes], [size] * n, [w.decode() for w in part], [shingles[i : i + size - k + 1] for i in range(s, s + n)]]
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, hi long, lo long, width int, words string, shingles array<long>")


def rarity(docs: DataFrame, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """shingle, n: documents that hold each of the shingles (and some others); keys: shingle. A row for each shingle and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(Bits.of(keys, "shingle", FILTER_BITS).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bits, held, size = Shingles(), Bits.unpacked(shared.value), [], 0

        def added() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "n"])

        for b in batches:
            for _, text, _, found in shingles_met(b, of, bits, sizes):
                order = np.lexsort((found, text))
                text, found = text[order], found[order]
                held.append(found[np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] != found[:-1])])] if len(found) else found)
                size += len(held[-1])
                if size > HELD:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    return docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, keys: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """doc_id, same (a hash of the text), n_words, places (of shingles that may be one of the keys: shingle, at, before, around) of each document.

    around: the words that a window with the shingle may hold, space-joined; before: how many of them stand before it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Bits.of(keys, "shingle", FILTER_BITS).packed())
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bits = Shingles(), Bits.unpacked(shared.value)
        for b in batches:
            size, places = [], []
            for some, text, at, found in shingles_met(b, of, bits, sizes):
                base = len(places)
                size += map(len, some)
                places += [[] for _ in some]
                for t, i, x in zip(text.tolist(), at.tolist(), found.tolist(), strict=True):
                    lo = max(0, i - width + 1)
                    places[base + t].append({"shingle": x, "at": i, "before": i - lo, "around": b" ".join(some[t][lo : i + width]).decode()})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(size, pa.int64()), pa.array(places, kind)], ["doc_id", "same", "n_words", "places"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, same long, n_words long, places array<struct<shingle: long, at: int, before: int, around: string>>")


def found_windows(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables: doc_id, same, n_words of each document; doc_id, same, start, end, hi, lo of each window found in it; item_id, hi, lo of each window.

    docs: doc_id, text.
    """
    items = stored(item_windows(benchmark, width), "windows")
    windows = items.groupBy("hi", "lo").agg(F.any_value("width").alias("width"), F.any_value("words").alias("words"), F.any_value("shingles").alias("shingles"))
    windows = stored(windows, "distinct")
    each = stored(windows.select("hi", "lo", F.posexplode("shingles").alias("offset", "shingle")), "shingles")
    keys = each.select("shingle").distinct()
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), "width")).distinct().collect())  # 1 to SHINGLE
    seen = stored(rarity(docs.select("text"), keys, sizes), "rarity")
    rarest = each.join(seen, "shingle").groupBy("hi", "lo").agg(F.min(F.struct("n", "shingle", "offset")).alias("rarest"), F.count("*").alias("met"))
    # A window of which a shingle is in no document is in none.
    rarest = rarest.join(windows, ["hi", "lo"]).filter(F.col("met") == F.size("shingles"))
    prefixes = stored(rarest.select("hi", "lo", "width", "words", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")), "prefixes")
    by_doc = stored(candidates(docs, prefixes.select("shingle").distinct(), sizes, width), "places")
    places = by_doc.select("doc_id", "same", F.explode("places").alias("p")).select("doc_id", "same", "p.*")
    met = places.join(prefixes, "shingle").withColumn("list", F.split("around", " "))
    fits = (F.col("before") >= F.col("offset")) & (F.col("before") - F.col("offset") + F.col("width") <= F.size("list"))
    met = met.filter(fits).filter(F.array_join(F.slice("list", F.col("before") - F.col("offset") + 1, F.col("width")), " ") == F.col("words"))
    start = F.col("at") - F.col("offset")
    hits = stored(met.select("doc_id", "same", start.alias("start"), (start + F.col("width")).alias("end"), "hi", "lo"), "hits")
    dropped(windows, each, seen, prefixes)
    return by_doc.drop("places"), hits, items.select("item_id", "hi", "lo")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (array of start and end, in words), items (array of item_id) of each document."""
    by_doc, hits, items = found_windows(docs.select("doc_id", F.col(text).alias("text")), benchmark, width)
    spans = hits.groupBy("doc_id", "same").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # as many as its words
    named = hits.select("doc_id", "same", "hi", "lo").distinct().join(items.filter("item_id is not null"), ["hi", "lo"])
    named = named.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[{"start": lo, "end": hi} for lo, hi in merged([(s["start"], s["end"]) for s in x])] for x in b.column("spans").to_pylist()]
            yield b.set_column(2, "spans", pa.array(own, b.schema.field("spans").type))

    spans = stored(spans.mapInArrow(merge, spans.schema), "spans").alias("s")
    named = stored(named, "named").alias("i")
    dropped(hits)
    same = lambda t: F.col("d.doc_id").eqNullSafe(F.col(f"{t}.doc_id")) & (F.col("d.same") == F.col(f"{t}.same"))
    none = lambda c, t: F.coalesce(c, F.expr(f"cast(array() as {t})")).alias(c.split(".")[1])
    rows = by_doc.alias("d").join(spans, same("s"), "left").join(named, same("i"), "left")
    return rows.select("d.doc_id", "d.n_words", none("s.spans", "array<struct<start: int, end: int>>"), none("i.items", "array<bigint>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any word inside a window of the benchmark, in all their columns."""
    _, hits, _ = found_windows(docs.select("doc_id", "text"), benchmark, width)
    gone = stored(hits.select("doc_id", "same").distinct(), "gone")
    dropped(hits)
    clear, maybe = apart(in_struct(docs), gone, "same")
    gone = gone.select(F.col("doc_id").cast("long").alias("gone_id"), F.col("same").alias("gone_same"))
    left = maybe.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("same") == F.col("gone_same")), "left_anti")
    return clear.unionByName(left).select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
