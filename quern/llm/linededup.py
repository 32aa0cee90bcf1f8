"""Near-duplicate lines by a segment-partition edit join.

Lines within ``radius`` edits share at least one of radius + 1 segments: of each line its
segments are filed under its length (the index), and of each line the substrings that may equal
a segment of a line that is up to ``radius`` shorter are looked up (the probes; of the places
where a segment may stand only those that leave its left and right neighbours enough edits).
No text is shuffled for that: a line is 128 bits of hash and counts of its characters; each task counts a line once.

Lines that share a key are a group. No row is made for a pair: a line stays in its group if another one's
characters differ by no more in number than so many edits can change. Then the texts of these lines, each
once for a group, are verified by a banded bit-parallel edit distance, and a spanning forest of a group's links is
put out; lines that are joined already aren't compared. A group of over LARGE rows is cut into chunks, whose pairs are
dealt out as groups of their own. The links join lines to classes, and of each class the line of the smallest
doc_id and line number stays.

Lines of under ``least`` characters, white space around them aside, aren't compared and stay.

Nulls, ties, empties: null and empty texts have no lines; rows are told apart by doc_id and text, so that
rows which share a doc_id, or have none, lose only their own lines, and rows that repeat both keep or lose the
same ones; a null doc_id comes before all others; doc_ids must be numbers (or cast to them); an empty table gives no rows; columns
other than doc_id, text and n_chars are kept as they are, whatever their names.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, dropped, in_struct, quoted, stored, texts_of
from .common import apart as apart_by
from .components import Forest, components

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters that are hashed at a time.
CHUNK = 1 << 20
#: Pairs that are looked at at a time.
STEP = 1 << 19
#: Bits of the filter over lines whose text is needed; of a fixed size, whatever the input.
FILTER_BITS = 1 << 26
#: Rows of a group that one task compares; larger groups are cut.
LARGE = 1 << 13
#: Rows of a group from which on a mark spares comparisons.
MANY = 256
#: Lines that a task remembers so as not to put them out again.
KNOWN = 1_000_000
_TWO = struct.Struct("<qq")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(33))


def eligible(text: str, least: int) -> tuple[list[int], list[str], int]:
    """Numbers and contents of the lines that are compared, and the number of lines that aren't blank."""
    at, lines, n = [], [], 0
    for i, line in enumerate(text.split("\n")):
        line = line.strip(" \t\r\v\f")
        n += bool(line)
        if len(line) >= least:
            at.append(i)
            lines.append(line)
    return at, lines, n


def line_hash(line: str) -> tuple[int, int]:
    """128 bits, which tell lines apart, as two signed integers."""
    from xxhash import xxh3_128_digest

    return _TWO.unpack(xxh3_128_digest(line.encode()))


def segment(length: np.ndarray, i: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of these lengths: even parts, the longer ones last."""
    k = radius + 1
    short, longer = length // k, length % k
    return i * short + np.maximum(0, i - (k - longer)), short + (i >= k - longer)


def segment_keys(lines: list[str], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the lowest bit is 1 for probes) and the line of each."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(length) - length
    power, inverse = (np.full(len(codes) + 1, x, np.uint64) for x in (_BASE, _INVERSE))
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power), np.cumprod(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * power[:-1])])
    keys, owners = [], []

    def put(first: np.ndarray, n: np.ndarray, indexed: np.ndarray, i: int, probe: int, own: np.ndarray) -> None:
        h = (total[first + n] - total[first]) * inverse[first]
        h = _mix(_mix(h + indexed.astype(np.uint64) * _ODD) + np.array([i + 1], np.uint64) * _BASE)
        keys.append((h & ~np.uint64(1)) | np.uint64(probe))
        owners.append(own)

    everything = np.arange(len(lines))
    for i in range(radius + 1):
        p, n = segment(length, i, radius)
        put(start + p, n, length, i, 0, everything)
        for shorter in range(radius + 1):
            p, n = segment(length - shorter, i, radius)
            # Edits to the left of the segment are at most i, to the right at most radius - i.
            for shift in range(max(-i, shorter - (radius - i)), min(i, shorter + radius - i) + 1):
                if not shorter and not shift:
                    continue  # the line's own segment, which is in the index
                ok = np.flatnonzero((p + shift >= 0) & (p + shift + n <= length) & (n > 0) & (length > shorter))
                put(start[ok] + p[ok] + shift, n[ok], length[ok] - shorter, i, 1, ok)
    return np.concatenate(keys), np.concatenate(owners)


def signatures(lines: list[str]) -> np.ndarray:
    """64 bits of each line: how often its characters fall into each of 32 kinds, modulo 4."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    kinds = (codes * np.uint32(0x9E3779B1)) >> np.uint32(27)
    counts = np.bincount(own * 32 + kinds, minlength=32 * len(lines)).reshape(-1, 32).astype(np.uint64) & np.uint64(3)
    return np.bitwise_or.reduce(counts << (2 * np.arange(32)).astype(np.uint64), axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much counts of kinds differ at least, in total; one edit changes that by 2 at most."""
    low = 0x5555555555555555
    odd = (a ^ b) & np.uint64(low)
    two = (((a ^ b) >> np.uint64(1)) ^ (~a & b)) & np.uint64(low) & ~odd
    return np.bitwise_count(odd) + 2 * np.bitwise_count(two)


def within(a: str, b: str, radius: int) -> bool:
    """Whether a and b are at most radius edits apart: a bit-parallel automaton over the band of diagonals.

    Bit o + radius of level e: with e edits the characters of b so far match those of a up to o more.
    """
    if abs(len(a) - len(b)) > radius:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the common prefix costs no edits
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    width = 2 * radius + 1
    full = (1 << width) - 1
    levels, grown = [], 1 << radius
    for _ in range(radius + 1):
        levels.append(grown)
        grown = (grown | grown << 1) & full
    for j, c in enumerate(b):
        same = 0
        for o in range(max(0, radius - j), min(width, len(a) - j + radius)):
            if a[j + o - radius] == c:
                same |= 1 << o
        new = levels[0] & same
        out = [new]
        for e in range(1, radius + 1):
            less = levels[e - 1]
            new = ((levels[e] & same) | less | less >> 1 | new << 1) & full
            out.append(new)
        levels = out
        if not levels[-1]:
            return False
    end = len(a) - len(b) + radius
    return 0 <= end < width and bool(levels[-1] >> end & 1)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, same (a hash of the text), n_lines, at (line numbers), hi and lo (hashes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [eligible(t, least) for t in texts_of(b)]
            hashes = [[line_hash(x) for x in lines] for _, lines, _ in found]
            halves = [pa.array([[h[i] for h in own] for own in hashes], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array([n for *_, n in found], pa.int64()), pa.array([at for at, *_ in found], pa.list_(pa.int32())), *halves], ["doc_id", "same", "n_lines", "at", "hi", "lo"])

    return docs.select("doc_id", F.xxhash64("text").alias("same"), "text").mapInArrow(run, "doc_id long, same long, n_lines long, at array<int>, hi array<long>, lo array<long>")


def _each(by_doc: DataFrame) -> DataFrame:
    """doc_id, same, at, line (a struct of both halves of the hash) of each line that is compared."""
    rows = by_doc.select("doc_id", "same", F.explode(F.arrays_zip("at", "hi", "lo")).alias("x"))
    return rows.select("doc_id", "same", F.col("x.at").alias("at"), F.struct(F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo")).alias("line"))


def _distinct(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Hashes (rows of two halves) and contents of a task's lines, each once (but for what was forgotten), in chunks of about CHUNK characters."""
    seen: set[tuple[int, int]] = set()
    hashes, lines, size = [], [], 0
    for b in batches:
        for t in texts_of(b):
            for line in eligible(t, least)[1]:
                if (h := line_hash(line)) not in seen:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(h)
                    hashes.append(h)
                    lines.append(line)
                    size += len(line)
                    if size >= CHUNK:
                        yield np.array(hashes, np.int64), lines
                        hashes, lines, size = [], [], 0
    if lines:
        yield np.array(hashes, np.int64), lines


_FOUND = pa.schema([("gid", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("probe", pa.bool_()), ("chunk", pa.int64()), ("rows", pa.binary())])


def _met(key: np.ndarray, rows: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Which rows (hi, lo, sign) have a row of another line in their group whose characters are alike enough, where one of both is of
    the index. Rows are in order of their groups; pairs are looked at in bounded steps and none is kept.
    """
    sign, indexed = rows[:, 2].view(np.uint64), (key & np.uint64(1)) == 0
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    out = np.zeros(len(key), bool)
    for s, n in zip(starts[size > MANY].tolist(), size[size > MANY].tolist(), strict=True):
        part = slice(s, s + n)
        out[part] = _met_in(sign[part], rows[part], indexed[part], radius)
    own = np.repeat(np.arange(len(starts)), size)
    index = np.flatnonzero(indexed & (size[own] > 1) & (size[own] <= MANY))
    upto = np.cumsum(size[own[index]])
    lo = 0
    while lo < len(index):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP)))
        mine = index[lo:hi]
        n = size[own[mine]]
        a = np.repeat(mine, n)
        b = np.repeat(starts[own[mine]] - (np.cumsum(n) - n), n) + np.arange(len(a))
        ok = apart(sign[a], sign[b]) <= 2 * radius
        a, b = a[ok], b[ok]
        other = (rows[a, 0] != rows[b, 0]) | (rows[a, 1] != rows[b, 1])
        out[a[other]] = out[b[other]] = True
        lo = hi
    return out


def _met_in(sign: np.ndarray, rows: np.ndarray, indexed: np.ndarray, radius: int) -> np.ndarray:
    """_met() of one large group: a row that has its mark is only held against those without one."""
    out, open_ = np.zeros(len(sign), bool), np.arange(len(sign))
    everything = open_
    for a in np.flatnonzero(indexed).tolist():
        if not len(open_):
            break
        at = open_ if out[a] else everything
        at = at[apart(sign[a : a + 1], sign[at]) <= 2 * radius]
        at = at[(rows[at, 0] != rows[a, 0]) | (rows[at, 1] != rows[a, 1])]
        if len(at):
            out[at] = out[a] = True
            open_ = open_[~out[open_]]
    return out


def _members(gid: np.ndarray, rows: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
    n = len(gid)
    none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(probe), *none], schema=_FOUND)


def _groups(docs: DataFrame, least: int, radius: int) -> DataFrame:
    """gid, hi, lo, probe: lines that share a key and whose characters are alike enough, a row for each line of a group.

    A group of over LARGE rows is cut into chunks, and each pair of chunks is a group (gid) of its own, in a task of its own.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, lines in _distinct(batches, least):
            key, own = segment_keys(lines, radius)
            line, sign = hashes[own], signatures(lines)[own]
            for i in range(0, len(key), 100_000):
                j = i + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j].view(np.int64)), *(pa.array(x[i:j]) for x in line.T), pa.array(sign[i:j].view(np.int64))], ["key", "hi", "lo", "sign"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
        chunks, waiting = 0, []  # chunks that the first group held has put out already

        def done(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups."""
            order = np.lexsort((rows[:, 1], rows[:, 0], key))
            key, rows = key[order], rows[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            key, rows = key[new], rows[new]
            group = key >> np.uint64(1)
            met = _met(key, rows, group, radius)
            if met.any():
                yield _members(group[met].view(np.int64), rows[met], (key[met] & np.uint64(1)).astype(bool))

        def chunk(key: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            data = np.column_stack([rows, (key & np.uint64(1)).astype(np.int64)]).tobytes()
            return pa.RecordBatch.from_pylist([{"gid": int((key[0] >> np.uint64(1)).view(np.int64)), "chunk": chunks, "rows": data}], schema=_FOUND)

        def step(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held_key, held, chunks, waiting
            held_key = np.concatenate([held_key, *(b.column("key").to_numpy().view(np.uint64) for b in waiting)])
            held = np.concatenate([held, *(np.column_stack([b.column(c).to_numpy() for c in ("hi", "lo", "sign")]) for b in waiting)])
            waiting = []
            while len(held_key):
                group = held_key >> np.uint64(1)
                # Groups are in signed order of the key, of which only equality is used here.
                n = int(np.flatnonzero(group != group[0])[0]) if group[-1] != group[0] else len(group)
                ended = n < len(group) or last
                if chunks or n > LARGE:
                    take = min(n, LARGE)
                    if take < LARGE and not ended:
                        return
                    yield chunk(held_key[:take], held[:take])
                    chunks = 0 if ended and take == n else chunks + 1
                    held_key, held = held_key[take:], held[take:]
                    continue
                edges = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
                sizes = np.diff(np.concatenate([[0], edges]))
                small = int(np.argmax(sizes > LARGE)) if (sizes > LARGE).any() else len(sizes)
                if not last and small == len(sizes):
                    small -= 1  # the last one may go on
                if not small:
                    return
                upto = int(edges[small - 1])
                yield from done(held_key[:upto], held[:upto])
                held_key, held = held_key[upto:], held[upto:]

        size = 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= STEP // 4:
                yield from step(last=False)
                size = 0
        yield from step(last=True)

    dealt = docs.mapInArrow(keys, "key long, hi long, lo long, sign long").repartition(F.shiftrightunsigned("key", 1)).sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(meet, "gid long, hi long, lo long, probe boolean, chunk long, rows binary"), "met")
    large = found.filter("chunk is not null").select("gid", "chunk", "rows")
    x, y = (large.select("gid", F.col("chunk").alias(f"chunk_{c}"), F.col("rows").alias(f"rows_{c}")) for c in "xy")
    pairs = x.join(y, "gid").filter("chunk_x <= chunk_y").select(F.xxhash64("gid", "chunk_x", "chunk_y").alias("gid"), (F.col("chunk_x") == F.col("chunk_y")).alias("same"), "rows_x", "rows_y")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = [np.frombuffer(r[c], np.int64).reshape(-1, 4) for c in ("rows_x", "rows_y")]
                rows = own[0] if r["same"] else np.concatenate(own)
                key = rows[:, 3].astype(np.uint64)
                met = _met(key, rows, np.zeros(len(key)), radius)
                if met.any():
                    yield _members(np.full(int(met.sum()), r["gid"]), rows[met], rows[met, 3].astype(bool)).select(["gid", "hi", "lo", "probe"])

    spread = pairs.repartition("gid").mapInArrow(across, "gid long, hi long, lo long, probe boolean")
    return found.filter("chunk is null").select("gid", "hi", "lo", "probe").unionByName(spread)


def forest(lines: list[str], probe: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (places in lines) of a spanning forest of the lines at most radius edits apart, where one of both is of the index.

    Lines that are joined already aren't compared; neighbours in order of the text are looked at first.
    """
    n, sign, joined, out = len(lines), signatures(lines), Forest(len(lines)), []
    component = np.arange(n)

    def link(i: int, j: int) -> None:
        if component[i] != component[j] and within(lines[i], lines[j], radius):
            joined.join(i, j)
            component[component == component[j]] = component[i]
            out.append((i, j))

    order = sorted(range(n), key=lines.__getitem__)
    for i, j in zip(order, order[1:], strict=False):
        if not (probe[i] and probe[j]) and apart(sign[i : i + 1], sign[j : j + 1])[0] <= 2 * radius:
            link(i, j)
    for i in range(n - 1):
        if len(out) == n - 1:
            break
        ok = (component[i + 1 :] != component[i]) & ~(probe[i] & probe[i + 1 :])
        at = np.flatnonzero(ok) + i + 1
        for j in at[apart(sign[i : i + 1], sign[at]) <= 2 * radius].tolist():
            link(i, j)
    return out


def _texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """hi, lo, text of the wanted lines (hi, lo). A filter of a fixed size keeps most others from the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Bits.of(wanted, "lo", FILTER_BITS).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits.unpacked(shared.value)
        for hashes, lines in _distinct(batches, least):
            mine = np.flatnonzero(bits.have(np.ascontiguousarray(hashes[:, 1])))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[mine, 0]), pa.array(hashes[mine, 1]), pa.array([lines[i] for i in mine.tolist()], pa.string())], ["hi", "lo", "text"])

    found = docs.mapInArrow(run, "hi long, lo long, text string").groupBy("hi", "lo").agg(F.any_value("text").alias("text"))
    return found.join(wanted, ["hi", "lo"], "left_semi")


def _links(members: DataFrame, texts: DataFrame, radius: int) -> DataFrame:
    """a, b: a spanning forest of each group's links."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            lines = [r["text"] for r in held]
            line = lambda i: {"hi": held[i]["hi"], "lo": held[i]["lo"]}
            found = forest(lines, np.array([r["probe"] for r in held], bool), radius)
            return pa.RecordBatch.from_arrays([pa.array([line(pair[k]) for pair in found], pa.struct([("hi", pa.int64()), ("lo", pa.int64())])) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for r in b.to_pylist():
                if r["gid"] != now:
                    if len(held) > 1:
                        yield close()
                    now, held = r["gid"], []
                held.append(r)
        if len(held) > 1:
            yield close()

    rows = members.join(texts, ["hi", "lo"]).select("gid", "probe", "hi", "lo", "text").repartition("gid").sortWithinPartitions("gid")
    return rows.mapInArrow(verify, "a struct<hi: long, lo: long>, b struct<hi: long, lo: long>")


def line_classes(docs: DataFrame, least: int = 40, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: doc_id, same, n_lines, at, hi, lo of each document; and of each distinct line (line) the doc_id, line number
    and text's hash (first) of the first line of its class.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_doc = stored(_lines(rows, least), "lines")
    distinct = stored(_each(by_doc).groupBy("line").agg(F.min(F.struct("doc_id", "at", "same")).alias("first")), "distinct")
    members = stored(_groups(rows, least, radius), "members")
    ends = stored(members.select("hi", "lo").distinct(), "ends")
    texts = stored(_texts(rows, ends, least), "texts")
    links = stored(_links(members, texts, radius), "links")
    joined = components(distinct.select(F.col("line").alias("node"), F.col("first").alias("label")), links)
    classes = stored(joined.select(F.col("node").alias("line"), F.col("label").alias("first")), "classes")
    dropped(distinct, members, ends, texts, links)
    return by_doc, classes


def _again(docs: DataFrame, least: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: line_classes()'s first one; and doc_id, same, at, kept_in of each line that isn't its class's first."""
    by_doc, classes = line_classes(docs, least, radius)
    first = functools.reduce(lambda x, c: x & F.col(f"first.{c}").eqNullSafe(F.col(c)), ["doc_id", "at", "same"], F.lit(True))
    again = _each(by_doc).join(classes, "line").filter(~first)
    found = stored(again.select("doc_id", "same", "at", F.col("first.doc_id").alias("kept_in")), "again")
    dropped(classes)
    return by_doc, found


def removed_lines(docs: DataFrame, least: int = 40, radius: int = 2) -> DataFrame:
    """doc_id, n_lines, removed (line numbers, ascending), kept_in (doc_ids that keep what was removed) of each document."""
    by_doc, again = _again(docs, least, radius)
    gone = again.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("at")).alias("removed"), F.array_sort(F.collect_set("kept_in")).alias("kept_in"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.same") == F.col("g.same"))
    found = by_doc.select("doc_id", "same", "n_lines").alias("d").join(gone.alias("g"), same, "left")
    empty = lambda c, t: F.coalesce(F.col(f"g.{c}"), F.expr(f"cast(array() as array<{t}>)")).alias(c)
    return found.select("d.doc_id", "n_lines", empty("removed", "int"), empty("kept_in", "bigint"))


def without_lines(docs: DataFrame, least: int = 40, radius: int = 2) -> DataFrame:
    """The documents without the lines that are removed, in all their columns (n_chars, if there, is kept in step).

    Documents that lost lines, and of which no line is left that isn't blank, go. So no line goes of which the kept one is not in a
    document that stays.
    """
    by_doc, again = _again(docs, least, radius)
    found = stored(again.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("at")).alias("gone")), "removed")
    dropped(by_doc, again)
    clear, maybe = apart_by(in_struct(docs), found, "same")
    found = found.select(F.col("doc_id").alias("found_id"), F.col("same").alias("found_same"), "gone")
    text = F.col("row.text")
    rows = maybe.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("same") == F.col("found_same")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")))
    rows = rows.filter(F.col("kept").isNull() | (F.length(F.btrim("kept", F.lit(" \t\r\v\f\n"))) > 0))
    new = {"text": F.coalesce("kept", text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    old = {c: F.col(f"row.{quoted(c)}") for c in docs.columns}
    return clear.select(*(x.alias(c) for c, x in old.items())).unionByName(rows.select(*(new.get(c, x).alias(c) for c, x in old.items())))
