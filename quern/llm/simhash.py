"""SimHash near-duplicates through a Gray-order hierarchical index.

Documents with equal fingerprints are one class. Fingerprints at most ``radius`` bits apart
agree wholly in one of a few blocks of bits, so each distinct fingerprint is filed under
each of its blocks. Within a block fingerprints are sorted by Gray rank, in which neighbours
share long masked patterns, and cut into leaves of up to LEAF; a node holds the bits that all of
its members share (a mask and their pattern). Two nodes whose shared bits already differ in more
than ``radius`` places are pruned as a whole. What is left is compared bit by bit.

A block that many fingerprints share is spread over the tasks by Gray rank; its leaves meet as
nodes, and only pairs of leaves that are not pruned have their members compared. Of the links
in a leaf, or between two, a spanning forest is kept, which joins the same components.

A fingerprint may have several words of 64 bits, for similarities (rather than bits) as the measure:
512 bits tell a Jaccard similarity to about 0.03. No blocks are exact for such a radius; plan() takes as many as bring
together 99 % of pairs at that similarity. They find candidates only: the similarity itself is taken from the sets of shingles.

Nulls, ties, empties: null and empty texts have no words and fingerprint zero, linked like any
other; texts of fewer words than a shingle have one shingle of them all; repeated rows and equal
doc_ids are rows of their own with the same result; a null doc_id is never the smallest of a
component unless all are null; an empty table gives no rows; columns other than doc_id and text
aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bytes_of, dropped, in_struct, quoted, stored
from .components import Forest, components

#: A-Z become a-z, white space becomes a space; other bytes stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
LEAF = 64
#: Rows that a task holds at a time.
HELD = 1 << 18
#: Shingles of a group of candidates that are held at a time, about.
PART = 1 << 21
_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    from xxhash import xxh64_intdigest

    found = [w for w in text.translate(_WORDS).split(b" ") if w]
    n = max(1, len(found) - width + 1) if found else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(found[i : i + width]), 42) for i in range(n)), np.uint64, n))


def fingerprint(text: bytes, width: int = 3, words: int = 1) -> np.ndarray:
    """64 bits for each of so many words. A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = [w for w in text.translate(_WORDS).split(b" ") if w]
    if not found:
        return np.zeros(words, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - width + 1)
    last = ends[min(width, len(found)) - 1 :]
    hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, map(slice, starts[:n].tolist(), last.tolist())), repeat(42)), np.uint64, n)
    return np.array([majority(_spread(hashes, w)) for w in range(words)], np.uint64)


def _spread(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for the first word, other hashes of the same shingles for each other one."""
    if not word:
        return hashes
    x = (hashes ^ np.uint64(word)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)].astype(">u8"))
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes)).tobytes().hex(), 16)


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fp0 and so on (the fingerprint's words as signed integers) of each document."""
    names = [f"fp{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, words) for t in bytes_of(b)], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in fps.T)], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where codes stand in Gray order: neighbours in this order share long runs of bits."""
    x = x.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def distance(x: np.ndarray) -> np.ndarray:
    """Bits set in all words of differences (in the last axis)."""
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def links_within(codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among codes (rows of words) in Gray order, by a hierarchy of nodes over them."""
    n = len(codes)
    if n < 2:
        return []
    forest, out = Forest(n), []
    if n <= 2 * LEAF:
        _compare(codes, 0, codes, 0, radius, forest, out, same=True)
        return out
    starts = np.arange(0, n, LEAF)
    mask, pattern = shared_bits(codes, starts)
    for i, s in enumerate(starts.tolist()):
        a = codes[s : s + LEAF]
        _compare(a, s, a, s, radius, forest, out, same=True)
        # What the nodes' shared bits accumulate as differences; nodes beyond the radius are pruned whole.
        apart = distance((pattern[i] ^ pattern[i + 1 :]) & mask[i] & mask[i + 1 :])
        for j in (np.flatnonzero(apart <= radius) + i + 1).tolist():
            t = int(starts[j])
            _compare(a, s, codes[t : t + LEAF], t, radius, forest, out, same=False)
    return out


def shared_bits(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes over codes: the masks of the bits in which all codes from each start agree, and these bits."""
    mask = np.bitwise_and.reduceat(codes, starts) | ~np.bitwise_or.reduceat(codes, starts)
    return mask, codes[starts] & mask


def _compare(a: np.ndarray, at: int, b: np.ndarray, bt: int, radius: int, forest: Forest, out: list, same: bool) -> None:
    near = distance(a[:, None] ^ b[None, :]) <= radius
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1) if same else near)), strict=True):
        if forest.join(at + i, bt + j):
            out.append((at + i, bt + j))


def blocks_of(radius: int) -> list[int]:
    """Masks of which any two codes at most radius bits apart agree wholly in one.

    Up to 2 bits: each of radius + 1 blocks. Beyond, where such blocks would be too short to tell
    codes apart: each pair of radius + 2 blocks, of which at least two agree.
    """
    n = radius + 1 if radius <= 2 else radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return blocks if radius <= 2 else [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """a, b: pairs of nodes at most radius bits apart that join all components of such pairs that agree in a block.

    fps: node, fp0 and so on: distinct fingerprints, in a table that reads alike each time.
    blocks: word and mask of each.
    """
    names = [c for c in fps.columns if c.startswith("fp")]
    words = len(names)
    filed = fps.select("node", *names, F.posexplode(F.array(*[F.col(f"fp{w}").bitwiseAND(F.lit(_signed(m))) for w, m in blocks])).alias("block", "key"))
    filed = filed.withColumn("rank", _gray_rank("fp0"))
    # By range, so that a key which many fingerprints share is spread by Gray rank.
    filed = filed.repartitionByRange("block", "key", "rank").sortWithinPartitions("block", "key", "rank").select("node", *names, "block", "key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64()), ("key", pa.int64()), ("mask", pa.list_(pa.int64())), ("pattern", pa.list_(pa.int64())), ("nodes", pa.binary()), ("codes", pa.binary())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield from some(held)
                held, size = [], 0
        yield from some(held)

    def some(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in rows])
        if not sum(b.num_rows for b in rows):
            return
        node, block, key = column("node"), column("block"), column("key")
        fp = np.stack([column(c) for c in names], axis=1).view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])]))
        ends = np.concatenate([new[1:], [len(fp)]])
        many = ends - new > 1
        many[[0, -1]] = True  # these runs may go on before or after these rows
        pairs, nodes, step = [], [], 16 * LEAF
        for lo, hi in zip(new[many].tolist(), ends[many].tolist(), strict=True):
            for s in range(lo, hi, step):
                part, own = fp[s : min(hi, s + step)], node[s : min(hi, s + step)]
                pairs += [(int(own[i]), int(own[j])) for i, j in links_within(part, radius)]
                if hi - lo > step or lo == 0 or hi == len(fp):
                    mask, pattern = shared_bits(part, np.zeros(1, np.int64))
                    nodes.append((int(block[lo]), int(key[lo]), mask[0].view(np.int64).tolist(), pattern[0].view(np.int64).tolist(), own.tobytes(), part.tobytes()))
        none = [None] * len(nodes)
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([a, b, *[[None] * len(a)] * 6], schema.types, strict=True)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none, none, *(zip(*nodes, strict=True) if nodes else [[]] * 6)], schema.types, strict=True)], schema=schema)

    found = stored(filed.mapInArrow(leaves, "a long, b long, block long, key long, mask array<long>, pattern array<long>, nodes binary, codes binary"), "leaves")
    nodes = found.filter("codes is not null").drop("a", "b").withColumn("id", F.xxhash64("nodes"))
    x, y = nodes.alias("x"), nodes.alias("y")
    differ = lambda w: F.col("x.pattern")[w].bitwiseXOR(F.col("y.pattern")[w]).bitwiseAND(F.col("x.mask")[w]).bitwiseAND(F.col("y.mask")[w])
    apart = sum((F.bit_count(differ(w)) for w in range(1, words)), F.bit_count(differ(0)))
    pairs = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (apart <= radius))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for r in b.to_pylist():
                p, q = (np.frombuffer(r[c], np.uint64).reshape(-1, words) for c in ("x_codes", "y_codes"))
                ours, theirs = (np.frombuffer(r[c], np.int64) for c in ("x_nodes", "y_nodes"))
                forest = Forest(len(p) + len(q))
                starts = np.arange(0, len(p), LEAF)
                for s, mask, pattern in zip(starts.tolist(), *shared_bits(p, starts), strict=True):
                    at = np.flatnonzero(distance((q ^ pattern) & mask) <= radius)  # others are pruned by the node's shared bits
                    near = distance(p[s : s + LEAF, None] ^ q[None, at]) <= radius
                    for i, j in zip(*(v.tolist() for v in np.nonzero(near)), strict=True):
                        if forest.join(s + i, len(p) + int(at[j])):
                            out.append((int(ours[s + i]), int(theirs[at[j]])))
            a, b_ = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])

    across = pairs.select(*(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in ("nodes", "codes"))).mapInArrow(between, "a long, b long")
    return found.filter("a is not null").select("a", "b").unionByName(across)


def _gray_rank(col: str) -> F.Column:
    """gray_rank() in SQL, as a value whose signed order is that of the unsigned rank."""
    x = F.col(col)
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, words: int = 1, blocks: list[tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, fp0 and so on, component_id (the smallest doc_id that can be reached) of each document.

    Without ``blocks`` those are taken in which any two fingerprints of one word within the radius agree. With others, links
    between fingerprints that agree in none of them are missed.
    """
    names = [f"fp{w}" for w in range(words)]
    fps = _noded(fingerprints(docs, width, words), names)
    return _with_components(fps, names, radius, blocks or [(0, m) for m in blocks_of(radius)]).select("doc_id", *names, "component_id")


def _noded(fps: DataFrame, names: list[str]) -> DataFrame:
    return stored(fps.withColumn("node", F.col("fp0") if len(names) == 1 else F.xxhash64(*names)), "fingerprints")


def _with_components(fps: DataFrame, names: list[str], radius: int, blocks: list[tuple[int, int]], label: str = "doc_id") -> DataFrame:
    """fps with component_id, the least label that can be reached."""
    classes = stored(fps.groupBy("node", *names).agg(F.min(label).alias("first")), "classes")
    edges = stored(links(classes.select("node", *names), radius, blocks), "links")
    # Stored, so that the join below has plain exchanges on both sides and may split a fingerprint that many documents share.
    joined = stored(components(classes.select("node", F.col("first").alias("label")), edges), "components")
    dropped(classes, edges)
    return fps.join(joined.select("node", F.col("label").alias("component_id")), "node")


def hex_of(fp: str) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similar_blocks(words: int, each: int = 5) -> list[tuple[int, int]]:
    """Blocks for radii that no exact set of blocks can serve: each word in equal parts."""
    edges = [64 * i // each for i in range(each + 1)]
    return [(w, ((1 << hi) - 1) ^ ((1 << lo) - 1)) for w in range(words) for lo, hi in zip(edges, edges[1:], strict=False)]


def share_of_bits(similarity: float) -> float:
    """Of the bits of two fingerprints, how many are expected to differ where sets of shingles have that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_radius(words: int, similarity: float) -> int:
    """Bits that differ where sets of shingles have that Jaccard similarity: as many as expected, and three standard deviations more."""
    share = share_of_bits(similarity)
    return round(64 * words * share + 3 * math.sqrt(64 * words * share * (1 - share)))


def plan(n: int, similarity: float, recall: float = 0.99, per_document: int = 100_000) -> tuple[int, int]:
    """Words of a fingerprint, and blocks in each word, for n documents.

    Blocks are as short as they can be for each document to meet at most per_document others by chance, and so many that pairs of
    that similarity agree in one of them with that probability. So recall is the same at every size, and work grows about as n does.
    """
    for each in (5, 4, 3, 2):
        met = (1 - share_of_bits(similarity)) ** (64 / each)
        words = math.ceil(math.log(1 - recall) / math.log(1 - met) / each)
        if n * words * each / 2 ** (64 / each) <= per_document or each == 2:
            break
    return words, each


def clusters(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places) of a spanning forest of the sets (ascending arrays) that have that Jaccard similarity or more.

    A set is held against one member after the other of a cluster, the first ones before, until one is similar, and only if it shares
    enough with all members together. Empty sets are alike.
    """
    forest, out = Forest(len(sets)), []
    members: dict[int, list[int]] = {}  # clusters by the place of their first member
    holders: dict[int, set[int]] = {}  # clusters by shingle
    none: int | None = None

    def near(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        if len(a) < similarity * len(b):
            return False
        common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return common >= similarity * (len(a) + len(b) - common)

    for i, own in enumerate(sets):
        if not len(own):
            if none is not None:
                out.append((none, i))
            none = i if none is None else none
            continue
        common: dict[int, int] = {}
        hashes = own.tolist()
        for h in hashes:
            for c in holders.get(h, ()):
                common[c] = common.get(c, 0) + 1
        into = None
        for c in sorted(c for c, n in common.items() if n >= similarity * len(own)):
            for j in members[c]:
                if near(i, j):
                    out.append((j, i))
                    if into is None:
                        into = c
                        members[c].append(i)
                        own_cluster = set(hashes)
                    else:  # joins two clusters
                        for m in members[c]:
                            own_cluster.update(sets[m].tolist())
                        members[into] += members.pop(c)
                        for x in own_cluster:
                            holders.setdefault(x, set()).discard(c)
                    break
        if into is None:
            into, members[i], own_cluster = i, [i], set(hashes)
        for x in own_cluster:
            holders.setdefault(x, set()).add(into)
    return out


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, in all their columns, without those that are near copies of one that stays.

    Documents are linked where their sets of shingles have that Jaccard similarity or more; of the documents that links join,
    that of the smallest doc_id (null last) stays. Fingerprints find candidates only (see plan()), and groups of candidates are
    verified on the sets themselves, large groups in parts (each pair of parts by itself). Of rows that repeat a doc_id and text
    one stays; rows are told apart by both.
    """
    words, each = plan(docs.count(), similarity)
    names = [f"fp{w}" for w in range(words)]
    rows = in_struct(docs).select("row", "doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), "row.text").alias("key"))
    own = rows.select(F.col("key").alias("doc_id"), "row.text")
    fps = _noded(fingerprints(own, width, words).distinct(), names)
    found = _with_components(fps, names, similar_radius(words, similarity), similar_blocks(words, each))
    found = stored(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")), "groups")
    many = stored(found.groupBy("group").count().filter("count > 1").select("group"), "many")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(shingles(t, width).view(np.int64)) for t in bytes_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("doc_id"), b.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["group", "doc_id", "key", "sets"])

    alike = found.join(many, "group", "left_semi").join(rows.select("key", "doc_id", "row.text"), "key").dropDuplicates(["key"])
    sets = stored(alike.select("group", "doc_id", "key", "text").mapInArrow(hashed, "group long, doc_id long, key long, sets array<long>"), "sets")
    parts = sets.groupBy("group").agg(F.ceil(F.sum(F.size("sets") + 1) / PART).cast("int").alias("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sets.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int")).withColumn("other", other)
    dealt = dealt.select("group", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "key", "sets")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held = None, [], []

        def close() -> pa.RecordBatch:
            pairs = clusters(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([keys[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            column, at = b.column("sets"), list(zip(*(b.column(c).to_pylist() for c in ("group", "x", "y")), strict=True))
            for i, key in enumerate(b.column("key").to_pylist()):
                if at[i] != now:
                    if len(held) > 1:
                        yield close()
                    now, keys, held = at[i], [], []
                keys.append(key)
                held.append(column[i].values.to_numpy().copy())
        if len(held) > 1:
            yield close()

    links_ = stored(dealt.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "key").mapInArrow(verified, "a long, b long"), "similar")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    joined = components(sets.select(F.col("key").alias("node"), first.alias("label")), links_)
    gone = stored(joined.filter(F.col("label.key") != F.col("node")).select("node").join(sets.select(F.col("key").alias("node"), "doc_id"), "node"), "gone")
    dropped(fps, found, many, sets, links_)
    clear, maybe = apart(rows, gone.withColumnRenamed("node", "key"), "key")
    gone = gone.select("node", F.col("doc_id").alias("gone_id"))
    left = clear.unionByName(maybe.join(gone, (F.col("key") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))
    if rows.groupBy("key", "doc_id").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["key", "doc_id"])
    return left.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns))
