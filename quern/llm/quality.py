"""Quality rules: counts over lines and words, and bands of n-gram perplexity by language.

The language model is a modified Kneser-Ney model of order ORDER over a document's characters, for each
language: its words with one space between them, so that n-grams run over the bounds of words and the
model hears their order. A word beyond its first characters depends on itself alone, and the first ones
on the end of what stands before it: each task counts its distinct words and its distinct windows around
spaces, and takes n-grams from these. Only n-grams of the highest order are shuffled, each once for a
task; Spark derives all else from them (lower orders, counts of counts, discounts, continuation counts,
back-off weights) in DataFrames, for all languages at once. Nothing is pruned, and nothing comes to the driver.

The model is stored in SHARDS files of 64-bit n-gram hashes in ascending order (the language is part of
the hash), their log-probabilities and back-off weights. Each Python worker reads them from the shared
folder and finds n-grams by binary search: 16 bytes for each n-gram are its memory. Scores of words and of
windows are kept, up to a bound, and are the same when they are found again.

A model of word n-grams was measured and rejected: see the README.

Bands are Tukey fences, over documents of at least MIN_WORDS words of a language, of how far the
log-perplexity, by word and by character, is from the language's median, in units of what chance makes
of it in so many words: short documents scatter more. By word, marks stuck to words stand out; by character,
tables and other languages.

Nulls, ties, empties: a null text is an empty one; empty texts have no words and fail; a null
language is one of its own, that of the empty name; a character U+0000 counts as U+0001 in n-grams; repeated
rows and null doc_ids are separate documents; an empty table gives no rows; columns other than doc_id, lang
and text aren't read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, commit_file, dropped, filesystem, new_path, stored

ORDER = 4
MIN_WORDS = 50
#: Interquartile ranges beyond the quartiles.
FENCE = 3.0
MEASURES = ("log_perplexity", "char_log_perplexity")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Files of a model; a power of 2.
SHARDS = 16
#: Between words, and before a text. Words hold neither.
SPACE, PAD = " ", "\t"
TAIL = ORDER - 2  # characters before a space that n-grams with the space inside reach
_SPACE = np.uint32(ord(SPACE))
#: Characters that are worked on at a time; words or windows, and their characters, that a task holds.
STEP, HELD, HELD_CHARS = 1 << 20, 1_000_000, 64 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def seed_of(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode())


def _then(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and its last character."""
    return _mix(h * _P + _mix((codes.astype(np.uint64) + np.uint64(1)) * _P))


def hash_of(codes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of n-grams: a row of character codes each."""
    h = seed
    for column in codes.T:
        h = _then(h, column)
    return h


def split(raw: bytes) -> tuple[list[str], list[str]]:
    """The words of a text, and of each word the window from TAIL characters before its space to TAIL after."""
    stream = b" ".join(raw.split()).decode("utf-8", "replace")
    if not stream:
        return [], []
    words, full = stream.split(SPACE), PAD * TAIL + SPACE + stream + SPACE
    starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return words, [full[i : i + 2 * TAIL + 1] for i in [0, *starts[:-1].tolist()]]


def places(keys: list[str], windows: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (rows of ORDER character codes) that end inside these words or windows, and the key of each.

    Of a word these are those that lie in it and its two spaces; of a window those that hold its space before their end and end
    before, or at, the next space.
    """
    joined = "".join(keys) if windows else SPACE + SPACE.join(keys) + SPACE
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[codes == 0] = 1
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.cumsum(size) - size
    if windows:
        at = starts[:, None] + np.arange(ORDER - 1, ORDER - 1 + TAIL)
        ok = at < (starts + size)[:, None]
        space = (codes[np.minimum(at, len(codes) - 1)] == _SPACE) & ok
        ok[:, 1:] &= np.cumsum(space, axis=1)[:, :-1] == 0
    else:
        starts = starts + np.arange(len(keys))  # that of the space before each word
        owner = np.repeat(np.arange(len(keys)), np.maximum(size + 2 - (ORDER - 1), 0))
        each = np.maximum(size + 2 - (ORDER - 1), 0)
        at = starts[owner] + ORDER - 1 + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        return codes[at[:, None] + np.arange(1 - ORDER, 1)], owner
    owner, _ = np.nonzero(ok)
    return codes[at[ok][:, None] + np.arange(1 - ORDER, 1)], owner


def _slices(keys: list[str]) -> Iterator[slice]:
    """Slices of about STEP characters."""
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    lo = 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP)))
        yield slice(lo, hi)
        lo = hi


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, n-grams and counts, a row for each hash."""
    h, grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    new = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])) if len(h) else np.zeros(0, np.int64)
    return h[order[new]], grams[order[new]], np.add.reduceat(n[order], new) if len(new) else n


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: the n-grams of ORDER characters of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[Counter, Counter]] = {}
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, both in seen.items():
                seed = np.array([seed_of(lang)], np.uint64)
                parts = []
                for windows, own in enumerate(both):
                    keys, weight = list(own), np.fromiter(own.values(), np.int64, len(own))
                    for s in _slices(keys):
                        grams, owner = places(keys[s], bool(windows))
                        parts.append(_added([(hash_of(grams, seed), grams, weight[s][owner])]))
                if parts:
                    _, grams, n = _added(parts)
                    for i in range(0, len(n), 200_000):
                        text = np.ascontiguousarray(grams[i : i + 200_000]).view(f"<U{ORDER}").reshape(-1)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text.tolist(), pa.string()), pa.array(n[i : i + 200_000])], ["lang", "gram", "n"])
            seen.clear()

        for b in batches:
            for lang, raw in zip(b.column("lang").to_pylist(), bytes_of(b), strict=True):
                words, windows = split(raw)
                own = seen.setdefault(lang, (Counter(), Counter()))
                own[0].update(words)
                own[1].update(windows)
                chars += len(raw)
                if chars > HELD_CHARS or sum(len(x) for both in seen.values() for x in both) > HELD:
                    yield from flush()
                    chars = 0
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def estimate(grams: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Modified Kneser-Ney from the n-grams of the highest order: lang, gram, logp, weight (either may be null), and stored tables behind it.

    The empty n-gram's log-probability is that of a character that was never seen.
    """
    levels, behind = {ORDER: grams}, []
    for k in range(ORDER - 1, 0, -1):  # a lower order counts how many different characters stand before it
        levels[k] = stored(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"order{k}")
        behind.append(levels[k])
    is_ = lambda i: F.sum((F.col("n") == i).cast("long"))
    out, lower = [], None
    for k in range(1, ORDER + 1):
        t = levels[k]
        d = t.groupBy("lang").agg(*(is_(i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count("*").alias("size"))
        y = F.col("n1") / F.greatest(F.lit(1), F.col("n1") + 2 * F.col("n2"))
        discount = lambda i: F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1), F.col(f"n{i}")), F.lit(0.1)), F.lit(i - 0.1))
        d = stored(d.select("lang", "size", *(discount(i).alias(f"d{i}") for i in (1, 2, 3))), f"discounts{k}")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(d, "lang").select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), "n", less.alias("less"), "size")
        context = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("held"))
        rows = rows.join(context, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("less")) / F.col("total"))
        if k == 1:
            p = F.col("own") + F.col("held") / (F.col("size") + 1)
            out.append(d.select("lang", F.lit("").alias("gram"), F.log(1 / (F.col("size") + 1)).alias("logp"), F.lit(None).cast("double").alias("weight")))
        else:
            suffix = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(suffix, ["lang", "suffix"])
            p = F.col("own") + F.col("held") * F.col("lower")
        lower = stored(rows.select("lang", "gram", "context", p.alias("p"), "held"), f"probabilities{k}")
        behind += [d, lower]
        out.append(lower.select("lang", "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("weight")))
        if k > 1:
            out.append(lower.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("held").alias("weight")).distinct())
    return functools.reduce(DataFrame.unionByName, out), behind


def write_model(model: DataFrame, folder: str) -> list[str]:
    """Writes sorted arrays, SHARDS files at most; their names in order of the hashes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("gram").to_pylist()
            seeds = {x: seed_of(x) for x in set(b.column("lang").to_pylist())}
            seed = np.array([seeds[x] for x in b.column("lang").to_pylist()], np.uint64)
            size, key = np.fromiter(map(len, grams), np.int64, len(grams)), seed.copy()
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                if k:
                    codes = np.frombuffer("".join(grams[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, k)
                    key[at] = hash_of(codes, seed[at])
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(64 - SHARDS.bit_length() + 1)).astype(np.int32)), pa.array(key.view(np.int64)), b.column("logp"), b.column("weight")], ["shard", "key", "logp", "weight"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        uris = []
        for b in batches:
            cols = [b.column("key").to_numpy().view(np.uint64)]
            cols += [b.column(c).fill_null(nothing).to_numpy() for c, nothing in (("logp", -np.inf), ("weight", 0.0))]
            shard = b.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                held.setdefault(s, []).append(tuple(c[shard == s] for c in cols))
        for s in sorted(held):
            key, logp, weight = (np.concatenate(x) for x in zip(*held.pop(s), strict=True))
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # an n-gram may be a context, too
            uri = f"{folder}/shard-{s:04d}.lm"
            parts = [key[new].astype("<u8").tobytes(), np.maximum.reduceat(logp, new).astype("<f4").tobytes(), np.add.reduceat(weight, new).astype("<f4").tobytes()]
            commit_file(uri, parts, TaskContext.get().taskAttemptId())
            uris.append(uri)
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string())], ["uri"])

    rows = model.mapInArrow(keyed, "shard int, key long, logp double, weight double")
    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return sorted(r["uri"] for r in dealt.mapInArrow(write, "uri string").collect())


@functools.lru_cache(maxsize=1)
def read_model(uris: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in ascending order, log-probabilities, log back-off weights; kept in each Python worker."""
    sizes = []
    for uri in uris:
        fs, path = filesystem(uri)
        sizes.append(fs.get_file_info(path).size // 16)
    out = tuple(np.empty(sum(sizes), t) for t in ("<u8", "<f4", "<f4"))
    at = 0
    for uri, n in zip(uris, sizes, strict=True):
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            for x in out:
                x[at : at + n] = np.frombuffer(f.read(n * x.itemsize), x.dtype)
        at += n
    return out


class Scorer:
    """Log-probabilities of texts; those of the first max_keys words and windows are kept, among which common ones are."""

    def __init__(self, uris: list[str], max_keys: int = 1_000_000):
        self.keys, self.logp, self.weight = read_model(tuple(uris))
        self.max_keys = max_keys
        self.known: dict[str, tuple[dict[str, float], dict[str, float]]] = {}
        self.n_known = 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)  # neighbours then look at the same stretch of keys, which the processor still has
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, h[order]), len(self.keys) - 1)
        return at, self.keys[at] == h

    def ngrams(self, grams: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Of each n-gram's last character: from the longest n-gram that was seen, by way of the back-off weights of longer contexts."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            own = grams[todo, ORDER - k :]
            context = hash_of(own[:, :-1], np.full(len(todo), seed[0])) if k else None
            at, seen = self._find(_then(context, own[:, -1]) if k else np.full(len(todo), seed[0]))
            seen &= np.isfinite(self.logp[at])  # not only a context
            out[todo[seen]] += self.logp[at[seen]]
            if seen.all() or not k:
                break
            todo = todo[~seen]
            if k > 1:
                at, known = self._find(context[~seen])
                out[todo[known]] += self.weight[at[known]]
        return out

    def fresh(self, lang: str, keys: list[str], windows: bool) -> list[float]:
        seed, out = np.array([seed_of(lang)], np.uint64), []
        for s in _slices(keys):
            grams, owner = places(keys[s], windows)
            out += np.bincount(owner, weights=self.ngrams(grams, seed), minlength=len(keys[s])).tolist()
        return out

    def texts(self, langs: list[str], texts: list[tuple[list[str], list[str]]]) -> list[float]:
        """Log-probability of each text, given as its words and windows."""
        out = [0.0] * len(texts)
        for lang in set(langs):
            known = self.known.setdefault(lang, ({}, {}))
            mine = [i for i, x in enumerate(langs) if x == lang]
            for kind in (0, 1):
                get, holes = known[kind].get, {}
                for i in mine:
                    own = texts[i][kind]
                    values = list(map(get, own))
                    if None in values:
                        holes[i] = [x for x, y in zip(own, values, strict=True) if y is None]
                        values = filter(None, values)
                    out[i] += sum(values)
                keys = list(set().union(*holes.values()))
                new = dict(zip(keys, self.fresh(lang, keys, bool(kind)), strict=True))
                for i, own in holes.items():
                    out[i] += sum(map(new.__getitem__, own))
                if self.n_known + len(new) <= self.max_keys:
                    known[kind].update(new)
                    self.n_known += len(new)
        return out


@functools.lru_cache(maxsize=1)
def scorer_of(uris: tuple[str, ...]) -> Scorer:
    """One for each Python worker."""
    return Scorer(list(uris))


def fit(docs: DataFrame) -> list[str]:
    """Files of a model of every n-gram of all documents."""
    grams = stored(count_ngrams(docs), "ngrams")
    model, behind = estimate(grams)
    uris = write_model(model, new_path(docs.sparkSession, "model"))
    dropped(grams, *behind)
    return uris


def line_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def measures(docs: DataFrame, uris: list[str]) -> DataFrame:
    """doc_id, lang, the counts, and the log-perplexity by word and by character (null without words) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scorer = scorer_of(tuple(uris))
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                langs, raws = part.column("lang").to_pylist(), bytes_of(part)
                texts = [split(x) for x in raws]
                counts = [line_counts(x.decode("utf-8", "replace"), w) for x, (w, _) in zip(raws, texts, strict=True)]
                logp = scorer.texts(langs, texts)
                by_word = [-p / c[0] if c[0] else None for p, c in zip(logp, counts, strict=True)]
                by_char = [-p / (c[1] + c[0]) if c[0] else None for p, c in zip(logp, counts, strict=True)]
                cols = list(zip(*counts, strict=True)) or [[]] * len(COUNTS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *(pa.array(x, pa.int64()) for x in cols), pa.array(by_word, pa.float64()), pa.array(by_char, pa.float64())], ["doc_id", "lang", *COUNTS, *MEASURES])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, {', '.join(f'{n} long' for n in COUNTS)}, {', '.join(f'{m} double' for m in MEASURES)}")


def quality(docs: DataFrame) -> DataFrame:
    """The measures of each document, how far each of MEASURES is from its language's median (off), the language's band of that
    (low and high), base_failed and kept.
    """
    found = stored(measures(docs, fit(docs)), "measures")
    judged = found.filter(F.col("n_words") >= MIN_WORDS)
    medians = stored(judged.groupBy("lang").agg(*(F.percentile_approx(m, 0.5, 10_000).alias(f"median_{m}") for m in MEASURES)), "medians")
    off = {f"off_{m}": (F.col(m) - F.col(f"median_{m}")) * F.sqrt("n_words") for m in MEASURES}
    quartiles = judged.join(medians, "lang").withColumns(off).groupBy("lang").agg(*(F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in off))
    low = lambda c: (F.col(c)[0] - FENCE * (F.col(c)[1] - F.col(c)[0])).alias(f"low_{c}")
    high = lambda c: (F.col(c)[1] + FENCE * (F.col(c)[1] - F.col(c)[0])).alias(f"high_{c}")
    bands = stored(quartiles.select("lang", *(f(c) for c in off for f in (low, high))), "bands")
    rows = found.join(medians.join(bands, "lang"), "lang", "left").withColumns(off)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.lit(True)
    for c in off:
        inside = inside & F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))
