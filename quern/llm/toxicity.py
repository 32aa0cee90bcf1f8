"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Token scores are log-odds of toxic against clean documents with an informative Dirichlet prior
(the words' shares in both). A document counts each of its words once, and copies of a labelled
text count once, so that neither a long nor a copied text makes a word toxic by itself. Beginnings of words (of STEM bytes
or more) are counted as words are, so that inflected forms add up; a word scores as that of its tokens (itself and its
beginnings) whose log-odds stand out most. Every token has a score: log-odds are shrunk smoothly by what chance explains,
given how many tokens are looked at, and none is set apart. Counts are held by hash, in a table of a fixed size. A constant
is taken off, so that the mean of exp(score) over clean text is 1: scores are then negative on average, and their exponential
decay (Karlin and Altschul's lambda) is 1. Labelled documents are scored with their own counts left out. All maximal segments of a document are found in one pass
(Ruzzo and Tompa); those whose expected number in clean text of the document's length is small
are its toxic passages. A logistic fit over what these say turns them into a probability.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of
doc_id; all documents are scored.

Nulls, ties, empties: null and empty texts have no words, and the score of that; labels without
a doc_id or label are not used; of several labels of a doc_id the largest counts; repeated rows
and null doc_ids are separate documents; without labels, or with one kind only, no word is toxic
and all scores are the share of toxic labels (0 if there are none); an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, dropped, stored
from .decontam import words_of

#: Bytes of the shortest beginning of a word that is counted.
STEM = 4
#: Places of the table of counts; of a fixed size, whatever the labels.
BUCKETS = 1 << 22
#: Words whose scores a worker keeps.
KNOWN = 500_000
#: Strength of the prior: its words for each word of the smaller class.
PRIOR = 1.0
#: Expected number of segments in clean text of a document's length, below which one is significant.
SIGNIFICANT = 0.05


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)  # of words that stand out by themselves; all others' come from the counts
    pooled: float = -0.01  # of words of which no token was counted
    k: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    bias: float = -20.0
    counts: bytes = b""  # toxic and clean documents by bucket, as int32, packed by zlib
    totals: tuple[int, int, int] = (0, 0, 0)  # tokens, and their sums over toxic and over clean documents
    shift: float = 0.0


def tokens_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, cut between characters."""
    return [word, *(word[:n] + b"*" for n in range(STEM, len(word)) if word[n] & 0xC0 != 0x80)]


def buckets_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' tokens, and where each word's start."""
    from xxhash import xxh3_64_intdigest

    tokens = list(map(tokens_of, words))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = [xxh3_64_intdigest(t) % BUCKETS for own in tokens for t in own]
    return np.array(flat, np.int64), np.cumsum(size) - size


def log_odds(toxic, clean, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with the prior, whose words are spread as those of both classes, and their distance from 0 in standard errors."""
    strength = PRIOR * min(n_toxic, n_clean)
    prior = strength * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (n_toxic + strength)) - np.log(b / (n_clean + strength))
    return delta, np.abs(delta) / np.sqrt(1 / a + 1 / b)


class Scorer:
    """Scores of words; those of words that were met are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, dict(model.scores)
        self.toxic, self.clean = np.frombuffer(zlib.decompress(model.counts), np.int32).reshape(2, -1) if model.counts else (None, None)

    def fresh(self, words: list[bytes], own: tuple[int, int] = (0, 0)) -> list[float]:
        """From the counts, less those of a document (toxic, clean) that is one of the counted."""
        m = self.model
        if self.toxic is None or not words:
            return [m.pooled - m.shift] * len(words)
        at, starts = buckets_of(words)
        toxic, clean = (np.maximum(0, x[at] - less).astype(float) for x, less in zip((self.toxic, self.clean), own, strict=True))
        met = toxic + clean > 0
        delta, z = (np.where(met, x, 0) for x in log_odds(np.where(met, toxic, 1), np.where(met, clean, 1), *m.totals[1:]))
        top = np.maximum.reduceat(z, starts)
        size = np.diff(np.append(starts, len(at)))
        best = np.flatnonzero((z == np.repeat(top, size)) & (met | (np.repeat(top, size) == 0)))
        word = np.repeat(np.arange(len(words)), size)[best]
        first = best[np.unique(word, return_index=True)[1]]
        score = delta[first] * top**2 / (top**2 + 2 * math.log(m.totals[0] + 10))
        return (np.where(np.logical_or.reduceat(met, starts), score, m.pooled) - m.shift).tolist()

    def __call__(self, words: list[bytes]) -> list[float]:
        values = list(map(self.known.get, words))
        if None in values:
            missing = list({w for w, v in zip(words, values, strict=True) if v is None})
            new = dict(zip(missing, self.fresh(missing), strict=True))
            if len(self.known) + len(new) <= KNOWN:  # common words are among the first
                self.known.update(new)
            values = [new[w] if v is None else v for w, v in zip(words, values, strict=True)]
        return values


def scorer_of(model: Model) -> Scorer:
    """One for each Python worker, which keeps a broadcast model."""
    if "scorer" not in vars(model):
        vars(model)["scorer"] = Scorer(model)
    return vars(model)["scorer"]


def segments(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of words."""
    return maximal(Scorer(model)(words))


def maximal(values: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass."""
    # Candidates as start, end, sum before the start, sum at the end, index of the last one with a lesser sum before.
    left: list[int] = []
    right: list[int] = []
    before: list[float] = []
    upto: list[float] = []
    less: list[int] = []
    total = 0.0
    for i, s in enumerate(values):
        if s > 0:
            lo, low = i, total
            total += s
            hi, high = i + 1, total
            while True:
                j = len(left) - 1
                while j >= 0 and before[j] >= low:
                    j = less[j]
                if j < 0 or upto[j] >= high:
                    break
                lo, low = left[j], before[j]
                del left[j:], right[j:], before[j:], upto[j:], less[j:]
            left.append(lo)
            right.append(hi)
            before.append(low)
            upto.append(high)
            less.append(j)
        else:
            total += s
    return [(a, b, y - x) for a, b, x, y in zip(left, right, before, upto, strict=True)]


def evidence(n_words: int, found: list[tuple[int, int, float]], k: float) -> tuple[float, ...]:
    """What a document's segments say: whether there are any, minus the log of the best one's expected number in clean text of
    that length, and the sums of all scores and of what significant ones have beyond chance.
    """
    chance = math.log(k * max(n_words, 1))
    if not found:
        return 0.0, -chance, 0.0, 0.0
    own = [s - chance for _, _, s in found]
    return 1.0, max(own), math.log1p(sum(s for _, _, s in found)), math.log1p(sum(x for x in own if x > -math.log(SIGNIFICANT)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[tuple[float, ...], float]:
    """Weights and bias by Newton's method with a small ridge. A step is halved until the loss falls enough: whole steps may
    go ever farther off where the classes hardly overlap.
    """
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.array([1e-2] * x.shape[1] + [1e-6])

    def loss(w: np.ndarray) -> float:
        at = z @ w
        return float((np.logaddexp(0, at) - y * at).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = np.exp(-np.logaddexp(0, -(z @ w)))
        slope = z.T @ (y - p) - ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), slope)
        while (then := loss(w + step)) > now - 1e-4 * (slope @ step) and np.abs(step).max() >= 1e-8:
            step /= 2
        if then > now:  # as low as rounding lets it be
            break
        w, now = w + step, then
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def score(scorer: Scorer, words: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
    """Probability that a document is toxic, and its significant passages."""
    model = scorer.model
    found = maximal(scorer(words))
    x = evidence(len(words), found, model.k)
    p = 1 / (1 + math.exp(-min(30, max(-30, model.bias + sum(a * b for a, b in zip(model.weights, x, strict=True))))))
    chance = math.log(model.k * max(len(words), 1))
    return p, [s for s in found if s[2] - chance > -math.log(SIGNIFICANT)]


def in_training() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Learns from labels whose crc32(doc_id) mod 5 isn't 0."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(in_training())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the stated bound
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    rows = stored(rows, "labelled")  # max_rows rows at most (more where a doc_id repeats)
    distinct = stored(rows.dropDuplicates(), "distinct")  # a document that was copied says no more than one

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(bytes_of(b), b.column("toxic").to_pylist(), strict=True):
                seen[toxic > 0].update(set(words_of(text)))
        for toxic, own in enumerate(seen):
            items = list(own.items())
            for i in range(0, len(items), 50_000):
                w, n = zip(*items[i : i + 50_000], strict=True)
                zero = pa.array([0] * len(w), pa.int64())
                n = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), n if toxic else zero, zero if toxic else n], ["word", "toxic", "clean"])

    words = distinct.mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = stored(words, "words")
    totals = words.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    n_words, n_toxic, n_clean = (int(x or 0) for x in totals)
    if not n_toxic or not n_clean:
        share = known.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0] or 0.0
        return Model(bias=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    # Only words that stand out by themselves come to the driver with their text.
    strength = PRIOR * min(n_toxic, n_clean)
    prior = strength * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(a / (n_toxic + strength)) - F.log(b / (n_clean + strength))
    least = math.sqrt(2 * math.log(n_words + 10))
    alone = words.filter(F.abs(delta / F.sqrt(1 / a + 1 / b)) > least).select("word").collect()

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for text, toxic in zip(bytes_of(b), b.column("toxic").to_pylist(), strict=True):
                own[0 if toxic > 0 else 1, np.unique(buckets_of(list(set(words_of(text))))[0])] += 1
        at = np.flatnonzero(own.any(axis=0))
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x[part].astype(np.int64)) for x in own)], ["bucket", "toxic", "clean"])

    by_bucket = distinct.mapInArrow(count_tokens, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").cast("int").alias("toxic"), F.sum("clean").cast("int").alias("clean")).toArrow()  # BUCKETS rows at most
    table = np.zeros((2, BUCKETS), np.int32)
    for x, c in zip(table, ("toxic", "clean"), strict=True):
        x[by_bucket.column("bucket").to_numpy()] = by_bucket.column(c).to_numpy()
    totals = (by_bucket.num_rows, *(int(x.sum(dtype=np.int64)) for x in table))
    # Words that weren't counted are as those that were met once: what share of each class they are.
    once = table[:, table.sum(axis=0) == 1].sum(axis=1) + 1
    pooled = math.log(once[0] / totals[1]) - math.log(once[1] / totals[2])
    model = Model(pooled=min(pooled, -1e-3), counts=zlib.compress(table.tobytes(), 1), totals=totals)
    shared = spark.sparkContext.broadcast(model)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in batches:
            out, toxic = [], [int(y > 0) for y in b.column("toxic").to_pylist()]
            for text, y in zip(bytes_of(b), toxic, strict=True):
                words = words_of(text)
                known = list(set(words))
                known = dict(zip(known, scorer.fresh(known, (y, 1 - y)), strict=True))
                out.append([known[w] for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(toxic, pa.int64())], ["v", "y"])

    sample = stored(rows.mapInArrow(values, "v array<double>, y long"), "values")

    def gathered(of, names: list[str]) -> np.ndarray:
        """What a function says of each sampled document's scores and label, in an order of its own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [of(np.array(v, float), y) for v, y in zip(b.column("v").to_pylist(), b.column("y").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[i] for r in out], float)) for i in range(len(names))], names)

        t = sample.mapInArrow(run, ", ".join(f"{c} double" for c in names)).toArrow()
        x = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        return x[np.lexsort(x.T[::-1])]

    n, total, y = gathered(lambda v, y: (len(v), np.exp(v).sum(), y), ["n", "total", "y"]).T
    clean = y == 0
    model.shift = shift = math.log(math.fsum(total[clean]) / n[clean].sum()) if n[clean].sum() else 0.0
    top, n, y = gathered(lambda v, y: (max((s for *_, s in maximal((v - shift).tolist())), default=0.0), max(1, len(v)), y), ["top", "n", "y"]).T
    # Of clean documents the expected number of segments as good as the best is exponential, with a median of log 2.
    median = np.median((n * np.exp(-top))[y == 0])
    model.k = k = float(math.log(2) / max(median, 1e-9))
    x = gathered(lambda v, y: (*evidence(len(v), maximal((v - shift).tolist()), k), y), ["any", "best", "sum", "beyond", "y"])
    model.weights, model.bias = logistic(x[:, :-1], x[:, -1])
    dropped(sample, words, distinct, rows)
    shared.destroy()
    mine = [bytes(r["word"]) for r in alone]
    model.scores = dict(sorted(zip(mine, Scorer(model).fresh(mine), strict=True)))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages (array of start and end in words, and score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in batches:
            out = [score(scorer, words_of(t)) for t in bytes_of(b)]
            passages = [[{"start": lo, "end": hi, "score": s} for lo, hi, s in p] for _, p in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p for p, _ in out], pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start: int, `end`: int, score: double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, in all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for b in batches:
            yield b.filter(pa.array([score(scorer, words_of(t))[0] < threshold for t in bytes_of(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
