import random
import zlib

import numpy as np

from quern.llm import toxicity
from quern.llm.toxicity import Model, segments

from .helpers import ODD, docs


def brute_best(words, model):
    s = [model.scores.get(w, model.pooled) for w in words]
    best = 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            best = max(best, sum(s[i:j]))
    return best


def all_maximal(scores):
    """By definition: the best stretch, then the same to its left and right."""
    if not scores:
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best, where = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if total[j] - total[i] > best + 1e-12:
                best, where = total[j] - total[i], (i, j)
    if where is None:
        return []
    i, j = where
    return all_maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in all_maximal(scores[j:])]


def test_segments_are_all_maximal_ones():
    r = random.Random(5)
    for _ in range(300):
        model = Model({b"a": 1.375, b"b": 0.7421, b"c": -0.6173}, pooled=-0.2317)
        words = [r.choice([b"a", b"b", b"c", b"x", b"x", b"x"]) for _ in range(r.randint(0, 25))]
        got = segments(words, model)
        assert abs(max((s for *_, s in got), default=0) - brute_best(words, model)) < 1e-9
        values = [model.scores.get(w, model.pooled) for w in words]
        assert sorted((a, b) for a, b, _ in got) == all_maximal(values)


def corpus(spark, n=600, seed=6):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(["alpha", "beta", "gamma", "delta", "one", "two"]) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.25
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "nasty"]))
        rows.append((100 + i, " ".join(words)))
        labels.append((100 + i, int(toxic), 1))
    labels += [(None, 1, 1), (5000, None, 1), (101, labels[1][1], 0)]
    return rows, labels, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out(spark):
    rows, labels, table = corpus(spark)
    df = docs(spark, rows + ODD)
    model = toxicity.fit(df, table)
    assert {b"vile", b"nasty"} == {w for w, s in model.scores.items() if s > 0}
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    truth = {i: t for i, t, _ in labels if t is not None}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((got[i]["score"] >= 0.5) == (truth[i] == 1) for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.without_toxic(df, model)
    assert kept.schema == df.schema and kept.count() == sum(r["score"] < 0.5 for r in toxicity.score_documents(df, model).collect())


def test_labels_of_held_out_rows_say_nothing(spark):
    rows, labels, table = corpus(spark)
    flipped = spark.createDataFrame([(i, 1 - t if i and t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t, q) for i, t, q in labels], table.schema)
    df = docs(spark, rows)
    assert toxicity.fit(df, table) == toxicity.fit(df, flipped)


def test_without_labels(spark):
    df = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_documents(df, toxicity.fit(df, none)).collect()
    assert len(rows) == len(ODD) and all(r["score"] < 0.5 for r in rows)
    assert toxicity.score_documents(df.limit(0), Model()).count() == 0


def test_inflected_forms_add_up(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(200)]
    rows = [(i, " ".join([*r.choices(common, k=60), *(["grolk" + word() for _ in range(4)] if i % 4 == 0 else [])])) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    df = docs(spark, rows)
    model = toxicity.fit(df, labels)
    assert not model.scores  # no form of the word stands out by itself
    got = {x["doc_id"]: x["score"] >= 0.5 for x in toxicity.score_documents(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] != (i % 4 == 0) for i in held) <= 2


def test_the_fit_does_not_run_off():
    """Evidence of a few labels, some far out: whole Newton steps ended at a bias of 5 million, which calls all documents toxic."""
    best = np.r_[8, 16, 16, 19, 190, 17, 3, 4, 4.5, 5, 5.5, 6, 6.2, 7.5, np.linspace(-1, 2.8, 200)]
    y = np.r_[np.ones(5), np.zeros(209)]
    log = np.log1p(np.maximum(best, 0))
    x = np.c_[np.ones(214), best, log + 0.02 * np.cos(9 * best), np.where(best > 3, log, 0)]
    weights, bias = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (y - p) - 0.01 * np.array(weights)).max() < 1e-6  # the minimum
    assert (p[y == 0] > 0.5).sum() <= 1 and (p[y == 1] > 0.5).sum() >= 4
