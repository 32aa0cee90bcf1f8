import random
import re

import numpy as np
import pyarrow as pa

from quern.llm import decontam
from quern.llm.common import Bits

from .helpers import ODD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items):
    out = []
    for i, t in texts:
        w, hit, own = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[k : k + n]:
                        hit.update(range(j, j + n))
                        own |= set() if item is None else {item}
        out.append((i, len(w), len(hit), sorted(own)))
    return sorted(out, key=str)


def found(spark, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(docs(spark, texts), bench, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in rows), key=str)


def case(seed):
    r = random.Random(seed)
    word = lambda: r.choice("the of a B c Dé9 zz".split())  # noqa: E731  few words: many windows share all their shingles
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 10, 14])))) for k in range(12)] + [(3, "again the same id of it all"), (None, "no id here at all of the"), (20, None)]
    texts = [(i, r.choice([", ", " ", "\n"]).join(word() for _ in range(r.randint(0, 60)))) for i in range(30)]
    texts += [(90 + k, f"Before: {t} after") for k, t in items if k is not None]
    return texts + [x for x in ODD if x[0] not in (7, 8)], items


def test_against_brute_force(spark):
    texts, items = case(1)
    assert found(spark, texts, items) == brute(texts, items)


def test_full_filters_give_the_same(spark, monkeypatch):
    texts, items = case(2)
    monkeypatch.setattr(decontam, "FILTER_BITS", 64)
    assert found(spark, texts, items) == brute(texts, items)


def test_shingles_are_alike_wherever_they_stand():
    of = decontam.Shingles()
    w = decontam.words_of(b"a b c d A-b c b c d")
    for k in (1, 2, 3):
        got = of(w, k).tolist()
        assert len(set(got)) == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
        assert got == decontam.Shingles()(w, k).tolist()


def test_rows_that_share_a_doc_id(spark):
    items = [(1, " ".join(f"w{i}" for i in range(12)))]
    leak = "so " + items[0][1]
    assert found(spark, [(1, leak), (1, "clean text"), (None, leak), (None, None), (2, leak), (2, leak)], items) == sorted([(1, 13, 12, [1]), (1, 2, 0, []), (None, 13, 12, [1]), (None, 0, 0, []), (2, 13, 12, [1]), (2, 13, 12, [1])], key=str)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.decontaminate(docs(spark, [(1, leak), (1, "clean text"), (None, leak), (None, None), (2, leak)]), bench).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("1", "clean text"), ("None", None)]


def test_very_long_and_empty(spark):
    items = [(1, " ".join(f"w{i}" for i in range(30)))]
    long = "x " * 50_000 + " ".join(f"w{i}" for i in range(5, 20)) + " y" * 50_000
    assert found(spark, [(1, long)], items) == [(1, 100_015, 15, [1])]
    assert found(spark, [], items) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_decontaminate_keeps_columns(spark):
    texts, items = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts)
    kept = decontam.decontaminate(df, bench)
    assert kept.schema == df.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _, n, _ in brute(texts, items) if not n)


def test_texts_that_are_looked_at_together(monkeypatch):
    """Shingles of many texts at once are those of each text by itself: none runs from one into the next."""
    r = random.Random(8)
    texts = ["", "a", "a b", *(" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(50)), "", None]
    batch, of = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), decontam.Shingles()
    every = Bits(np.full(1, 2**64 - 1, np.uint64))
    words = [decontam.words_of((x or "").encode()) for x in texts]
    want = [(t, i, x) for t, w in enumerate(words) for k in (1, 3) for i, x in enumerate(of(w, k).tolist())]
    for together in (1, 40, 1 << 14):
        monkeypatch.setattr(decontam, "TOGETHER", together)
        got, base = [], 0
        for some, text, at, found in decontam.shingles_met(batch, of, every, [1, 3]):
            assert some == words[base : base + len(some)]
            got += zip((text + base).tolist(), at.tolist(), found.tolist(), strict=True)
            base += len(some)
        assert base == len(texts) and sorted(got) == sorted(want)
    assert [x[0].tolist() for x in [y[1:] for y in decontam.shingles_met(batch, of, every, [])]] == [[]]
