import math
import random
import re
from collections import Counter

import numpy as np

from quern.llm import quality

from .helpers import ODD, docs


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts():
    r = random.Random(13)
    texts = [t for _, t in ODD] + ["".join(r.choice(["a", "b", " ", "  ", "\n", "\x0b", "#", "<", "é", "\x1c", "\xa0"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert quality.line_counts(t or "", (t or "").encode().split()) == brute_counts(t)


def direct(texts, order=quality.ORDER):
    """Modified Kneser-Ney by its formulas, over strings."""
    stream = lambda t: "\t" * (order - 2) + " " + " ".join(t.split()) + " "
    count = {order: Counter(s[i - order + 1 : i + 1] for s in map(stream, filter(None, texts)) for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    model = {}

    def lower(k, g):
        return model[k][0][g] if k else 1 / (len(count[1]) + 1)

    for k in range(1, order + 1):
        n = [sum(c == i for c in count[k].values()) for i in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / max(1, n[i]), 0.1), i - 0.1) for i in (1, 2, 3)]
        total, held = Counter(), Counter()
        for g, c in count[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(3, c)]
        model[k] = ({g: (c - d[min(3, c)]) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower(k - 1, g[1:]) for g, c in count[k].items()}, {h: held[h] / total[h] for h in total})

    def logp(text):
        s, out = stream(text), 0.0
        for i in range(order - 1, len(s)):
            k = order
            while k and s[i - k + 1 : i + 1] not in model[k][0]:
                if k > 1 and s[i - k + 1 : i] in model[k][1]:
                    out += math.log(model[k][1][s[i - k + 1 : i]])
                k -= 1
            out += math.log(model[k][0][s[i - k + 1 : i + 1]] if k else 1 / (len(count[1]) + 1))
        return out

    return logp


def scores(uris, lang, texts):
    return quality.Scorer(uris).texts([lang] * len(texts), [quality.split(t.encode()) for t in texts])


def test_model_is_modified_kneser_ney(spark, monkeypatch):
    r = random.Random(14)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(words[i::20]) for i in range(20)] + ["a", "", "b c", "the end"]
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in ("en", None)] + [(99, "otra lengua", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    logp, new = direct(texts), [*texts, "zebra abz é", "x" * 30, "é a é b"]
    want = [logp(t) if t else 0.0 for t in new]
    for step in (1 << 20, 7):
        monkeypatch.setattr(quality, "STEP", step)
        uris = quality.fit(df)
        for lang in ("en", ""):
            assert np.allclose(scores(uris, lang, new), want, atol=1e-3)
    scorer = quality.Scorer(uris, max_keys=5)
    assert np.allclose([scorer.texts(["en"], [quality.split(t.encode())])[0] for t in new], want, atol=1e-3)


def test_order_of_words_counts(spark):
    r = random.Random(20)
    pairs = [("ab", "cd"), ("ef", "gh"), ("ij", "kl"), ("mn", "op")]
    texts = [(i, " ".join(w for _ in range(30) for w in r.choice(pairs))) for i in range(50)]
    uris = quality.fit(docs(spark, texts))
    text = texts[0][1]
    words = text.split()
    r.shuffle(words)
    kept, shuffled = scores(uris, "en", [text, " ".join(words)])
    assert shuffled < kept - 20


def test_long_words_in_bounded_slices(spark):
    texts = [(i, " ".join(random.Random(i).choice("xyz") * 20_000 + str(j) for j in range(20))) for i in range(10)]
    got = quality.quality(docs(spark, texts)).collect()
    assert len(got) == 10 and all(x["log_perplexity"] > 0 for x in got)


def test_bands_and_edges(spark):
    r = random.Random(15)
    clean = [(1000 + i, " ".join(r.choice(["the", "cat", "sat", "on", "mats", "today", "with", "friends"]) + r.choice(["", "s", "ly"]) for _ in range(80))) for i in range(200)]
    junk = [(900 + i, " ".join("".join(chr(r.randint(33, 126)) for _ in range(9)) for _ in range(80))) for i in range(3)]
    same = [(950, "again and again " * 40)]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, [*clean, *junk, *same, *[x for x in ODD if x[0] != 4]])).collect()}
    assert all(got[i]["kept"] for i, t in clean if not got[i]["base_failed"]) and sum(got[i]["kept"] for i, _ in clean) > 150
    assert not any(got[i]["kept"] for i, _ in junk) and not any(got[i]["base_failed"] for i, _ in junk)
    assert got[950]["base_failed"] and not got[950]["kept"]
    for i, t in [x for x in ODD if x[0] != 4]:
        n = brute_counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert quality.quality(docs(spark, [])).count() == 0


def test_small_languages_have_bands_of_their_own(spark):
    r = random.Random(21)
    text = lambda ws: " ".join(r.choice(ws) for _ in range(90))
    rows = [(i, text(["uno", "dos", "tres", "cuatro", "gatos", "perros"]), "es") for i in range(12)] + [(100 + i, text(["the", "cat", "sat", "today", "mats"]), "en") for i in range(300)] + [(500, text(["sola", "lengua", "pero", "larga"]), "xx")]
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[500]["kept"] or got[500]["base_failed"]
    assert len({got[i]["low_off_log_perplexity"] for i in range(12)}) == 1
    assert got[0]["low_off_log_perplexity"] != got[100]["low_off_log_perplexity"]


def test_scores_are_the_same_however_texts_come(spark):
    """Together or one by one, in any order, with words and windows kept, partly kept or not kept."""
    r = random.Random(31)
    texts = [" ".join(r.choice(["one", "two", "ähnlich", "four", "f" * r.randint(1, 9)]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    uris = quality.fit(docs(spark, list(enumerate(texts[:30]))))
    want = [quality.Scorer(uris, max_keys=0).texts(["en"], [quality.split(t.encode())])[0] for t in texts]
    order = r.sample(range(60), 60)
    for most in (0, 20, 1_000_000):
        scorer = quality.Scorer(uris, max_keys=most)
        for _ in range(2):
            got = scorer.texts(["en"] * 60, [quality.split(texts[i].encode()) for i in order])
            assert np.allclose(got, [want[i] for i in order], atol=1e-9)
    keys = scorer.keys[np.random.default_rng(1).permutation(len(scorer.keys))]
    at, seen = scorer._find(np.concatenate([keys, keys ^ np.uint64(1)]))
    assert seen[: len(keys)].all() and (scorer.keys[at[: len(keys)]] == keys).all()
    assert (seen[len(keys) :] == np.isin(keys ^ np.uint64(1), keys)).all()
