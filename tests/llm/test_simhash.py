import random
import re

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import components

from .helpers import ODD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(codes, radius):
    up = list(range(len(codes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_fingerprints():
    for _, t in ODD:
        assert simhash.fingerprint((t or "").encode())[0] == brute_fp(t)


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64) ^ (np.arange(64, dtype=np.uint64) >> np.uint64(1))
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_index_joins_the_same_components():
    r = random.Random(7)
    for _ in range(5):
        base = [r.getrandbits(64) for _ in range(60)]
        codes = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(8)})
        a = np.array(codes, np.uint64)
        a = a[np.argsort(simhash.gray_rank(a))]
        codes = [int(x) for x in a]
        forest = simhash.Forest(len(codes))
        for i, j in simhash.links_within(a[:, None], 2):
            assert bin(codes[i] ^ codes[j]).count("1") <= 2
            forest.join(i, j)
        assert [forest.root(i) for i in range(len(codes))] == roots(codes, 2)


@pytest.mark.parametrize("held", [1 << 18, 300])
def test_links_over_partitions(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD", held)
    r = random.Random(8)
    hot = 0x1234567 << 30  # many fingerprints that share two blocks
    codes = list({hot ^ r.getrandbits(11) ^ (r.getrandbits(3) << 60) for _ in range(2500)} | {r.getrandbits(64) for _ in range(50)} | {0, 3, 12})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    fps = spark.createDataFrame([(c, c) for c in signed], "node long, fp0 long")
    nodes = fps.selectExpr("node", "node as label")
    edges = simhash.links(fps.repartition(3), 2, [(0, m) for m in simhash.blocks_of(2)])
    got = {r["node"]: r["label"] for r in components(nodes, edges).collect()}
    want = roots(codes, 2)
    least = {}
    for c, k in zip(signed, want, strict=True):
        least[k] = min(least.get(k, c), c)
    assert got == {c: least[k] for c, k in zip(signed, want, strict=True)}


def test_every_pair_within_the_radius_shares_a_block():
    r = random.Random(17)
    for radius in (1, 2, 3, 4, 6):
        masks = simhash.blocks_of(radius)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a ^ sum(1 << i for i in r.sample(range(64), radius))
            assert any(a & m == b & m for m in masks)


def test_near_duplicates(spark):
    r = random.Random(9)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(200)) for _ in range(20)]
    texts = [*ODD, *((100 + i, t) for i, t in enumerate(base)), *((200 + i, t + " end") for i, t in enumerate(base)), *((300 + i, t) for i, t in enumerate(base))]
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    want = roots([brute_fp(t) for _, t in texts], 2)
    first = {}
    for (i, _), k in zip(texts, want, strict=True):
        if i is not None:
            first[k] = min(first.get(k, i), i)
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == sorted((str(i), first.get(k)) for (i, _), k in zip(texts, want, strict=True))
    df = docs(spark, texts)
    kept = simhash.one_of_each(df)
    assert kept.schema == df.schema
    left = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(left) == len(set(left)) and {i for i in left if i >= 100} == {100 + i for i in range(20)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 260) for k in range(20)] + [(7, 7)]
    nodes = spark.createDataFrame([(i, i) for i in range(300)], "node long, label long")
    got = {r["node"]: r["label"] for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[260] == 200 and got[50] == 50


def test_similar_documents(spark):
    r = random.Random(20)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(150)] for _ in range(60)]
    texts = [(i, " ".join(w)) for i, w in enumerate(base)]

    def edited(words, n):
        words = list(words)
        for i in r.sample(range(2, len(words) - 2, 6), n):  # apart, so that each edit costs five shingles
            words[i] = word()
        return " ".join(words)

    texts += [(1000 + i, edited(w, 1)) for i, w in enumerate(base)]  # a similarity of 0.93
    texts += [(2000 + i, edited(w, 2)) for i, w in enumerate(base)]  # 0.87
    texts += [(3000 + i, edited(w, 12)) for i, w in enumerate(base)]  # 0.42
    left = {x["doc_id"] for x in simhash.one_of_each(docs(spark, texts)).collect()}
    assert set(range(60)) <= left
    assert len({i for i in left if 1000 <= i < 2000}) <= 1 and len({i for i in left if 2000 <= i < 3000}) <= 6
    assert len({i for i in left if i >= 3000}) >= 59


def test_what_goes_is_similar_to_what_stays(spark):
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    passage = [word() for _ in range(12)]
    # Fingerprints count repeats: these share one passage, repeated, and have most distinct shingles of their own.
    texts = [(i, " ".join(passage * 40 + [word() for _ in range(60)])) for i in range(30)]
    assert simhash.distance(simhash.fingerprint(texts[0][1].encode(), 5, 8) ^ simhash.fingerprint(texts[1][1].encode(), 5, 8)) <= simhash.similar_radius(8, 0.8)
    texts.append((100, texts[3][1] + " " + word()))
    assert {x["doc_id"] for x in simhash.one_of_each(docs(spark, texts)).collect()} == set(range(30))


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    r = random.Random(23)
    a, b, c = (" ".join(str(r.random()) for _ in range(50)) for _ in range(3))
    texts = [(None, a), (None, b), (None, b), (1, a), (2, c), (2, b), (3, c)]
    got = sorted((str(x["doc_id"]), x["text"]) for x in simhash.one_of_each(docs(spark, texts)).collect())
    assert got == sorted([("1", a), ("2", b), ("2", c)])


def test_recall_at_the_similarity(spark):
    """Pairs of a similarity of exactly 0.8 are found, and those just below it stay."""
    r = random.Random(24)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for i in range(500):
        words = [word() for _ in range(94 if i < 400 else 84)]  # 90 or 80 shingles, of which each edit costs five
        texts.append((i, " ".join(words)))
        for at in (20, 60):
            words[at] = word()
        texts.append((1000 + i, " ".join(words)))
    own = [set(simhash.shingles(t.encode(), 5).tolist()) for _, t in texts]
    assert all(len(own[2 * i] & own[2 * i + 1]) / len(own[2 * i] | own[2 * i + 1]) == (0.8 if i < 400 else 70 / 90) for i in range(500))
    left = {x["doc_id"] for x in simhash.one_of_each(docs(spark, texts)).collect()}
    assert set(range(500)) <= left and {1000 + i for i in range(400, 500)} <= left
    assert sum(1000 + i not in left for i in range(400)) >= 0.97 * 400


def test_plan_has_the_same_recall_at_every_size():
    for n in (0, 1000, 10**7, 10**8, 10**9, 10**12):
        words, each = simhash.plan(n, 0.8)
        agree = (1 - simhash.share_of_bits(0.8)) ** (64 / each)
        assert 1 - (1 - agree) ** (words * each) >= 0.99
    assert simhash.plan(1000, 0.8) == (8, 5) and simhash.plan(10**9, 0.8)[1] < 5


def test_clusters():
    r = random.Random(25)
    for _ in range(60):
        base = [r.sample(range(60), r.randint(1, 30)) for _ in range(4)]
        sets = [np.array(sorted(set(r.choice(base)) ^ set(r.sample(range(60), r.randint(0, 4)))), np.int64) for _ in range(30)] + [np.zeros(0, np.int64)] * 2
        got, want = simhash.Forest(len(sets)), simhash.Forest(len(sets))
        similar = lambda a, b: (not len(a) and not len(b)) or len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
        pairs = simhash.clusters(sets, 0.8)
        assert all(similar(sets[i], sets[j]) and got.join(i, j) for i, j in pairs)
        for i in range(len(sets)):
            for j in range(i):
                if similar(sets[i], sets[j]):
                    want.join(i, j)
        assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_large_groups_in_parts_and_names_that_clash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 300)
    r = random.Random(26)
    words = [str(r.random()) for _ in range(80)]
    texts = [(i, " ".join([*words, str(i)])) for i in range(40)] + [(100 + i, " ".join(str(r.random()) for _ in range(40))) for i in range(5)]
    names = ["_row", "key", "group", "sets", "node", "_group", "row", "x.y"]
    df = spark.createDataFrame([(i, t, *range(i, i + 8)) for i, t in texts], ["doc_id", "text", *names])
    got = simhash.one_of_each(df)
    assert got.schema == df.schema
    assert sorted(tuple(x)[0] for x in got.collect()) == [0, *range(100, 105)] and {tuple(x)[2:] for x in got.collect()} == {tuple(range(i, i + 8)) for i in (0, *range(100, 105))}


def test_chains_are_one_group(spark):
    r = random.Random(27)
    words = [str(r.random()) for _ in range(100)]
    texts = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(8)]  # each similar to the next one only
    assert [x["doc_id"] for x in simhash.one_of_each(docs(spark, texts)).collect()] == [0]
