import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import linededup

from .helpers import ODD, docs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(1, 3))
def test_edit_distance(a, b, radius):
    assert linededup.within(a, b, radius) == (edits(a, b) <= radius)


def changed(r, line, n):
    for _ in range(n):
        i, kind = r.randrange(len(line)), r.choice("sid")
        line = line[:i] + (r.choice("xyzé") if kind != "d" else "") + line[i + (kind != "i") :]
    return line


def test_pairs_within_the_radius_share_a_key():
    r = random.Random(10)
    for radius in (1, 2, 3):
        for _ in range(200):
            a = "".join(r.choice("abcd") for _ in range(r.randint(8, 30)))
            b = changed(r, a, r.randint(1, radius))
            if a == b:
                continue
            keys, own = linededup.segment_keys([a, b], radius)
            groups = {}
            for k, o in zip(keys.tolist(), own.tolist(), strict=True):
                groups.setdefault(k >> 1, []).append((k & 1, o))
            assert any({o for _, o in g} == {0, 1} and any(not p for p, _ in g) for g in groups.values()), (a, b)


def test_other_lines_share_no_key():
    r = random.Random(19)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(500)]
    keys, own = linededup.segment_keys(lines, 2)
    assert len({k >> 1 for k in keys.tolist()}) == len(keys) and len(keys) == 12 * 500


def test_counts_of_kinds_differ_by_two_for_each_edit():
    r = random.Random(18)
    for _ in range(300):
        a = "".join(r.choice("abcdé ") for _ in range(r.randint(5, 60)))
        n = r.randint(1, 3)
        s = linededup.signatures([a, changed(r, a, n), "zz" + a])
        assert linededup.apart(s[0], s[1:2])[0] <= 2 * n and linededup.apart(s[0], s[2:3])[0] == 2


def brute(texts, least=40, radius=2):
    lines = {}
    for i, t in texts:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\v\f")
            if len(line) >= least:
                lines.setdefault(line, []).append(((i is not None, i or 0), k))
    names = list(lines)
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, x in enumerate(names):
        for y in names[:n]:
            if abs(len(x) - len(y)) <= radius and edits(x, y) <= radius:
                up[root(x)] = root(y)
    first = {}
    for x, own in lines.items():
        first[root(x)] = min(first.get(root(x), min(own)), min(own))
    gone = {}
    for x, own in lines.items():
        for at in own:
            if at != first[root(x)]:
                gone.setdefault(at[0], set()).add(at[1])
    return gone


def table(seed=11):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(38, 60))) for _ in range(30)]
    out = []
    for i in range(60):
        own = [changed(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randint(0, 4))] + ["short line"] * r.randint(0, 2)
        r.shuffle(own)
        out.append((1000 + i, "\n".join(own)))
    return [x for x in ODD if x[0] != 4] + out


def test_against_brute_force(spark):
    texts = table()
    got = linededup.removed_lines(docs(spark, texts).repartition(3)).collect()
    want = brute(texts)
    assert len(got) == len(texts)
    assert {(r["doc_id"] is not None, r["doc_id"] or 0): set(r["removed"]) for r in got if r["removed"]} == want
    assert all(r["kept_in"] for r in got if r["removed"])


def test_texts_without_lines(spark):
    texts = table(12)
    df = docs(spark, texts)
    kept = linededup.without_lines(df)
    assert [f.name for f in kept.schema] == df.columns
    gone, got = brute(texts), {r["doc_id"]: r for r in kept.collect()}
    for i, t in texts:
        key = (i is not None, i or 0)
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(key, ()))
        if key not in gone:
            assert got[i]["text"] == t
        elif not left.strip():
            assert i not in got
        else:
            assert got[i]["text"] == left and got[i]["n_chars"] == len(left)


def test_large_groups_are_cut(spark, monkeypatch):
    texts = table(22)
    monkeypatch.setattr(linededup, "LARGE", 3)
    monkeypatch.setattr(linededup, "STEP", 40)
    got = linededup.removed_lines(docs(spark, texts).repartition(3)).collect()
    assert {(r["doc_id"] is not None, r["doc_id"] or 0): set(r["removed"]) for r in got if r["removed"]} == brute(texts)


def test_lines_that_differ_by_a_counter(spark, monkeypatch):
    """Rows are in proportion to the lines, not to their pairs."""
    monkeypatch.setattr(linededup, "LARGE", 2500)
    n = 6_000
    df = spark.range(n).selectExpr("id as doc_id", "concat('this is page number ', lpad(id, 6, '0'), ' of the whole and long report') as text").repartition(4)
    members = linededup._groups(df, 40, 2).cache()
    assert members.count() < 20 * n
    texts = linededup._texts(df, members.select("hi", "lo").distinct(), 40)
    assert linededup._links(members, texts, 2).count() < 20 * n
    got = linededup.removed_lines(df).selectExpr("sum(size(removed)) as n", "max(get(kept_in, 0)) as kept").first()
    assert got["n"] == n - 1 and got["kept"] == 0


def test_forest_joins_what_is_near():
    r = random.Random(23)
    for _ in range(20):
        base = ["".join(r.choice("abc") for _ in range(12)) for _ in range(4)]
        lines = list({changed(r, r.choice(base), r.randint(0, 3)) for _ in range(30)})
        probe = np.array([r.random() < 0.3 for _ in lines])
        joined = linededup.Forest(len(lines))
        pairs = linededup.forest(lines, probe, 2)
        for i, j in pairs:
            assert edits(lines[i], lines[j]) <= 2 and not (probe[i] and probe[j]) and joined.join(i, j)
        want = linededup.Forest(len(lines))
        for i in range(len(lines)):
            for j in range(i):
                if not (probe[i] and probe[j]) and edits(lines[i], lines[j]) <= 2:
                    want.join(i, j)
        assert [joined.root(i) for i in range(len(lines))] == [want.root(i) for i in range(len(lines))]


def test_names_that_clash(spark):
    line = "this line is long enough to be compared with all others"
    names = ["_gone", "_kept", "gone", "kept", "same", "row", "line", "x.y"]
    df = spark.createDataFrame([(1, line, *range(8)), (2, f"own\n{line}", *range(8, 16))], ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in linededup.without_lines(df).collect()}
    assert linededup.without_lines(df).columns == df.columns
    assert got[2]["text"] == "own" and [got[2][c] for c in names] == list(range(8, 16)) and [got[1][c] for c in names] == list(range(8))


def test_removed_lines_are_by_row(spark):
    a, b = (f"line {x} is long enough to be compared with all of the others" for x in ("one (1)", "two (22)"))
    got = sorted((r["doc_id"], tuple(r["removed"])) for r in linededup.removed_lines(docs(spark, [(1, a), (5, a), (5, b)])).collect())
    assert got == [(1, ()), (5, ()), (5, (0,))]


def test_repeats_and_empty(spark):
    line = "this line is long enough to be compared with others"
    got = sorted(tuple(r["removed"]) for r in linededup.removed_lines(docs(spark, [(1, line), (1, line), (2, line + "!")])).collect())
    assert got == [(), (), (0,)]
    assert linededup.removed_lines(docs(spark, [])).count() == 0
    assert linededup.without_lines(docs(spark, [])).count() == 0


def test_lines_that_are_kept_stay_in_the_corpus(spark):
    shared = [f"shared line number {i} that stands in many of the documents" for i in range(20)]
    own = "this line is in the second document and, again, in the third"
    got = {r["doc_id"]: r["text"] for r in linededup.without_lines(docs(spark, [(1, "\n".join(shared)), (2, "\n".join([*shared, own])), (3, own + "\nshort"), (4, "\n".join(shared) + "\n\t")])).collect()}
    assert got[2] == own and got[3] == "short" and 4 not in got


def test_rows_that_share_a_doc_id_lose_their_own_lines_only(spark):
    a, b, c = (f"line {x} is long enough to be compared with all of the others" for x in ("one (1)", "two (22)", "three (333)"))
    texts = [(None, a), (None, f"{b}\n{a}"), (None, f"short\n{c}"), (7, f"{a}\n{c}x y z"), (7, f"own\n{b}")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in linededup.without_lines(docs(spark, texts)).collect())
    assert got == sorted([("None", a), ("None", b), ("None", f"short\n{c}"), ("7", f"{c}x y z"), ("7", "own")])
