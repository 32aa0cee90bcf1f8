"""The registered queries themselves, over tables with odd rows, against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import queries

from .helpers import ODD
from .test_bpe_tokenbin_packing import best_fit_decreasing, check_packed, whole
from .test_decontam import words
from .test_quality import brute_counts
from .test_secrets import brute as brute_secrets
from .test_simhash import brute_fp, roots

KEY = "AKIA" + "Q7" * 9
OWN = [
    (20, f'password = "hunter2222" {KEY} x 0123456789abcdef0123456789abcdef token: 9fK2mQx7Zb4Lw8RtY1vN6cJd3HsG5pAe'),
    (21, "so it is <|endoftext|> in the middle of it <|endoftext|>"),
    (22, "the same words come here again and again in this one " * 4),
    (23, "the same words come here again and again in this one " * 4 + "end"),
    (24, " ".join(f"word{i} of many" for i in range(60))),
]
EXTRA = "text_ string, kept long, _row long, `end` long, same long, gone long"
DDL = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def rows_of():
    return [(i, t) for i, t in [*ODD, *OWN] if i not in (4, None)] + [(None, "one two"), (30, "two words"), (31, "two words")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "x", 1, 2, 3, 4, 5) for i, t in rows_of()]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)] + [(None, 0, 1), (20, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "word3 of many word4 of many word5 of many word6 of"), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def run(spark, name, folder):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}


def test_op2(spark, folder):
    got = run(spark, "op2_secrets", folder)
    assert len(got) == len(rows_of())
    for i, t in rows_of():
        spans = [f"{k}:{a}:{b}" for k, a, b in brute_secrets(t or "")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        every = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert [s for s in every if not s.startswith("random")] == spans
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)
    assert got[20]["n_random"] == 0 and len(got[20]["spans"].split(",")) == 4


def test_op3(spark, folder):
    got, start = run(spark, "op3_token_binary", folder), 0
    for i, t in sorted(rows_of(), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*whole(t), 0], "<u4")
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert 50256 in whole(OWN[1][1])


def test_op4(spark, folder):
    got = run(spark, "op4_quality", folder)
    assert len(got) == len(rows_of())
    for i, t in rows_of():
        n = brute_counts(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_op6(spark, folder):
    got = run(spark, "op6_toxicity", folder)
    assert len(got) == len(rows_of())
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_op7(spark, folder):
    rows = queries.QUERIES["op7_best_fit_packing"](spark, folder).collect()
    assert check_packed(rows, rows_of(), 1024) == best_fit_decreasing([r["length"] for r in rows], 1024)


def test_op10(spark, folder):
    got, texts = run(spark, "op10_simhash", folder), rows_of()
    codes = [brute_fp(t) for _, t in texts]
    first = {}
    for (i, _), k in zip(texts, roots(codes, 2), strict=True):
        if i is not None:
            first[k] = min(first.get(k, i), i)
    for (i, _), code, k in zip(texts, codes, roots(codes, 2), strict=True):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{code:016x}", first.get(k))


def test_op1_and_op9_columns(spark, folder):
    one, nine = run(spark, "op1_decontamination", folder), run(spark, "op9_line_dedup", folder)
    assert all(one[i]["n_words"] == len(words(t)) for i, t in rows_of())
    assert {i for i, r in one.items() if r["contaminated"]} == {i for i, t in rows_of() if i == 24 or "x" in words(t)} and one[24]["n_items"] == 1
    assert one[24]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and one[6]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(nine[i]["n_lines"] == sum(bool(x.strip(" \t\r\v\f")) for x in (t or "").split("\n")) for i, t in rows_of())


def test_pipeline_with_odd_rows(spark, folder):
    """Nulls, repeated rows, ids that repeat, long texts and clashing names through all five stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = [(i, t, "en", "s", len(t or ""), "y", 6, 7, 8, 9, 10) for i, t in [(4, "one"), (4, "one"), (None, "a text of its own without an id"), (None, "another text without an id, too"), (24, "a second text with an id that is there already")]]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
    texts = lambda name: sorted((str(r["doc_id"]), r["text"] or "") for r in seen[name])
    left = texts("simhash")
    assert len(seen["toxicity"]) <= len(rows_of()) + 5
    for own in [("None", "a text of its own without an id"), ("None", "another text without an id, too"), ("24", "a second text with an id that is there already"), ("1", "")]:
        assert (own in left) == (own in texts("toxicity"))
    assert left.count(("4", "one")) <= 1 and sum(t == "two words" for _, t in left) <= 1
    assert all(r["kept"] in (1, 6) and r["same"] in (4, 9) for r in seen["decontamination"])
    assert not any((r["text"] or "").startswith("word0 of many") for r in seen["decontamination"])
    assert sum(r["piece"] == 0 for r in seen["packing"]) == len(seen["decontamination"])
