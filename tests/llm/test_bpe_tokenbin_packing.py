import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, tokenbin
from quern.llm.bpe import ChunkEncoder, encoder, token_bytes
from quern.llm.common import new_path, parts_of

from .helpers import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def whole(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'  aZé中1²_-*"), st.characters(codec="utf-8")), max_size=40))
def test_chunks_encode_as_whole_texts(text):
    assert np.frombuffer(encoder(PATH).encode_batch([text])[0], "<u4").tolist() == whole(text)
    table = token_bytes(PATH)
    assert b"".join(table[i] for i in whole(text)) == text.encode()


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>a", "end <|endoftext|>", "x<|endoftext|><|endoftext|>y <|endoftext|>", "<|endoftext| >", " <|endoftext|>\n <|endoftext|>  z"])
def test_special_tokens_are_as_the_library_has_them(text):
    texts = ["before it", text, "after it"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH).encode_batch(texts)] == [whole(t) for t in texts]
    plain = np.frombuffer(encoder(PATH, True).encode_batch([text])[0], "<u4").tolist()
    table = token_bytes(PATH)
    assert 50256 not in plain and b"".join(table[i] for i in plain) == text.encode()


def test_small_cache_is_exact():
    enc = ChunkEncoder(PATH, max_chunks=10)
    texts = [f"some words {i} and {i * 7} more, or it's less.\nLine" for i in range(50)]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == [whole(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_pack_round_trip(ids):
    ids = np.array(ids, np.uint64)
    data, words, escapes = tokenbin.pack(ids)
    n = np.full(len(words), tokenbin.BLOCK)
    if len(n):
        n[-1] = len(ids) - tokenbin.BLOCK * (len(n) - 1)
    assert (tokenbin.unpack(np.frombuffer(data, "<u8"), words, escapes, n) == ids).all() if len(ids) else data == b""


def test_pack_many_blocks():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2**b, 3000, dtype=np.uint64) for b in (1, 4, 12, 16, 30, 60, 63)])
    data, words, escapes = tokenbin.pack(ids)
    n = np.full(len(words), tokenbin.BLOCK)
    n[-1] = len(ids) - tokenbin.BLOCK * (len(n) - 1)
    assert (tokenbin.unpack(np.frombuffer(data, "<u8"), words, escapes, n) == ids).all() and escapes.sum() > 0
    dense, *_ = tokenbin.pack(np.zeros(60 * 100, np.uint64))
    assert len(dense) <= 8 * 110  # 60 ids to a word


def test_file_round_trip_and_damage(spark, tmp_path):
    rng = np.random.default_rng(2)
    own = [(i if i else None, rng.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate([5, 0, 4096, 10_000, 1])]
    w = tokenbin.Writer(f"file://{tmp_path}/a.ids", 0)
    for d, ids in own:
        w.add(d, ids)
    assert w.close()["n_ids"] == sum(len(x) for _, x in own)
    got: dict = {}
    for d, _, ids, _ in tokenbin.Reader(f"file://{tmp_path}/a.ids").documents():
        got.setdefault(d, []).append(ids)
    assert all((np.concatenate(got[d]) == ids).all() for d, ids in own)
    raw = bytearray((tmp_path / "a.ids").read_bytes())
    raw[-100] ^= 1
    (tmp_path / "b.ids").write_bytes(raw)
    with pytest.raises(ValueError):
        tokenbin.Reader(f"file://{tmp_path}/b.ids")


def test_token_binary(spark):
    rows = [(i, t) for i, t in ODD if i != 4] + [(100 + i, f"text {i} " * (i % 7)) for i in range(200)]
    got = {r["doc_id"]: tuple(r) for r in tokenbin.token_binary(docs(spark, rows), PATH).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*whole(t), 0], "<u4")
        assert got[i] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenbin.token_binary(docs(spark, []), PATH).count() == 0


def test_ties_are_ordered(spark):
    got = sorted(tuple(r)[1:3] for r in tokenbin.token_binary(docs(spark, [(4, "one"), (4, "one"), (4, "two words")]), PATH).collect())
    assert [a + n for a, n in got][:-1] == [a for a, _ in got][1:]


def check_packed(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts:
        ids, at = np.array([*whole(t), 2], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
            assert r["length"] == capacity or k == 0
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_best_fit(spark):
    texts = [(i, t) for i, t in ODD if i not in (4, None)] + [(100 + i, "w " * (i * 13 % 300)) for i in range(150)]
    rows = packing.best_fit(docs(spark, texts), PATH, capacity=256).collect()
    assert check_packed(rows, texts, 256) == best_fit_decreasing([r["length"] for r in rows], 256)
    twice = packing.best_fit(docs(spark, [(4, "one"), (4, "one"), (None, None)]), PATH).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1
    assert packing.best_fit(docs(spark, []), PATH).count() == 0


def test_supersteps_are_best_fit_decreasing():
    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 200))]
        counts = {n: lengths.count(n) for n in lengths}
        runs, n = packing.supersteps(counts, 64)
        assert n == best_fit_decreasing(lengths, 64)
        used = {}
        for length, lo, hi, first, offset in runs:
            for k in range(hi - lo):
                used.setdefault(first + k, []).append((offset, length))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == n
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 64


def test_files_are_in_the_shared_folder(spark):
    assert new_path(spark, "x").startswith("file:")


def test_common_chunks_stay_when_the_cache_is_full():
    """The first chunks aren't thrown away for rare ones, until the late ones have filled their room TURNS times."""
    enc = ChunkEncoder(PATH, max_chunks=100)
    enc.encode_batch(["so the common words stay"])
    for i in range(5):
        texts = [f"a w{i}x{j}, the common" for j in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == [whole(t) for t in texts]
    assert {"the", "common", "words"} <= set(enc.chunks) and len(enc.chunks) <= 75 and len(enc.parts) <= 50
    for i in range(100):
        texts = [f"b others{i}x{j}" for j in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == [whole(t) for t in texts]
    assert "common" not in enc.chunks and len(enc.chunks) <= 75 and len(enc.late) <= 25


def test_a_batch_has_few_lookups_and_few_calls(monkeypatch):
    """Each distinct chunk of a batch is looked up once, and new ones aren't encoded one by one."""

    class Counted(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    calls = []
    for name in ("_chunk", "whole"):
        monkeypatch.setattr(ChunkEncoder, name, lambda self, x, *more, f=getattr(ChunkEncoder, name): calls.append(x) or f(self, x, *more))
    enc = ChunkEncoder(PATH)
    enc.chunks = Counted()
    texts = [f"the words {' '.join(f'w{i}x{j}, it’s new{i}and{j}.' for j in range(100))} again and again and again" for i in range(10)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == [whole(t) for t in texts]
    assert len(calls) <= 2 * len(texts) and enc.chunks.n <= 2 * len({x for t in texts for x in t.split(" ")})


PIECES = st.one_of(st.sampled_from([" ", "  ", "\n", " \n", "\t", "\0", "a", "the", "it's", "naïve", "中文", "é", "12", "...", " ", "\x1c", "᠎", "😀", "end.\nNew", "<|endoftext|>", "<|", "\uffff"]), st.text(max_size=3))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6), st.sampled_from(["all", "library", "one by one"]), st.sampled_from([4, 800_000]))
def test_batches_encode_as_whole_texts(texts, way, max_chunks):
    enc = way_of(way, max_chunks)
    for own in (texts, texts[::-1], [" ".join(texts)]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(own)] == [whole(t) for t in own]


def way_of(way, max_chunks, made={}):  # noqa: B006
    """An encoder that takes all ways, or only those that other vocabularies leave."""
    if (way, max_chunks) not in made:
        enc = made[way, max_chunks] = ChunkEncoder(PATH, max_chunks=max_chunks)
        if way != "all":
            assert enc.bare
            enc.bare = None
        if way == "one by one":
            enc.spaced[:] = False
    return made[way, max_chunks]


def test_texts_of_a_group_and_more(monkeypatch):
    monkeypatch.setattr("quern.llm.bpe.GROUP", 50)
    texts = ["", "some words", "x " * 40 + "y", "", "a  b", "z" * 60, "the end"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(PATH).encode_batch(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("lengths", [[], [0], [9], [30], [30, 1], [1, 30], [3, None, 3, 3, 3, 3, 3], [10, 10, 10], [9, 1, 0, 5], [0, 0, 25, 0, 25]])
def test_parts_of_a_batch(lengths):
    batch = pa.RecordBatch.from_arrays([pa.array([n if n is None else "é" * (n // 2) + "x" * (n % 2) for n in lengths], pa.string())], ["text"])
    parts = list(parts_of(batch, 10))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()
    assert all(p.num_rows and sum(len((x or "").encode()) for x in p.column("text").to_pylist()[:-1]) < 10 for p in parts)
