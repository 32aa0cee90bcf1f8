import hashlib
import io
import random
import time

import pytest

from quern.llm import warc


def archive(n, gz):
    pages = [(i, f"<p>{i}</p>" * (20 + i)) for i in range(n)]
    out = []
    for i, html in pages:
        p = html.encode()
        r = warc.record(i, f"http://x/{i}", p, hashlib.sha1(p).hexdigest(), len(p), None)
        out.append(warc.member(r) if gz else r)
    return out


def test_salvage():
    for gz in (True, False):
        parts = archive(20, gz)
        starts = [sum(map(len, parts[:i])) for i in range(21)]
        whole = b"".join(parts)
        for seed in range(30):
            r = random.Random(seed)
            bad = r.randrange(20)
            data = bytearray(whole)
            lo, hi = starts[bad], starts[bad + 1]
            kind = seed % 4
            if kind == 0:  # a byte of what has a check changes
                data[r.randrange(hi - 40, hi - 12)] ^= 0x55
            elif kind == 1:  # bytes are lost
                del data[lo + 20 : hi - 10]
            elif kind == 2:  # rubbish between records, with a false start in it
                data[hi:hi] = b"\x1f\x8b\x08 WARC/1.1 rubbish"
            else:  # the end is cut off
                del data[hi - 3 :]
            gaps = []
            ids = [x.page_id for x in warc.read(bytes(data), gaps)]
            want = list(range(bad + 1)) if kind == 3 else list(range(20))
            if kind != 2:
                want.remove(bad)
            assert ids in (want, list(range(20))), (gz, seed)
            assert ids == list(range(20)) or gaps
            assert all(a < b for a, b, _ in gaps)
    assert list(warc.read(b"")) == []
    gaps = []
    assert list(warc.read(b"no archive at all", gaps)) == [] and gaps[0][:2] == (0, 17)


def test_table(spark):
    big = "z" * 1500
    pages = [(1, "u", big), (2, "u", big), (3, None, big), (4, "a\r\nb", "é" * 10), (5, "u", None), (6, "u", ""), (7, "u", "é" * 10), (None, "u", big), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (9, "u", "y" * 1000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(df).collect()), key=str)
    want = []
    for i, _, html in pages:
        p = (html or "").encode()
        same = [j for j, _, h in pages if h == html and j is not None] if len(p) >= 1000 else []
        refers = max(same) if len(same) > 0 and i != max(same) else None
        want.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_a_member_with_a_bad_record_keeps_the_others():
    one, bad, two = (x for x in archive(3, gz=False))
    bad = bad.replace(b"<p>1</p>", b"<p>x</p>", 1)
    gaps = []
    assert [r.page_id for r in warc.read(warc.member(one + bad + two), gaps)] == [0, 2]
    assert len(gaps) == 1 and "block digest" in gaps[0][2]


def test_records_larger_than_a_block(monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 256)
    for gz in (True, False):
        data = b"".join(archive(40, gz)) + b"rubbish" * 100
        gaps = []
        assert [r.page_id for r in warc.read(data, gaps)] == list(range(40))
        assert gaps == [(len(data) - 700, len(data), "no version line")]


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


@pytest.mark.parametrize("gz", [True, False])
def test_reading_is_linear(gz):
    """Bytes that are read from a file are in proportion to it, with false starts in it, too."""
    one = b"".join(archive(30, gz)) + b"\x1f\x8b\x08 false WARC/1. starts"
    for copies in (50, 400):
        data = one * copies
        file = Counted(data)
        began = time.process_time()
        assert sum(1 for _ in warc.read(warc.Source(file, len(data)))) == 30 * copies
        assert file.got < 3 * len(data) + 4 * warc.BLOCK_BYTES
        assert time.process_time() - began < 20


def test_damaged_archives_are_noticed(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 300) for i in range(50)], "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(df, warc.new_path(spark, "warc"))
    assert warc.read_back(manifest).filter("kind = 'record'").count() == 50
    path = manifest.first()["uri"].removeprefix("file:").replace("//", "/")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0x55
    open(path, "wb").write(data)
    found = warc.read_archives(manifest)
    assert found.filter("kind = 'quarantined'").count() == 1 and found.filter("kind = 'record'").count() == 49
    with pytest.raises(warc.Incomplete):
        warc.read_back(manifest)
