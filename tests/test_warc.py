"""WARC records for any cut of the files, and around damage."""

import gzip
import random

import pytest

from mentionlab.sources import warc


def record(i, payload, kind="response"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://n.example/{i}\r\nWARC-Date: 2025-01-01T00:00:00Z\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def records():
    rnd = random.Random(1)
    out = []
    for i in range(60):
        body = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 5, 300, 4000])))
        if i % 7 == 0:
            body += b"\r\n\r\nWARC/1.0\r\nnot a record\r\n\r\n\x1f\x8b\x08" + body
        out.append((i, b"HTTP/1.1 200 OK\r\n\r\n" + body, "response" if i % 3 else "request"))
    return out


def got(df):
    return sorted((r.url, r.type, bytes(r.payload) if r.payload is not None else None, r.error) for r in df.collect())


WANT = sorted((f"http://n.example/{i}", k, p, None) for i, p, k in records())


@pytest.mark.parametrize("packed", [False, True])
def test_rows_do_not_depend_on_the_cut(spark, tmp_path, packed):
    each = [record(i, p, k) for i, p, k in records()]
    for name, part in (("a.warc", each[:25]), ("b.warc", each[25:])):
        (tmp_path / name).write_bytes(b"".join(map(gzip.compress, part) if packed else part))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for split in (1 << 26, 5000, 333):
        df = warc.read(spark, str(tmp_path), split)
        assert got(df) == WANT
        assert split > 1 << 20 or df.rdd.getNumPartitions() > 10
    html = {r.url: r.html for r in warc.pages(warc.read(spark, str(tmp_path))).where("url like '%/1'").collect()}
    assert len(html) == 1 and not html["http://n.example/1"].startswith("HTTP")


def test_damaged_records_are_counted_and_passed_over(spark, tmp_path):
    members = [gzip.compress(record(i, p, k)) for i, p, k in records()]
    bad = bytearray(members[10])
    bad[len(bad) // 2] ^= 0xFF
    bad[-6] ^= 0xFF
    (tmp_path / "c.warc.gz").write_bytes(b"".join(members[:10]) + bytes(bad) + b"".join(members[11:-1]) + members[-1][:-9])
    for split in (1 << 26, 700):
        rows = warc.read(spark, str(tmp_path / "c.warc.gz"), split).collect()
        assert len([r for r in rows if r.error]) == 2
        assert sorted(r.url for r in rows if not r.error) == sorted(w[0] for w in WANT if w[0] not in ("http://n.example/10", "http://n.example/59"))
    (tmp_path / "d.warc").write_bytes(record(1, b"x" * 50) + b"garbage\r\n\r\n" + record(2, b"y" * 50) + record(3, b"z" * 50)[:-20])
    rows = warc.read(spark, str(tmp_path / "d.warc")).collect()
    assert [(r.url, r.error is None) for r in rows if r.url] == [("http://n.example/1", True), ("http://n.example/2", True), ("http://n.example/3", False)]


def test_one_member_of_many_records(spark, tmp_path):
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(b"".join(record(i, p, k) for i, p, k in records())))
    assert got(warc.read(spark, str(tmp_path), 1000)) == WANT
    (tmp_path / "f").mkdir()
    assert warc.read(spark, str(tmp_path / "f")).count() == 0
