"""Archives written and read back, by ranges of many sizes, damaged ones included."""

import base64
import gzip
import hashlib
import json
import os
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tracewright.llm import warc

HTML = ["<p>a page</p>", None, "", "<p>a page</p>", "é" * 50_000, "\x00\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "", "<p>other</p>"]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    more = ["".join(rng.choice("abcdefgh <>") for _ in range(rng.choice([1, 40, 3000]))) for _ in range(300)]
    pages = [(100 - i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(HTML)] + [(1000 + i, None if i % 7 == 0 else f"http://h/ü/{i}", more[i % 250]) for i in range(300)]
    return [*pages, pages[0], pages[0], (7, "http://again", "<p>other</p>"), (None, "http://none", "<p>a page</p>"), (None, "http://none", "only without an id"), (None, None, "only without an id")]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, `a.b` string, payload string, key string").repartition(4)


def plain(rows, min_bytes=0):
    """(page_id, url, payload_bytes, digest, type, refers_to) of every row, in any order."""
    by, out = {}, []
    for page_id, url, html in rows:
        by.setdefault(html or "", []).append((page_id is None, page_id or 0, url is not None, url or ""))
    for html, group in by.items():
        for k, (none, page_id, known, url) in enumerate(sorted(group)):
            size, first = len(html.encode()), sorted(group)[0]
            revisit = k > 0 and size >= min_bytes
            out.append((None if none else page_id, url if known else None, size, digest(html), "revisit" if revisit else "response", None if not revisit or first[0] else first[1]))
    return sorted(out, key=str)


def found(read):
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as long)")
    out = read.filter("record_type != 'warcinfo'").select(page("record_id").alias("p"), "target_uri", "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("r")).collect()
    return sorted(map(tuple, out), key=str)


def encoded(want):
    return sorted(((r[0], warc.line(r[1]), *r[2:]) for r in want), key=str)


@pytest.mark.parametrize("min_bytes", [0, 20])
def test_round_trip_by_ranges(spark, tmp_path, rows, pages, min_bytes):
    folder = f"file://{tmp_path}/w"
    warc.archive(warc.page_records(pages, min_bytes), folder, file_bytes=20_000)
    assert sum(f.endswith(".gz") for f in os.listdir(tmp_path / "w")) > 4
    for split in (warc.SPLIT, 5000):
        read = warc.archived(spark, folder, split)
        assert found(read) == encoded(plain(rows, min_bytes))
    assert read.filter("not intact").count() == 0 and read.select("record_id").distinct().count() == read.count()
    html = {digest(h): (h or "").encode() for _, _, h in rows}
    for r in warc.with_payloads(read.filter("record_type != 'warcinfo'")).collect():
        assert bytes(r.payload) == html[r.payload_digest]


def test_query(spark, tmp_path, rows, pages):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, warc.op13_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((r[0], *r[2:]) for r in plain(rows)), key=str)


def test_members_are_plain_gzip(spark, tmp_path, pages):
    warc.archive(warc.page_records(pages), str(tmp_path / "w"))
    name = next(f for f in sorted(os.listdir(tmp_path / "w")) if f.endswith(".gz"))
    text = gzip.open(tmp_path / "w" / name).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"WARC-Record-ID") > 10


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(warc.page_records(none), str(tmp_path / "w"))
    assert warc.archived(spark, str(tmp_path / "w")).collect() == []
    os.mkdir(tmp_path / "bare")
    assert warc.archived(spark, str(tmp_path / "bare")).count() == 0


def test_what_failed_attempts_leave_is_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string")
    warc.archive(warc.page_records(pages), str(tmp_path / "w"))
    left = warc.page_record("urn:page:9:1:x", "response", None, b"left over", 9, digest("left over"), None, None)
    (tmp_path / "w" / "pages-left.warc.gz").write_bytes(left)
    assert warc.archived(spark, str(tmp_path / "w")).filter("record_type = 'response'").count() == 2
    # a second write adds its files to the list; without a list every archive counts
    warc.archive(warc.page_records(pages), str(tmp_path / "w"))
    assert warc.archived(spark, str(tmp_path / "w")).filter("record_type = 'response'").count() == 4
    os.remove(tmp_path / "w" / warc.LISTED)
    assert warc.archived(spark, str(tmp_path / "w")).filter("record_type = 'response'").count() == 5
    writer = warc.WarcWriter({"path": str(tmp_path / "w")}, False)
    writer.abort([warc.Written([("pages-left.warc.gz", 1)]), None])
    assert not (tmp_path / "w" / "pages-left.warc.gz").exists()


def ranged(path, split):
    size = os.path.getsize(path)
    return [(o, r["record_id"]) for a in range(0, size, split) for o, r in warc.records_in(warc.Bytes(fs.LocalFileSystem(), str(path), size), a, min(size, a + split))]


def test_damage_and_look_alikes(tmp_path):
    member = lambda k, payload: warc.page_record(f"urn:page:{k}:1:x", "response", "u", payload, len(payload), warc.base32_sha1(payload), None, None)
    rng = random.Random(4)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    nested = b"".join(member(100 + k, noise(80)) for k in range(3))
    magic = warc.MAGIC * 50 + noise(500) + gzip.compress(b"WARC/1.0 but no header") + gzip.compress(b"text")
    parts = [member(1, b"one"), member(2, nested), member(3, magic), member(4, noise(5000)), member(5, b""), member(6, noise(900))]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    whole = ranged(path, 1 << 20)
    assert [r for _, r in whole] == [f"urn:page:{k}:1:x" for k in range(1, 7)]
    for split in (1500, 2600, 4001):
        assert ranged(path, split) == whole
    # one member damaged: the others are found all the same, whole or by ranges
    hurt = bytearray(parts[3])
    hurt[len(hurt) // 2] ^= 255
    path.write_bytes(b"".join([*parts[:3], bytes(hurt), *parts[4:]]))
    for split in (1 << 20, 2600):
        assert [r for _, r in ranged(path, split)] == [f"urn:page:{k}:1:x" for k in (1, 2, 3, 5, 6)]
    # a file cut short keeps its whole members, and what is no archive has none
    path.write_bytes(b"".join(parts)[:-5])
    assert [r for _, r in ranged(path, 1 << 20)] == [f"urn:page:{k}:1:x" for k in range(1, 6)]
    path.write_bytes(noise(3000) + warc.MAGIC)
    assert ranged(path, 700) == []


def test_foreign_records(tmp_path):
    """Other kinds of record, no payload digest, and a digest that does not fit."""
    other = warc.record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:m>"), ("Content-Type", "text/plain")], b"k: v")
    wrong = warc.page_record("urn:w", "response", "u", b"abc", 3, "A" * 32, None, None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(other + wrong)
    made = [r for _, r in warc.records_in(warc.Bytes(fs.LocalFileSystem(), str(path), os.path.getsize(path)), 0, 1 << 20)]
    assert [(r["record_type"], r["payload"], r["intact"]) for r in made] == [("metadata", b"k: v", True), ("response", b"abc", False)]


def test_small_files_share_a_task(tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"x" * 100)
    parts = warc.WarcReader({"path": str(tmp_path), "splitbytes": "250"}).partitions()
    assert [len(p.parts) for p in parts] == [2] * 5
    (tmp_path / warc.LISTED).write_text(json.dumps([["3.warc.gz", 100]]))
    assert [p.parts for p in warc.WarcReader({"path": str(tmp_path)}).partitions()] == [[(f"{tmp_path}/3.warc.gz", 0, 100, 100)]]
