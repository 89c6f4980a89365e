from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracelens.llm import warc

ODD = [
    (1, "http://a/1", "same"),
    (5, "http://a/5", "same"),
    (3, "http://a/3?q=%20x y\r\nz", "same"),
    (7, None, None),
    (8, "http://b/é", ""),
    (None, "http://c", "only without id"),
    (None, "http://c", "only without id"),
    (None, "http://c", "same"),
    (9, "http://d", "twice"),
    (9, "http://d", "twice"),
    (10, "http://e", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nlong é " * 60_000),
    (11, "http://f", "single"),
]


def brute(rows):
    by = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        by[html or ""].append(((page is not None, page or 0, i), page))
    out = Counter()
    for body, pages in by.items():
        pages, data = sorted(pages), body.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, (_, page) in enumerate(pages):
            last = k == len(pages) - 1
            out[page, len(data), digest, "response" if last else "revisit", None if last else pages[-1][1]] += 1
    return out


def counted(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(*r, "x", 1, b"k") for r in ODD]
    return spark.createDataFrame(rows, "page_id long, url string, html string, row string, length int, key binary")


def test_odd_pages_equal_brute_force(spark, odd_pages):
    assert counted(warc.archive_pages(odd_pages)) == brute(ODD)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).collect() == []


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(3000)] + [(9000, "u", "hot")] * 500
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert counted(warc.archive_pages(pages)) == brute(rows)


def test_archives_round_trip(spark, odd_pages):
    index = warc.write_archives(odd_pages, archive_bytes=400)
    entries = index.collect()
    assert len(entries) == len(ODD) and len({e.archive for e in entries}) > 2
    for e in entries:  # a plain gzip reader finds the record where the index says
        with open(e.archive.removeprefix("file:"), "rb") as f:
            f.seek(e.offset)
            record = gzip.decompress(f.read(e.length))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: re") and record.endswith(b"\r\n\r\n") and f"sha1:{e.digest}".encode() in record
    for name in {e.archive for e in entries}:  # whole archives are valid too
        whole = gzip.open(name.removeprefix("file:")).read()
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = Counter((r.page_id, r.url, r.payload if r.record_type == "response" else None) for r in warc.read_records(index).collect())
    kinds = {(p, h or ""): None for p, _, h in ODD}
    assert sum(got.values()) == len(ODD) and {(p, b.decode()) for p, _, b in got if b is not None} <= set(kinds)
    assert (3, "http://a/3?q=%20x%20y%0D%0Az", None) in got


def test_selected_records_only(spark, odd_pages):
    index = warc.write_archives(odd_pages)
    one = warc.read_records(index.where("url = 'http://d'"))
    assert Counter(r.record_type for r in one.collect()) == {"response": 1, "revisit": 1}
    assert warc.read_records(index.where("false")).collect() == []
    wrong = index.where("url = 'http://f'").withColumn("digest", index["digest"].substr(2, 32))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(wrong).collect()


def test_short_payloads_are_not_revisited(odd_pages):
    kinds = {(r.page_id, r.record_type) for r in warc.read_records(warc.write_archives(odd_pages, least=5)).collect()}
    assert (1, "response") in kinds and (9, "revisit") in kinds


def test_ranges_are_read_together():
    archive = np.array(["a", "a", "a", "a", "b"], object)
    offset, length = np.array([0, 10, 200, 1210, 0]), np.array([10, 10, 10, 10, 10])
    assert warc.coalesced(archive, offset, length, gap=1000, most=300) == [(0, 3), (3, 4), (4, 5)]
    assert warc.coalesced(archive, offset, length, gap=50, most=300) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert warc.coalesced(archive[:0], offset[:0], length[:0]) == []
