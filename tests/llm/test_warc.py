"""Archives written, parsed and resolved, against the pages."""

import gzip
import hashlib
import random
from pathlib import Path

from tracewell.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string, payload string, n int"


def pages():
    rng = random.Random(6)
    bodies = ["x" * 999, "y" * 1000, "é" * 500, "z\r\n\r\nWARC/1.1\r\n" * 100, "", "long " * 60_000]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(120)]
    rows += [(200, None, None), (201, "http://a\r\nWARC-Type: x", "w" * 2000), (None, "http://b", "w" * 2000), (None, "http://c", "v" * 1500), (None, "http://c", "v" * 1500),
             (300, "http://d", "u" * 1200), (300, "http://d", "u" * 1200), (299, "http://d", "u" * 1200)]
    return [(*r, "t", "p", 1) for r in rows]


def brute(rows):
    groups = {}
    for page_id, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for body, ids in groups.items():
        named = [i for i in ids if i is not None]
        first = max(named) if named and len(body) >= 1000 and len(ids) > 1 else None
        for i in ids:
            repeats = first is not None and i != first
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if repeats else "response", first if repeats else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "archives")
    got = W.archive_pages(frame, path)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    records = W.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    html = {f"<urn:page:{r[0]}>": (r[2] or "").encode() for r in rows if r[0] is not None}
    for r in records:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None and r.record_id in html:
            assert bytes(r.payload) == html[r.record_id] and r.digest == r.payload_digest
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*.gz"))
    assert raw.count(b"y" * 1000) == 1
    assert len(list(W.parse_records(iter([raw])))) == len(rows)


def test_small_blocks_and_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    stream = iter([(record * 3)[i : i + 7] for i in range(0, len(record) * 3, 7)])
    assert [b for _, b in W.parse_records(stream)] == [b"ab\r\nc"] * 3
    for broken in (record[:-6], b"HTTP/1.1\r\n\r\n"):
        try:
            list(W.parse_records(iter([broken])))
        except ValueError:
            continue
        raise AssertionError("accepted a broken archive")


def test_no_pages(spark):
    assert W.archive_pages(spark.createDataFrame(pages(), SCHEMA).limit(0)).count() == 0
