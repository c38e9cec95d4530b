import base64
import hashlib
from collections import Counter

import pytest

from corroborate.llm import warc

PAGE = "page_id long, url string, html string"
BIG = "<p>é</p>" * 20_000
ROWS = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (2, "http://c/x y\r\nz", None), (4, "http://d/", ""), (6, "http://e/", BIG), (7, "http://f/", "once"), (8, "u", "twice"), (8, "u", "twice"), (8, "t", "twice"), (None, "http://n/", "none"), (None, "http://g/", "same")]


def brute(rows, least=0):
    out, seen = [], set()
    body = lambda h: (h or "").encode()
    for p, u, h in sorted(rows, key=lambda r: (r[1] is None, r[1] or "")):
        last = max((q for q, _, x in rows if body(x) == body(h) and q is not None), default=None)
        first = len(body(h)) < least or p == last and (p, h) not in seen
        seen.add((p, h))
        out.append((p, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "response" if first else "revisit", None if first else last))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5])
def test_read_gives_what_write_was_given(spark, least):
    pages = spark.createDataFrame([(*r, "c") for r in ROWS], PAGE + ", d string")
    archive = warc.write(spark, pages, least)
    got = warc.read(spark, archive).collect()
    assert all(r.verified for r in got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(ROWS, least)
    assert Counter((r.page_id, bytes(r.payload)) for r in got) == Counter((p, (h or "").encode()) for p, _, h in ROWS)


def test_payloads_are_stored_once_and_records_are_exact(spark):
    archive = warc.write(spark, spark.createDataFrame(ROWS, PAGE))
    assert spark.read.parquet(archive.payloads).count() == len({h or "" for _, _, h in ROWS})
    found = {bytes(r.record) for r in warc.bytes_of(warc.records(spark, archive)).collect()}
    want = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://f/\r\n"
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"once").digest()).decode() + "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 4\r\n\r\nonce\r\n\r\n"
    )
    assert want.encode() in found and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in found)


def test_a_changed_payload_is_found(spark):
    archive = warc.write(spark, spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], PAGE))
    bad = spark.read.parquet(archive.payloads).selectExpr("d", "cast('zz' as binary) as payload")
    bad.write.parquet(archive.payloads + "-bad")
    assert not any(r.verified for r in warc.read(spark, warc.Archive(archive.payloads + "-bad", archive.headers)).collect())


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark, spark.createDataFrame([], PAGE))).count() == 0


def test_record_ids_are_unique_and_urls_come_back(spark):
    rows = [*ROWS, (7, "http://f/", "other"), (9, "http://x/\x00\ta b%20\x7f", "w"), (10, "http://ü/é", "v"), (11, "", "u")]
    archive = warc.write(spark, spark.createDataFrame(rows, PAGE))
    heads = [bytes(r.header).decode() for r in warc.records(spark, archive).select("header").collect()]
    of = lambda name: [line.split(": ", 1)[1] for h in heads for line in h.split("\r\n") if line.startswith(name + ": ")]
    assert len(set(of("WARC-Record-ID"))) == len(rows) and set(of("WARC-Refers-To")) <= set(of("WARC-Record-ID"))
    assert all(" " not in u and u.isprintable() for u in of("WARC-Target-URI"))
    back = Counter((r.page_id, r.url) for r in warc.read(spark, archive).collect())
    assert back == Counter((p, "urn:page:3" if u is None else u or None) for p, u, _ in rows)


def test_a_payload_of_many_records_meets_them_in_many_tasks(spark, monkeypatch):
    from corroborate import session

    monkeypatch.setattr(session, "HOT_PARTS", 8)
    rows = [(k % 50 if k % 5 else None, "http://h/", "hot" if k % 3 else f"p{k}") for k in range(240)]
    archive = warc.write(spark, spark.createDataFrame(rows, PAGE))
    got = warc.read(spark, archive).collect()
    assert all(r.verified for r in got) and Counter((r.page_id, bytes(r.payload).decode()) for r in got) == Counter((p, h) for p, _, h in rows)
    assert spark.read.parquet(archive.payloads).count() == len({h for _, _, h in rows})
    told = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    assert told == brute(rows)
