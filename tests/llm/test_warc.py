"""Archives of pages, read back and assembled, against plain code; records of other writers."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sheetgraph.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, part string, nth int, value string, payload string"
TRAP = "a" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "WARC/1." * 30
ROWS = [(1, "http://a/ b", "x" * 200), (2, "http://b", "x" * 200), (3, None, "short"), (4, "u", "short"), (None, "n", TRAP), (5, "q", TRAP), (5, "q", TRAP), (5, "r\r\nX: y", TRAP), (6, "e", None),
        (7, "", "\r\n\r\n" * 40), (None, None, "z" * 150), (None, None, "z" * 150), (8, "é", "\x00é" * 100), (9, "long", "WARC/1.1\r\n" * 300_000), (10, "long", "WARC/1.1\r\n" * 300_000), (11, "b", "y" * 99), (12, "b", "y" * 99)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 3, "v", "x") for r in rows], SCHEMA).repartition(3)


def brief(c):
    page = lambda of: warc.field(of, "page-id").cast("bigint")
    return sorted(map(tuple, c.select(page("metadata"), "n_bytes", "digest", "kind", F.when(F.col("kind") == "revisit", page("first"))).collect()), key=str)


def test_round_trip(spark):
    left, want = {}, []
    for i, _, h in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= warc.LEAST and d in left
        want.append((i, len(b), d, "revisit" if again else "response", left.get(d) if again else None))
        left.setdefault(d, i)
    assert brief(warc.round_trip(pages(spark, ROWS))) == sorted(want, key=str)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_requests_and_urls_come_back(spark):
    recs = warc.records(spark, warc.written(pages(spark, ROWS[:10]), least=10**9), keep_payload=True)
    c = warc.assembled(recs).collect()
    assert sorted(bytes(r.payload) for r in c) == sorted((h or "").encode() for _, _, h in ROWS[:10])
    assert all(len(r.requests) == 1 == len(r.metadata) and r.requests[0].uri == r.uri for r in c)
    assert {r.uri for r in c} >= {None, "", "http://a/%20b", "r%0D%0AX:%20y"}


def test_records_of_other_writers(spark, tmp_path):
    """A request that its response names, metadata concurrent to the request only, a record without partner, members gzipped one by one."""
    def rec(kind, rid, block, *more, content="application/http"):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}", "", block, "", ""]).encode()
    recs = [rec("warcinfo", "i", "software: x", content="application/warc-fields"), rec("request", "q", "GET / HTTP/1.1\r\n\r\n"), rec("response", "r", "HTTP/1.1 200 OK\r\n\r\nhi", "WARC-Concurrent-To: <q>"),
            rec("metadata", "m", "via: z", "warc-concurrent-to: <q>", content="application/warc-fields"), rec("resource", "s", "plain", content="text/plain")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    got = {r.record_id: r for r in warc.assembled(warc.records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r>", "<s>"} and got["<r>"].n_bytes == 2 and got["<s>"].n_bytes == 5
    assert [x.record_id for x in got["<r>"].requests] == ["<q>"] and [x.record_id for x in got["<r>"].metadata] == ["<m>"] and got["<s>"].requests is None


def test_cut_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\nabc"))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.records(spark, str(tmp_path)).count()
