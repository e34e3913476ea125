import hashlib
import io
import zlib

import pytest

from lexiqua.llm import warc as w
from lexiqua.llm._common import new_path

SCHEMA = "page_id long, url string, html string, first int, type string"


def run(spark, rows, payload=True):
    folder = new_path(spark, "warc")
    manifest = w.write_archives(spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA).repartition(3), folder)
    return w.captures(w.read_records(manifest, folder, payload))


LONG = "é<p>same</p>\r\n\r\n" * 20
ROWS = [(5, "http://a/x?y#z", LONG), (3, "http://b/", LONG), (9, None, LONG), (1, "http://c", "short"), (2, "http://c", "short"), (4, "bad\r\nurl", None), (6, "http://d/é", ""), (7, "http://e", "x" * 99), (8, "http://e", "x" * 99), (10, "http://f", "y" * 100), (11, "http://f", "y" * 100)]


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, d in data:
        if len(d) >= 100:
            least[d] = min(i, least.get(d, i))
    return sorted((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if least.get(d, i) != i else "response", least[d] if least.get(d, i) != i else None) for i, d in data)


def test_round_trip(spark):
    got = run(spark, ROWS).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in got) == brute(ROWS)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got:
        assert bytes(r.payload) == html[r.page_id] and r.request.fields is not None and r.metadata.fields["page_id"] == str(r.page_id)
        assert int(r.response.fields["Content-Length"]) == len(html[r.page_id])
    assert {r.page_id: r.target_uri for r in got}[9] is None


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "u", LONG), (3, "u", LONG), (7, "v", LONG), (None, "w", "z" * 200), (None, "w", "z" * 200), (None, "x", LONG)]
    got = sorted((str(r.page_id), r.type, str(r.refers_to)) for r in run(spark, rows, False).collect())
    assert got == [("3", "response", "None"), ("3", "revisit", "3"), ("7", "revisit", "3"), ("None", "response", "None"), ("None", "revisit", "3"), ("None", "revisit", "None")]


def test_no_rows(spark):
    assert run(spark, []).count() == 0


def test_damage_is_an_error():
    record = w._record("response", "urn:uuid:1", [("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    read = lambda data: [r["payload"] for r in w.records_of(io.BytesIO(data), True)]
    assert read(record * 3) == [b"body"] * 3 and read(b"") == []
    plain = zlib.decompress(record, 31)
    assert read(plain * 2 + b"\r\n") == [b"body"] * 2
    for bad in (record[:-12], plain[:-3], plain[:-9], plain.replace(b"Content-Length: 23", b"Content-Length: 21"), b"what", b"what\r\n", plain.replace(b"Content-Length", b"Length")):
        with pytest.raises(ValueError):
            read(bad)


def test_real_archives_are_read():
    one = lambda head, block: f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("latin-1") + block + b"\r\n\r\n"
    data = one("WARC-Type:warcinfo\r\n", b"software: x\r\n") + one("WARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: dns:x.org\r\nContent-Type: text/dns\r\n", b"20240101\nx.org.\r\n\r\nA")
    data += one("WARC-Type: response\r\nWARC-Record-ID: <b>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http;msgtype=response\r\n", "HTTP/1.1 200 \r\nServer:  é\r\n\r\nx".encode("latin-1") + b"y" * 5_000_000)
    data += one("WARC-Type: response\r\nWARC-Record-ID: <c>\r\nContent-Type: application/http\r\n", b"no headers")
    for packed in (data, zlib.compress(data, 1, 31)):
        info, dns, big, odd = w.records_of(io.BytesIO(packed), True)
        assert info["payload"] is None and dns["payload"] == b"20240101\nx.org.\r\n\r\nA" and dns["target_uri"] == "dns:x.org"
        assert big["fields"] == [("Server", "é")] and big["payload_bytes"] == 5_000_001 and odd["payload"] == b"no headers"


def test_urls_come_back_as_they_were(spark):
    urls = ["http://x/a%0Ab", "http://x/a%0D%25", "http://x/a\r\nb%0A", "http://x/%", "\n", ""]
    got = {r.page_id: r.target_uri for r in run(spark, [(i, u, "h") for i, u in enumerate(urls)]).collect()}
    assert got == dict(enumerate(urls))


def test_a_long_payload(spark):
    rows = [(1, "http://a", "long é " * 700_000), (2, "http://b", "long é " * 700_000)]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in run(spark, rows, False).collect()) == brute(rows)
