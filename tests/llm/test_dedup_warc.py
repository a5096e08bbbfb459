import base64
import hashlib
import re
import time
from collections import defaultdict

from textgauge.llm import warc
from textgauge.llm.common import scratch
from textgauge.llm.exact_dedup import exact_dedup


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (4, None), (2, ""), (7, " "), (5, "a  b"), (None, "z"), (None, "a b"), (8, "x" * 100_000), (1, "x" * 100_000)] + [(100 + i, "hot") for i in range(500)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keep_id", "2 as __sha")).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (4, "http://b c", "<p>x</p>"), (2, None, None), (3, "u", ""), (5, "é", "ü" * 50_000), (4, "http://b c", "<p>x</p>"), (None, "n", "lonely")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    top = defaultdict(int)
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], i or 0)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and i != top[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None))
    assert got == sorted(want, key=repr)
    assert all(r.record_type == "response" for r in warc.round_trip(pages, min_bytes=1 << 30).collect())
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_url_comes_back(spark, tmp_path):
    url = "http://a/" + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "<p>x</p>"), (2, url, "<p>x</p>"), (3, "u", "y")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(pages).collect()) == [(1, "revisit"), (2, "response"), (3, "response")]
    warc.write_warc(pages, f"file://{tmp_path}").count()
    got = warc.read_warc(spark, f"file://{tmp_path}")
    assert {r.page_id: r.url for r in got.collect()} == {1: url, 2: url, 3: "u"}


def damaged(parts):
    bodies = [f"payload {i}".encode() * 20 for i in range(5)]
    records = [warc.record_bytes(i, "u", b, base64.b32encode(hashlib.sha1(b).digest()).decode(), None) for i, b in enumerate(bodies)]
    return [warc.member(r) if parts == "gzip" else r for r in records]


def test_salvage():
    for kind in ("gzip", "plain"):
        m = damaged(kind)
        whole = list(warc.salvage(b"".join(m)))
        assert [x[0] for x in whole] == ["record"] * 5
        broken = bytearray(m[1])
        broken[-20] ^= 0xFF  # in the payload
        data = m[0] + bytes(broken) + m[2] + b"\x1f\x8b\x08junk" + m[3] + m[4][:-7]
        got = list(warc.salvage(data))
        assert [x[3]["x-page-id"] for x in got if x[0] == "record"] == ["0", "2", "3"]
        gaps = [(x[1], x[2]) for x in got if x[0] == "gap"]
        assert gaps[0] == (len(m[0]), len(m[0]) + len(m[1])) and gaps[-1][1] == len(data) and len(gaps) == 3
    assert list(warc.salvage(b"")) == [] and [x[:3] for x in warc.salvage(b"nothing")] == [("gap", 0, 7)]


def test_reader_logs_gaps(spark, tmp_path):
    m = damaged("gzip")
    (tmp_path / "a.warc.gz").write_bytes(m[0] + b"??" + m[1])
    got = warc.read_warc(spark, f"file://{tmp_path}", with_payload=True).orderBy("start").collect()
    assert [r.kind for r in got] == ["record", "gap", "record"] and got[2].payload == "payload 1" * 20 and got[1].stop - got[1].start == 2
    assert scratch(spark, "x") != scratch(spark, "x")


def plain(kind, block, *lines):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_standard_archives():
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    sha = hashlib.sha1(body)
    b32 = base64.b32encode(sha.digest()).decode()
    kind = "Content-Type: application/http; msgtype=response"
    good = [
        plain("warcinfo", b"software: y\r\n", "Content-Type: application/warc-fields"),
        plain("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        plain("response", http, kind),  # no digest
        plain("response", http, kind, f"WARC-Payload-Digest: sha1:{b32}"),
        plain("response", http, kind, f"WARC-Payload-Digest: sha1:{sha.hexdigest()}", "WARC-Block-Digest: sha256:" + hashlib.sha256(http).hexdigest()),
        plain("response", http, kind, "WARC-Payload-Digest: md5:" + hashlib.md5(body).hexdigest()),
        plain("response", http, kind, "WARC-Payload-Digest: blake3:unknown"),
        plain("resource", body, "Content-Type: text/html", f"WARC-Payload-Digest: sha1:{b32}", "X-Folded: a\r\n\tb"),
        plain("response", http.replace(b"Server: x", b"Transfer-Encoding: chunked"), kind, "WARC-Payload-Digest: sha1:" + "A" * 32),
    ]
    bad = [
        plain("response", http, kind, "WARC-Payload-Digest: sha1:" + "A" * 32),
        plain("response", http, kind, "WARC-Block-Digest: sha1:" + "A" * 32),
    ]
    members = [warc.member(good[0] + good[1] + good[2]), *map(warc.member, good[3:])]
    for data in (b"".join(good), b"".join(members)):
        got = list(warc.salvage(data))
        assert [x[0] for x in got] == ["record"] * len(good)
        assert all(warc.payload_of(x[3], x[4]) == body for x in got[2:])
    for data in (b"".join([good[2], *bad, good[3]]), b"".join(map(warc.member, [good[2], *bad, good[3]]))):
        assert [x[0] for x in warc.salvage(data)] == ["record", "gap", "record"]
    half = warc.member(good[2] + bad[0] + good[3])  # damage between a member's records
    assert [x[0] for x in warc.salvage(half)] == ["record", "record", "gap"]


def test_reading_takes_time_in_proportion_to_the_members():
    one = warc.member(plain("resource", b"x" * 400))
    took = []
    for n in (2_000, 16_000):
        data, began = one * n, time.perf_counter()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0]  # it was quadratic: 64 times


def test_written_records_are_standard(spark):
    rows = [(1, "http://a", "x"), (1, "http://a", "x"), (2, "http://b", "x"), (2, "http://b", "x"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as response", "3 as n", "4 as bytes")
    folder = scratch(spark, "warc")
    listed = warc.write_warc(pages, folder, archive_bytes=1).collect()
    assert len(listed) == 5 and sum(r.records for r in listed) == 5
    seen = []
    for r in listed:
        with open(r.path.removeprefix("file://"), "rb") as f:
            seen += [x[3] for x in warc.salvage(f.read())]
    assert len({h["warc-record-id"] for h in seen}) == 5 and all(h["warc-date"].endswith("Z") and "content-type" in h for h in seen)
    revisits = [h for h in seen if h["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(h["warc-refers-to-target-uri"] == "http://b" and h["x-refers-to-page"] == "2" for h in revisits)
