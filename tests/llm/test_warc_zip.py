import base64
import gzip
import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import warc_zip as W

ROWS = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "own"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 100_000), (6, "u", "é" * 100_000), (None, "u", "same"), (None, "u", "nobody else"), (None, "v", "nobody else"), (2**40, "u", "same")]


def brute(rows, least=0):
    tops = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            tops[h or ""] = max(i, tops.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = tops.get(h or "")
        again = len(body) >= least and top is not None and i != top and sum((x[2] or "") == (h or "") for x in rows) > 1
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_against_brute_force(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha", F.lit(2))
    assert sorted(map(repr, map(tuple, W.round_trip(pages.repartition(3), least).collect()))) == brute(ROWS, least)


def test_payloads_and_urls_come_back(spark):
    pages = spark.createDataFrame(ROWS[:6], "page_id bigint, url string, html string")
    packages = W.write(W.assign(pages), most_bytes=50)
    assert packages.count() > 1 and packages.agg(F.sum("records")).first()[0] == 6
    got = {r.page_id: r for r in W.read(packages).collect()}
    assert bytes(got[2].payload) == b"same" and got[1].record_type == "revisit" and got[1].refers_to == 2 and bytes(got[1].payload) == b""
    assert got[2].url == "http://b%0D%0AX:%20y" and got[3].url is None and got[1].refers_to_record == got[2].record_id and bytes(got[6].payload) == ("é" * 100_000).encode()


def test_empty(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").limit(0)
    assert W.round_trip(pages).count() == 0


def package(n=3):
    raw = io.BytesIO()
    p = W.Package(raw, "p.wacz", "2031-02-03T04:05:06Z")
    for i in range(n):
        p.add({"WARC-Type": "response", "WARC-Target-URI": f"http://h/{i:02d}", "WARC-Payload-Digest": "sha1:none", "N": str(i)}, b"x" * i)
    p.close()
    return raw


def test_directory_equals_the_library(tmp_path):
    raw = package(5)
    with zipfile.ZipFile(raw) as z:
        want = [(i.filename, i.compress_type, i.file_size, i.header_offset) for i in z.infolist()]
        stored = z.read(W.ARCHIVE)
    comment = b"about PK\x05\x06 and more"  # a signature in the comment, which zipfile itself doesn't take
    raw = io.BytesIO(raw.getvalue()[:-2] + struct.pack("<H", len(comment)) + comment)
    found = W.members(raw)
    assert [(m.name, m.method, m.size, m.header_at) for m in found] == want
    raw.seek(W.data_at(raw, found[0]))
    assert raw.read(found[0].size) == stored
    assert [h["n"] for h, _ in W.records(raw)] == ["0", "1", "2", "3", "4"]


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = package(40)
    assert b"PK\x06\x06" in raw.getvalue() and b"PK\x06\x07" in raw.getvalue()
    wide = [m for m in W.members(raw) if m.name == W.ARCHIVE][0]
    assert wide.size > 100 and len(list(W.records(raw))) == 40 and wide.name == "archive/data.warc.gz"


def test_without_an_index():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(W.record_bytes({"WARC-Type": "response", "N": str(i)}, bytes([i]) * 3000) for i in range(20)))
    assert [(h["n"], b) for h, b in W.records(raw, step=100)] == [(str(i), bytes([i]) * 3000) for i in range(20)]


def test_broken_packages():
    with pytest.raises(ValueError):
        W.members(io.BytesIO(b"not a zip file at all"))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(W.ARCHIVE, gzip.compress(b"x") * 10)
    with pytest.raises(ValueError, match="compressed"):
        list(W.records(raw))


def test_an_index_without_a_last_newline():
    for n, end in ((1, b""), (3, b""), (3, b" "), (3, b"\n"), (3, b"\n ")):
        whole = package(n)
        raw = io.BytesIO()
        with zipfile.ZipFile(whole) as z, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as out:
            out.writestr(W.ARCHIVE, z.read(W.ARCHIVE))
            out.writestr(W.INDEX, z.read(W.INDEX).rstrip(b"\n") + end)
        for step in (1, 7, 1 << 20):
            assert [h["n"] for h, _ in W.records(raw, step)] == [str(i) for i in range(n)]


def http(body, *fields):
    return "\r\n".join(["HTTP/1.0 200 OK", *fields, "", ""]).encode() + body


def plain(*fields, block=b""):
    """A record as its bytes, without this module."""
    return "\r\n".join(["WARC/1.0", *fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def sha(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def foreign():
    """Records as other tools write them: other types, no headers of ours, chunks, other digests, a wrong one."""
    uri = "WARC-Target-URI: http://site.example/{}".format
    return [
        plain("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>", "Content-Type: application/warc-fields", block=b"software: other\r\n"),
        plain("WARC-Type: request", "WARC-Record-ID: <urn:uuid:1>", uri("a"), "Content-Type: application/http; msgtype=request", block=b"GET /a HTTP/1.1\r\n\r\n"),
        plain("warc-type: response", "WARC-Record-ID: <urn:uuid:2>", uri("a"), f"WARC-Payload-Digest: sha1:{sha(b'hello world')}", "Content-Type: application/http;msgtype=response", block=http(b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n", "Transfer-Encoding: chunked")),
        plain("WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", uri("b"), "Content-Type: application/http; msgtype=response", block=http(b"no digest")),
        plain("WARC-Type: resource", "WARC-Record-ID: <urn:uuid:4>", uri("c"), "WARC-Payload-Digest: sha256:00", "Content-Type: text/plain", block=b"\x00raw\r\n\r\nbytes"),
        plain("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", uri("d"), f"WARC-Payload-Digest: sha1:{sha(b'hello world')}", "WARC-Refers-To: <urn:uuid:2>", "WARC-Profile: x"),
        plain("WARC-Type: response", "WARC-Record-ID: <urn:uuid:6>", uri("e"), f"WARC-Payload-Digest: sha1:{sha(b'other')}", "Content-Type: application/http", block=http(b"wrong")),
        plain("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:7>", uri("f"), f"WARC-Payload-Digest: sha1:{sha(b'lost')}", "WARC-Refers-To: <urn:uuid:99>"),
        plain("WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:8>", uri("g"), f"WARC-Payload-Digest: sha1:{sha(b'lie')}", "WARC-Refers-To: <urn:uuid:3>"),
    ]


WANT = [
    (None, 11, sha(b"hello world"), "response", "2", True, b"hello world"), (None, 9, sha(b"no digest"), "response", "3", None, b"no digest"),
    (None, 13, sha(b"\x00raw\r\n\r\nbytes"), "resource", "4", None, b"\x00raw\r\n\r\nbytes"), (None, None, sha(b"hello world"), "revisit", "5", None, b""),
    (None, 5, sha(b"wrong"), "response", "6", False, b"wrong"), (None, None, sha(b"lost"), "revisit", "7", None, b""), (None, None, sha(b"lie"), "revisit", "8", None, b""),
]


@pytest.mark.parametrize("layout", ["gzip", "plain", "indexed", "two archives"])
def test_packages_of_others(spark, tmp_path, layout):
    own, path = foreign(), tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        if layout == "plain":
            z.writestr("archive/all.warc", b"".join(own))
        elif layout == "two archives":
            z.writestr("archive/1.warc", b"".join(own[:4]))
            z.writestr("archive/2.warc.gz", b"".join(map(gzip.compress, own[4:])))
        else:
            packed = list(map(gzip.compress, own))
            z.writestr("archive/a.warc.gz", b"".join(packed))
            if layout == "indexed":
                lines = [f'com,site)/{i} 20310203040506 {{"offset": "{sum(map(len, packed[:i]))}", "length": "{len(packed[i])}", "filename": "a.warc.gz"}}' for i in range(len(own))]
                z.writestr("indexes/index.cdx", "!meta {}\n" + "\n".join(lines))
    packages = spark.createDataFrame([(str(path),)], "path string")
    found = W.read(packages)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.record_id[10:-1], r.verified, bytes(r.payload)) for r in found.collect()]
    assert sorted(got, key=lambda r: r[4]) == WANT
    assert sorted((r.record_id[10:-1], r.claims, r.fault) for r in W.checked(found).collect()) == [("3", 1, "claim"), ("6", 1, "payload"), ("99", 1, "refers")]


def test_what_is_written_is_valid_warc(spark):
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    packages = W.write(W.assign(pages), date="2031-02-03T04:05:06Z")
    ids, refers = {}, []
    for (path,) in packages.select("path").collect():
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            raw, index = z.read(W.ARCHIVE), z.read(W.INDEX).decode().splitlines()
            assert index == sorted(index) and W.LISTING in z.namelist()
            kinds = []
            for line in index:
                key, stamp, told = line.split(" ", 2)
                told = __import__("json").loads(told)
                assert stamp == "20310203040506" and key == W.sort_key(told["url"])
                headers, block = W.parse_record(raw[int(told["offset"]) : int(told["offset"]) + int(told["length"])])
                kinds.append(headers["warc-type"])
                assert {"warc-date", "warc-record-id", "warc-target-uri", "warc-payload-digest", "content-type"} <= headers.keys()
                if headers["warc-type"] == "response":
                    ids[headers["warc-record-id"]] = headers["warc-payload-digest"]
                    assert headers["warc-payload-digest"] == "sha1:" + sha(W.payload_of(headers, block)[0])
                else:
                    refers.append((headers["warc-refers-to"], headers["warc-payload-digest"]))
            first, _ = W.parse_record(raw)
            assert first["warc-type"] == "warcinfo"
    assert refers and all(ids[r] == d for r, d in refers)


def test_a_revisit_that_lies_is_found(spark):
    pages = spark.createDataFrame(ROWS[:2], "page_id bigint, url string, html string")
    lying = W.assign(pages).withColumn("digest", F.when(F.col("page_id") == 1, F.lit("A" * 32)).otherwise(F.col("digest")))
    assert [r.fault for r in W.checked(W.read(W.write(lying), payloads=False)).collect()] == ["refers"]


def test_sort_keys():
    assert W.sort_key("HTTPS://www.Example.com:8080/A b?x=1#f") == "com,example,www:8080)/a%20b?x=1" and W.sort_key("http://h") == "h)/" and W.sort_key("urn:x-page:7") == "urn:x-page:7"
