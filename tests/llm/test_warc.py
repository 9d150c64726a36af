"""Archives: written, converted and read back; legacy files with odd headers and wrong lengths."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from strandloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    big, odd = "<p>same</p>" * 200, "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhttp://x 1.1.1.1 20200101000000 text/html 7\n" * 30
    out = [(i, f"http://h{i}.example/a b\tc", big) for i in (5, 9, 7)] + [(20, None, odd), (21, "https://é.example/", odd), (22, "dns:x", "")]
    out += [(30, "http://x/", None), (31, "http://x/", "é" * 499 + "x"), (32, "http://x/", "é" * 499 + "x"), (33, "http://x/", "é" * 500), (34, "http://x/", "é" * 500), (None, "http://n/", big), (40, "http://x/", big + "\n"), (41, "http://x/", big + "\n")]
    out += [(41, "http://x/", big + "\n"), (-3, "http://x/", "\x00\x1f😀" * 4000), (50, "", "\n\n\n"), (51, "http://x/", "HTTP/1.0 200 OK\r\n\r\nnested")]
    return out + [(100 + i, f"http://h/{i}", f"text {i} " * (1 + 40 * (i % 9))) for i in range(60)]


def expected(table):
    top = {}
    for p, _, h in table:
        body = (h or "").encode()
        top.setdefault(body, []).append(p)
    out = []
    for body, ids in top.items():
        best = max((i for i in ids if i is not None), default=None)
        turns = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        for n, p in enumerate(turns):
            again = len(body) >= 1000 and n > 0
            out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    d = spark.createDataFrame(rows(), SCHEMA).repartition(3).select("*", *[F.lit(7).alias(c) for c in ("key", "record", "payload", "date", "top", "n", "digest", "block")])
    assert sorted(map(tuple, warc.digest(d).collect()), key=repr) == expected(rows())
    assert warc.digest(d.limit(0)).isEmpty()


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc.looked_up, "__defaults__", ("inner", 2, None))
    assert sorted(map(tuple, warc.digest(spark.createDataFrame(rows(), SCHEMA)).collect()), key=repr) == expected(rows())


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_of_one_version(spark, tmp_path, version, compression):
    d = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    warc.write_records(warc.arc_rows(d, version=version), str(tmp_path / "arc"), "\n", compression)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    read = warc.read_warc(spark, str(tmp_path / "warc"), with_payload=True).collect()
    assert all(r.sound for r in read) and sorted(r.type for r in read).count("warcinfo") == 2
    bodies = sorted((r.payload for r in read if r.type == "response"))
    assert {hashlib.sha1(b).hexdigest() for b in bodies} == {r[2] for r in expected(rows())}
    ids = {r.record_id: r for r in read}
    for r in read:
        if r.type == "revisit":
            assert ids[r.refers_to].digest == r.digest and ids[r.refers_to].payload_bytes == r.payload_bytes and ids[r.refers_to].type == "response"
    assert len(ids) == len(read)


def test_legacy_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>one</p>"
    old = b"filedesc://old.arc 0.0.0.0 19961022 text/plain 76\n1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n" .replace(b" 76", b" %d" % len(b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"))
    old += b"\nhttp://a.example/with space/ 10.0.0.1 19961022103015 text/html; charset=x %d\n%s\n" % (len(body), body)
    old += b"http://short.example/ 10.0.0.2 19970101000000 text/html 10\n" + body + b"\nleft over\n"
    old += b"dns:a.example 10.0.0.3 199801010000 text/dns 11\n1.2.3.4 60 A\n"[:-2] + b"\n"
    old += b"http://empty.example/ 10.0.0.4 19980101000000 no-type 0\n\n"
    old += b"http://cut.example/ 10.0.0.5 19990101000000 text/html 999\nends too early"
    (tmp_path / "arc").mkdir()
    with gzip.open(tmp_path / "arc" / "old.arc.gz", "wb") as f:
        f.write(old)
    got = {r.url: r for r in warc.converted(warc.archive_lines(spark, str(tmp_path / "arc"))).collect()}
    a = got["http://a.example/with space/"]
    assert (a.type, a.ip, a.date, a.whole, a.payload, a.content_type) == ("response", "10.0.0.1", "1996-10-22T10:30:15Z", True, b"<p>one</p>", "application/http; msgtype=response")
    assert not got["http://short.example/"].whole and not got["http://cut.example/"].whole and got["http://cut.example/"].payload == b"ends too early\n"
    assert (got["dns:a.example"].type, got["dns:a.example"].payload, got["dns:a.example"].date) == ("resource", b"1.2.3.4 60 ", "1998-01-01T00:00:00Z")
    assert got["http://empty.example/"].payload == b"" and got["filedesc://old.arc"].type == "warcinfo" and len(got) == 6
    assert {r.info_id for r in got.values()} == {got["filedesc://old.arc"].record_id}
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    text = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz"))
    assert b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"<p>one</p>").digest()) in text and text.count(b"WARC-Truncated") == 2
    assert all(r.sound for r in warc.read_warc(spark, str(tmp_path / "warc")).collect())
