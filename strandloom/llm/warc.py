"""Legacy web archives (ARC 1 and 2) written and read by Spark, and converted to WARC.

An ARC file opens with a version block that names its version and fields; each record is a header line of 5 (version 1) or 10 (version 2) fields, whose
last is the declared length of what follows. Archives are read as lines by Spark's text source, so any path that Spark can open will do: compressed
files aren't split and are read in order by one task each; lines of plain files, which are, are first brought together by file. A reader then
follows the declared lengths, so it holds one record at a time. Where a length does not end at a record's border, the record is marked
damaged and the reader goes on at the next line that is a header (where a file is cut short, its last line counts as ended).

Conversion synthesises what ARC lacks: a record id (a UUID from file, position, address, date and digest: the same at every attempt), the date in ISO form,
the record type (`warcinfo` for the version block, `response` for a block that opens with an HTTP status line, `resource` for others such as dns),
block and payload digests. Payloads are compared by SHA-1 and length: of equal ones of at least `min_bytes` the record with the largest key (of equal
keys the largest id) stays a response, the others become `revisit` records that refer to it and hold the HTTP header only. Which digests
repeat is found on small rows, map side first, and joined by `looked_up`, so a payload that a third of all records share neither meets in a task nor
is broadcast unless it is one of a bounded number.

WARC files hold the records one after another, as one compressed stream a file (not a member for each record). They are written to a folder of the session's
shared folder or one of your own.

Defined results: a null html is an empty payload; a null url is `about:blank`; white space and control characters in a url are percent-encoded, since a header
line has none; a null page_id has no key, loses to any other, and is null again when read; repeated rows are records of their own, so one is the response
and the others revisit it; a payload may hold anything, line ends, other records' headers and nothing included; an empty table gives no archive records; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import looked_up, sliced, with_workers, written

MIN_BYTES = 1000
KEY_HEADER = "X-Row-Key"
SOFTWARE = "strandloom"
#: Fetch time of captures without one.
NO_DATE = "19700101000000"
#: The fields that the version blocks name.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisits by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_URL = re.compile(rb"[\x00-\x20\x7F]")
_ARC = {
    1: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<mime>.*?) ?(?P<length>\d+)\r?"),
    2: re.compile(rb"(?P<url>\S.*?) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<mime>.*?) (?P<code>\d{3}|-|0) (?P<sum>\S+) (?P<location>\S+) (?P<offset>\d+|-) (?P<file>\S+) (?P<length>\d+)\r?"),
}


# ---- lines of archives


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of the archives below path, those of a file together and in order within a partition."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value").cast("binary").alias("value")
    if all(f.endswith(".gz") for f in lines.inputFiles()):
        return lines.select(F.col("_metadata.file_path").alias("file"), value)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("no"), value)
    return placed.repartition("file").sortWithinPartitions("file", "block", "no").select("file", "value")


def _line_stream(batches):
    for b in batches:
        for part in sliced(b, 64):
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


class _Blocks:
    """Lines of one archive after another, from which blocks of declared length are cut."""

    def __init__(self, lines):
        self.lines, self.back = lines, None

    def line(self) -> tuple[str, bytes] | None:
        if self.back is not None:
            out, self.back = self.back, None
            return out
        return next(self.lines, None)

    def block(self, file: str, length: int) -> tuple[bytes, bool]:
        """The next `length` bytes of the file, and whether they are all there and end at a line's end."""
        parts, held = [], 0
        while held < length:
            got = self.line()
            if got is None or got[0] != file:
                self.back = got
                data = b"".join(parts)
                # The file's last line may lack its end.
                return data[:length], held == length + 1
            parts += (got[1], b"\n")
            held += len(got[1]) + 1
        data = b"".join(parts)
        return data[:length], data[length:] in (b"", b"\n", b"\r\n")


# ---- ARC


def arc_records(lines):
    """(file, no, version, header fields, block, whole) of (file, line) pairs; the version block is the record 0 of its file."""
    source, file, version, no = _Blocks(lines), None, 1, 0
    while (got := source.line()) is not None:
        if got[0] != file:
            file, version, no = got[0], 1, 0
        line = got[1]
        opens = line.startswith(b"filedesc:")
        # Anything that is no header here is an empty line, or what a wrong length left over.
        head = _ARC[2].fullmatch(line) or _ARC[1].fullmatch(line) if opens else _ARC[version].fullmatch(line)
        if head is None:
            continue
        block, whole = source.block(file, int(head["length"]))
        if opens:
            version = 2 if block[:1] == b"2" else 1
        yield file, no, version, head, block, whole
        no += 1


def arc_rows(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", fetched: str | None = None, version: int | None = None) -> DataFrame:
    """(record): the records of ARC files, a file for each partition that has rows; its version block comes first. version None: partitions take turns."""
    with_workers(pages.sparkSession)
    date = F.date_format(F.col(fetched), "yyyyMMddHHmmss") if fetched else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"), date.alias("date"))

    def run(batches):
        part = TaskContext.get().partitionId()
        v = version or 1 + part % 2
        name = f"part-{part:05d}.arc"
        opened = False
        for b in batches:
            for some in sliced(b, 64):
                out = []
                for key_, url_, body, when in zip(*[c.to_pylist() for c in some.columns]):
                    if not opened:
                        about = f"{v} 0 {SOFTWARE}\n{ARC_FIELDS[v]}\n".encode()
                        more = f" 200 - - 0 {name}" if v == 2 else ""
                        out.append(f"filedesc://{name} 0.0.0.0 {NO_DATE} text/plain{more} {len(about)}\n".encode() + about)
                        opened = True
                    body = body or b""
                    head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + (f"{KEY_HEADER}: {key_}\r\n" if key_ is not None else "") + "\r\n"
                    block = head.encode() + body
                    at = _URL.sub(lambda m: b"%%%02X" % m[0][0], (url_ or "about:blank").encode("utf-8", "surrogatepass")) or b"about:blank"
                    more = f" 200 - - 0 {name}" if v == 2 else ""
                    out.append(at + f" 0.0.0.0 {when or NO_DATE} text/html{more} {len(block)}\n".encode() + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return rows.mapInArrow(run, "record binary")


def write_records(records: DataFrame, path: str, separator: str, compression: str = "gzip") -> str:
    """records(record) as files of raw bytes, each record followed by the separator.

    Archives are compressed at zlib's quickest level: its usual one took most of the JVM's CPU time here (README).
    """
    out = records.select(F.col("record").cast("string")).write.option("lineSep", separator).option("compression", compression)
    out.option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


_CONVERTED = pa.schema([
    ("file", pa.string()), ("no", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("info_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("ip", pa.string()),
    ("content_type", pa.string()), ("key", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("whole", pa.bool_()),
    ("payload_sum", pa.string()), ("block_sum", pa.string()), ("head_sum", pa.string()),
])
_CONVERTED_DDL = "file string, no long, type string, record_id string, info_id string, date string, url string, ip string, content_type string, key string, digest string, payload_bytes long, head binary, payload binary, whole boolean, payload_sum string, block_sum string, head_sum string"


def _iso(date: str) -> str:
    """14 digits, or the first 8 to 13 of them, as a WARC date."""
    d = date + "0" * (14 - len(date))
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def _sum(digest: bytes) -> str:
    """A SHA-1 as WARC spells it."""
    return f"sha1:{base64.b32encode(digest).decode()}"


def _header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep and k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def converted(lines: DataFrame, with_payload: bool = True) -> DataFrame:
    """archive_lines() of ARC files -> the fields of their WARC records, all as if they were responses."""
    with_workers(lines.sparkSession)

    def run(batches):
        out, held, info = [], 0, {}
        for file, no, _, head, block, whole in arc_records(_line_stream(batches)):
            url, date = head["url"].decode("utf-8", "replace"), _iso(head["date"].decode())
            mime = head["mime"].decode("utf-8", "replace").strip() or "application/octet-stream"
            name = file.rsplit("/", 1)[-1]
            http, payload, kind = b"", block, "resource"
            if url.startswith("filedesc:"):
                kind, mime = "warcinfo", "application/warc-fields"
                payload = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\nisPartOf: {url[len('filedesc://'):]}\r\n".encode()
            elif block.startswith(b"HTTP/"):
                kind, mime = "response", "application/http; msgtype=response"
                m = re.search(rb"\r?\n\r?\n", block)
                cut = m.end() if m else len(block)
                http, payload = block[:cut], block[cut:]
            sum_ = hashlib.sha1(payload)
            digest = sum_.hexdigest()
            id_ = _record_id(name, no, url, date, digest)
            if kind == "warcinfo":
                info = {file: id_}
            out.append((file, no, kind, id_, info.get(file), date, url, head["ip"].decode("utf-8", "replace"), mime, _header_value(http, KEY_HEADER), digest, len(payload), http if with_payload else None, payload if with_payload else None, whole) + (
                (_sum(sum_.digest()), _sum(hashlib.sha1(http + payload).digest()), _sum(hashlib.sha1(http).digest())) if with_payload else (None, None, None)))
            held += len(block)
            if held > 1 << 22 or len(out) >= 512:
                yield pa.RecordBatch.from_pylist([dict(zip(_CONVERTED.names, r)) for r in out], schema=_CONVERTED)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_CONVERTED.names, r)) for r in out], schema=_CONVERTED)

    return lines.mapInArrow(run, _CONVERTED_DDL)


# ---- WARC


def first_copies(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(digest, payload_bytes, n, top): for each payload that n > 1 responses share, the one that stays: its number, id, address, date and key."""
    rank = F.struct(F.col("key").cast("long").alias("n"), "record_id", "url", "date", "key")
    shared = records.filter((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("digest", "payload_bytes")
    return shared.agg(F.count("*").alias("n"), F.max(rank).alias("top")).filter("n > 1")


def warc_rows(records: DataFrame, tops: DataFrame) -> DataFrame:
    """(record): converted() records as WARC records, those with a copy that stays elsewhere as revisits."""
    keys = ["digest", "payload_bytes"]
    met = looked_up(records, tops.select(*keys, "top"), keys, "left", asked_by=tops.select(*keys, F.col("n").alias("__asked")))
    again = F.coalesce((F.col("type") == "response") & F.col("top").isNotNull() & (F.col("record_id") != F.col("top.record_id")), F.lit(False))
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    made = met.select("*", again.alias("again"), block.alias("block"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.when(F.col("again"), F.concat(
        line("WARC-Refers-To", F.col("top.record_id")), line("WARC-Refers-To-Target-URI", F.col("top.url")), line("WARC-Refers-To-Date", F.col("top.date")),
        line("WARC-Refers-To-Key", F.col("top.key")), F.lit(f"WARC-Profile: {PROFILE}\r\n"),
    )).otherwise(F.lit(""))
    about = F.col("type") == "warcinfo"
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.col("type"))), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.when(~about, F.col("url"))), line("WARC-IP-Address", F.when(~about & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        line("WARC-Warcinfo-ID", F.when(~about, F.col("info_id"))), line("WARC-Truncated", F.when(~F.col("whole"), F.lit("unspecified"))), revisit,
        line("WARC-Block-Digest", F.when(F.col("again"), F.col("head_sum")).otherwise(F.col("block_sum"))), line("WARC-Payload-Digest", F.when(~about, F.col("payload_sum"))),
        line("Content-Type", F.col("content_type")), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n")),
    )
    return made.select(F.concat(head.cast("binary"), "block").alias("record"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> str:
    """The ARC files below arc_path as WARC files below warc_path."""
    tops = written(first_copies(converted(archive_lines(spark, arc_path), with_payload=False), min_bytes), "payload-tops")
    return write_records(warc_rows(converted(archive_lines(spark, arc_path)), tops), warc_path, "\r\n\r\n")


_READ = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("refers_key", pa.string()), ("key", pa.string()),
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("sound", pa.bool_()),
])
_READ_DDL = "file string, record_id string, type string, date string, url string, refers_to string, refers_key string, key string, digest string, payload_bytes long, payload binary, sound boolean"


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest and digest.startswith("sha1:") else None


def warc_records(lines):
    """(file, header fields in lower case, block, whole) of the (file, line) pairs of WARC files."""
    source = _Blocks(lines)
    while (got := source.line()) is not None:
        file, line = got
        if not line.startswith(b"WARC/"):
            continue
        fields, last = {}, None
        while (got := source.line()) is not None and got[0] == file and got[1].strip():
            if got[1][:1] in b" \t" and last:
                fields[last] += " " + got[1].strip().decode("utf-8", "replace")
                continue
            k, _, v = got[1].partition(b":")
            last = k.strip().lower().decode("utf-8", "replace")
            fields[last] = v.strip().decode("utf-8", "replace")
        if got is not None and got[0] != file:
            source.back = got
            continue
        length = fields.get("content-length", "")
        block, whole = source.block(file, int(length) if length.isdigit() else 0)
        yield file, fields, block, whole and length.isdigit()


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the WARC files below path. payload_bytes and digest are those of the full payload, for a revisit as its headers name them; a record is
    sound if its length, and the digests of its block and of a payload that is there, agree with its headers."""
    with_workers(spark)

    def run(batches):
        out, held = [], 0
        for file, fields, block, whole in warc_records(_line_stream(batches)):
            kind, payload, head = fields.get("warc-type"), block, b""
            if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
                m = re.search(rb"\r?\n\r?\n", block)
                head, payload = (block[: m.end()], block[m.end() :]) if m else (block, b"")
            named = _hex(fields.get("warc-payload-digest"))
            sound = whole and _hex(fields.get("warc-block-digest")) in (None, hashlib.sha1(block).hexdigest())
            if kind == "revisit":
                length = _header_value(head, "Content-Length")
                digest, size, payload = named, int(length) if length and length.isdigit() else None, None
            else:
                digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                sound = sound and named in (None, digest)
            out.append((file, fields.get("warc-record-id"), kind, fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-refers-to-key"), _header_value(head, KEY_HEADER), digest, size, payload if with_payload else None, sound))
            held += len(block) if with_payload else 0
            if held > 1 << 22 or len(out) >= 512:
                yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r)) for r in out], schema=_READ)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r)) for r in out], schema=_READ)

    return archive_lines(spark, path).mapInArrow(run, _READ_DDL)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: pages as ARC archives, converted, and the WARC archives read back."""
    spark = pages.sparkSession
    at = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_records(arc_rows(pages), f"{at}/arc", "\n")
    convert(spark, f"{at}/arc", f"{at}/warc")
    read = read_warc(spark, f"{at}/warc").filter(F.col("type").isin("response", "revisit"))
    id_type = pages.schema["page_id"].dataType
    bad = F.raise_error(F.concat(F.lit("unsound record "), F.col("record_id")))
    return read.select(
        F.col("key").cast(id_type).alias("page_id"), F.when(F.col("sound"), F.col("payload_bytes")).otherwise(bad.cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_key").cast(id_type).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (
  SELECT page_id, h, strlen(h) AS n, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY h) AS top
  FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND place > 1 THEN top END AS refers_to
FROM o
"""
