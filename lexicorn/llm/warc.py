"""Operator 9: legacy archive converter, ARC (versions 1 and 2) to WARC 1.1, and back to rows.

`write_arc` renders rows as ARC records, `read_arc` parses ARC files by the header line of
the version that the last version block announced and by its declared length, `convert`
synthesises the WARC identifier, timestamp, type and digests of each record, `write_warc`
writes WARC files and `read_warc` parses them by Content-Length.

Writing and reading go through Spark's own sources (``text`` with the record separator of
the format, ``binaryFile``), so any store Spark reaches will do. A file holds what one task
wrote; readers decompress and parse it as a stream and hold one record at a time beside
the file's compressed bytes.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest
(page_id, record id) is the response and the others are revisits of it; smaller payloads
are always responses. Defined cases: null html = empty payload; null page_id is kept as
null and sorts last; null url = ``-``; repeated rows are records of their own; an empty
table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.llm.common import materialize

#: fixed values of the formats
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = ("URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
             "Filename Archive-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


# ------------------------------------------------------------------ bytes, inside tasks

class _Stream:
    """Forward reader over the decompressed bytes of one file."""

    def __init__(self, content: bytes):
        self._raw, self._at, self._buf, self._pos = memoryview(content), 0, b"", 0
        self._gzip = bytes(content[:2]) == b"\x1f\x8b"
        self._z = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self._at >= len(self._raw):
            return False
        chunk = self._raw[self._at:self._at + (1 << 20)]
        self._at += len(chunk)
        if self._gzip:
            if self._z.eof:
                self._z = zlib.decompressobj(31)
            out = self._z.decompress(chunk)
            while self._z.eof and self._z.unused_data:  # the next gzip member
                rest, self._z = self._z.unused_data, zlib.decompressobj(31)
                out += self._z.decompress(rest)
        else:
            out = bytes(chunk)
        self._buf, self._pos = self._buf[self._pos:] + out, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is consumed; None if there is none."""
        start = self._pos
        while (k := self._buf.find(mark, start)) < 0:
            start = max(0, len(self._buf) - self._pos - len(mark) + 1)
            if not self._more():
                return None
        out, self._pos = self._buf[self._pos:k], k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self._buf) - self._pos < n and self._more():
            pass
        out = self._buf[self._pos:self._pos + n]
        if len(out) < n:
            raise ValueError(f"record declares {n} bytes, {len(out)} are left")
        self._pos += n
        return out

    def skip(self, bytes_: bytes) -> None:
        """Consume any run of the given byte values."""
        while True:
            while self._pos < len(self._buf) and self._buf[self._pos] in bytes_:
                self._pos += 1
            if self._pos < len(self._buf) or not self._more():
                return


def _arc_line(version: int, url: str, date: str, kind: str, length: int, status: str) -> bytes:
    tail = [str(length)] if version == 1 else [status, "-", "-", "0", "-", str(length)]
    return " ".join([url, "0.0.0.0", date, kind, *tail]).encode() + b"\n"


def _version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 lexicorn\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    return _arc_line(version, "filedesc://pages.arc", date, "text/plain", len(body), "200") + body


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of one ARC file; a version block may come anywhere and sets the header form."""
    s, version, count = _Stream(content), 1, 0
    while True:
        s.skip(b"\r\n")
        line = s.until(b"\n")
        if line is None:
            return
        # a block that announces version 2 is itself written in version 2's form
        f = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        body = s.take(int(f[-1]))
        if f[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0])
            continue
        if len(f) < (5 if version == 1 else 10):
            raise ValueError(f"not a version {version} header line: {line[:200]!r}")
        # URLs of old archives may hold blanks: the fields are counted from the end
        tail = f[-4:] if version == 1 else f[-9:]
        yield {"number": count, "version": version, "url": " ".join(f[:len(f) - len(tail)]),
               "date": tail[1], "type": tail[2],
               "status": tail[3] if version == 2 else None, "block": body}
        count += 1


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def _page_id(http: bytes) -> int | None:
    m = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", http)
    return int(m[1]) if m else None


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of one WARC file."""
    s = _Stream(content)
    while True:
        s.skip(b"\r\n")
        head = s.until(RECORD_END)
        if head is None:
            return
        first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:200]!r}")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield h, s.take(int(h["content-length"]))


# ------------------------------------------------------------------ Spark jobs

def _chunks(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
              html: str = "html", date: str = "20200101000000", block_records: int = 64) -> None:
    """Rows as gzipped ARC files whose version blocks alternate between versions 1 and 2."""
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"),
                        F.coalesce(pages[html], F.lit("")).cast("binary").alias("payload"))
    schema = pa.schema([("value", pa.binary())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[dict]:
            n = 0
            for b in batches:
                for pid, u, payload in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["payload"]):
                    version = 1 + n // block_records % 2
                    if n % block_records == 0:
                        yield {"value": _version_block(version, date)}
                    payload = payload.as_py()
                    block = _http(pid, payload) + payload
                    where = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", u or "-")
                    yield {"value": _arc_line(version, where, date, "text/html", len(block), "200")
                           + block}
                    n += 1
        return _chunks(lines(), schema)

    (rows.mapInArrow(render, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\n").options(**GZIP).text(path))


_ARC = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                  ("date", pa.string()), ("payload_bytes", pa.int64()), ("sha256", pa.binary()),
                  ("http", pa.binary()), ("payload", pa.binary())])
_ARC_DDL = ("record_id string, page_id long, url string, date string, payload_bytes long, "
            "sha256 binary, http binary, payload binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """ARC files as rows with synthesised record identifiers (from the file's name and the
    record's number in it, so that they don't change when a task runs again)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for name, content in zip(b["path"].to_pylist(), b["content"]):
                    for r in parse_arc(content.as_py()):
                        http, payload = _split_http(r["block"])
                        d = r["date"]
                        yield {"record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{r['number']}")),
                               "page_id": _page_id(http), "url": r["url"],
                               "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                               "payload_bytes": len(payload),
                               "sha256": hashlib.sha256(payload).digest(),
                               "http": http if payloads else None,
                               "payload": payload if payloads else None}
        return _chunks(rows(), _ARC)
    return _files(spark, path).mapInArrow(parse, _ARC_DDL)


def convert(spark: SparkSession, arc_path: str, min_revisit_bytes: int = 100) -> DataFrame:
    """ARC records with their WARC type: ``record_type`` and ``refers_to_id``.

    Only payloads that occur again reach the join; the table of first records is written
    first, so the planner knows its size before it chooses between broadcast and shuffle."""
    light = (read_arc(spark, arc_path, payloads=False)
             .filter(F.col("payload_bytes") >= min_revisit_bytes)
             .select("sha256", F.struct(F.col("page_id").isNull().alias("last"), "page_id",
                                        "record_id").alias("r")))
    firsts = materialize(
        light.groupBy("sha256").agg(F.min("r").alias("r"), F.count("*").alias("n"))
        .filter("n > 1").select("sha256", F.col("r.record_id").alias("first_id")), "warc-firsts")
    long_enough = F.col("payload_bytes") >= min_revisit_bytes
    again = long_enough & (F.col("first_id") != F.col("record_id"))
    return (read_arc(spark, arc_path).join(firsts, "sha256", "left")
            .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to_id", F.when(again, F.col("first_id"))).drop("first_id"))


def write_warc(records: DataFrame, path: str) -> None:
    """Converted records as gzipped WARC files, each begun by a warcinfo record."""
    schema = pa.schema([("value", pa.binary())])
    columns = ["record_id", "url", "date", "sha256", "http", "payload", "payload_bytes",
               "record_type", "refers_to_id"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(kind: str, rid: str, date: str, content_type: str, more: str, block: bytes) -> dict:
            head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\n"
                    f"WARC-Date: {date}\r\n{more}WARC-Block-Digest: sha256:"
                    f"{_b32(hashlib.sha256(block).digest())}\r\nContent-Type: {content_type}\r\n"
                    f"Content-Length: {len(block)}\r\n\r\n")
            return {"value": head.encode("utf-8", "surrogateescape") + block}

        def lines() -> Iterator[dict]:
            begun = False
            for b in batches:
                for i in range(b.num_rows):
                    rid, url, date, sha, http, payload, size, kind, first = (b[c][i].as_py() for c in columns)
                    if not begun:
                        info = b"software: lexicorn\r\nformat: WARC File Format 1.1\r\n"
                        yield record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, "info " + rid)), date,
                                     "application/warc-fields", "", info)
                        begun = True
                    more = (f"WARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha256:{_b32(sha)}\r\n")
                    if kind == "revisit":
                        more += (f"WARC-Profile: {REVISIT_PROFILE}\r\n"
                                 f"WARC-Refers-To: <urn:uuid:{first}>\r\n")
                    yield record(kind, rid, date, "application/http; msgtype=response", more,
                                 http if kind == "revisit" else http + payload)
        return _chunks(lines(), schema)

    (records.select(*columns).mapInArrow(render, "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", RECORD_END.decode()).options(**GZIP).text(path))


_WARC = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                   ("date", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload", pa.binary())])
_WARC_DDL = ("record_id string, page_id long, url string, date string, record_type string, "
             "refers_to_id string, payload_digest string, payload_bytes long, payload binary")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Responses and revisits of the WARC files below ``path``. The payload and its length
    are null for a revisit; the digest (lower-case hex) is computed for a response, which
    must agree with its header, and taken from the header for a revisit."""

    def bare(urn: str | None) -> str | None:
        return urn.strip("<>").removeprefix("urn:uuid:") if urn else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for content in b["content"]:
                    for h, block in parse_warc(content.as_py()):
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, payload = _split_http(block)
                        code = h["warc-payload-digest"].partition(":")[2]
                        sha = base64.b32decode(code + "=" * (-len(code) % 8))
                        if kind == "response" and hashlib.sha256(payload).digest() != sha:
                            raise ValueError(f"payload digest of {h['warc-record-id']} is wrong")
                        whole = kind == "response"
                        yield {"record_id": bare(h["warc-record-id"]), "page_id": _page_id(http),
                               "url": h.get("warc-target-uri"), "date": h.get("warc-date"),
                               "record_type": kind, "refers_to_id": bare(h.get("warc-refers-to")),
                               "payload_digest": sha.hex(),
                               "payload_bytes": len(payload) if whole else None,
                               "payload": payload if whole and payloads else None}
        return _chunks(rows(), _WARC)
    return _files(spark, path).mapInArrow(parse, _WARC_DDL)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: a revisit gets the length and page id of its response."""
    light = materialize(records.drop("payload"), "warc-index")
    target = light.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("_bytes"))
    again = light.filter("record_type = 'revisit'").join(target, "refers_to_id", "left")
    first = light.filter("record_type = 'response'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (again.withColumn("payload_bytes", F.col("_bytes")).select(*columns)
            .unionByName(first.withColumn("refers_to", F.lit(None).cast("long")).select(*columns)))
