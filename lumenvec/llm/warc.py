"""Legacy web archives (ARC, versions 1 and 2) to WARC 1.1, and readers and writers of both.

An ARC file starts with a version block, whose body names the version and the fields of all header lines; each record
is one header line, as many bytes as the line declares, and a line feed. The converter reads records by the declared
lengths, never by searching, and synthesises what WARC wants: a record id (a UUID from archive, offset and URL), an ISO
date from the 14 (or 12) digits, the record type, the target URI, SHA-1 digests of block and payload in base 32, and
the declared type of the HTTP message. Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the
largest key is the response; the others become revisits that name its id, URI, date and key and keep their HTTP header,
whose Content-Length still tells the payload's size.

Files go through Spark's text writer, so they go to any file system that Spark knows; every record is a gzip member of its own,
as in archives of crawlers, so a reader can begin at any record's offset. Archives are read whatever they are called, plain
or compressed, in one member or many: they are inflated piece by piece, and at most one record is held besides the file's own
bytes (2 GB at most, Spark's bound for a binary value; a larger file is an error). Which record of a
group is the response is found by a partial aggregate and joined back from a written table, so a payload that a third
of all pages share is split over many tasks.

Defined results: null html is an empty payload, a null url a missing target (``-`` in ARC, none in WARC); white space
and controls in urls are percent-encoded in ARC and come back as they were; repeated rows (equal key, payload and url)
give one response and else revisits; null keys come back null and count as the smallest; empty tables give no files and
no rows; very long payloads pass whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm.common import drop_path, fresh_path, written

REVISIT_BYTES = 1000
FIELDS = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: the key of a record, and the size of the payload that a revisit leaves out.
KEY, SIZE = "X-Source-Key", "X-Payload-Bytes"
CRLF = b"\r\n"


def _arc_url(url: str | None) -> str:
    return "-" if url is None else "%2D" if url == "-" else quote(url, safe="!#$&'()*+,-./:;=?@[]^_`{|}~\"<>\\") if url else "%"


def _plain_url(field: str) -> str | None:
    return None if field == "-" else "" if field == "%" else unquote_to_bytes(field).decode("utf-8", "surrogateescape")


def _http(payload: bytes, key: int | None) -> bytes:
    return b"".join([b"HTTP/1.1 200 OK", CRLF, b"Content-Type: text/html; charset=utf-8", CRLF, b"Content-Length: %d" % len(payload), CRLF, *([f"{KEY}: {key}".encode(), CRLF] if key is not None else []), CRLF])


def _arc_blocks(version: int, date: str):
    """Rows of a task as the records of one ARC file; offsets are those of the inflated file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, name = 0, ""
        for b in batches:
            out = []
            if not name and b.num_rows:
                name = f"legacy-{uuid.uuid4().hex}.arc"
                body = f"{version} 0 lumenvec\n{' '.join(FIELDS[version])}\n".encode()
                rest = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
                out.append(f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}\n".encode() + body + b"\n")
                offset += len(out[-1])
            out = [member(x) for x in out]
            for key, url, html in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                payload = (html or "").encode()
                block = _http(payload, key) + payload
                rest = f"{len(block)}" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} {len(block)}"
                record = f"{_arc_url(url)} 0.0.0.0 {date} text/html {rest}\n".encode() + block + b"\n"
                out.append(member(record))
                offset += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> None:
    """(key, url, html) as ARC files in ``path``, one for each partition that has rows."""
    records = pages.select(F.col("key").cast("long").alias("key"), "url", "html").mapInArrow(_arc_blocks(version, date), "record binary")
    _write(records, path)


#: A gzip member without content, the line separator of files that are members throughout.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _write(records: DataFrame, path: str) -> None:
    """(record binary) as files of gzip members. The text writer puts bytes as they are, and the encoding is for its separator."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class Inflated:
    """An archive's bytes as a stream: plain, or gzip in any number of members. ``at`` is the place in the inflated file."""

    def __init__(self, content: bytes | pa.Buffer, piece: int = 1 << 18):
        self.source, self.piece, self.next, self.at = memoryview(content), piece, 0, 0
        self.packed, self.unpack = bytes(self.source[:2]) == b"\x1f\x8b", None
        self.held, self.spare = bytearray(), b""

    def _more(self) -> bool:
        """Takes in some more bytes, if there are any."""
        while True:
            raw = self.spare or bytes(self.source[self.next : self.next + self.piece])
            if not raw:
                if self.unpack is not None and not self.unpack.eof:
                    raise ValueError("the archive ends inside a gzip member")
                return False
            if not self.spare:
                self.next += len(raw)
            self.spare = b""
            if not self.packed:
                self.held += raw
                return True
            if self.unpack is None or self.unpack.eof:
                raw = raw.lstrip(b"\0") if self.unpack is not None else raw  # padding between members
                if not raw:
                    continue
                self.unpack = zlib.decompressobj(47)
            out = self.unpack.decompress(raw, self.piece * 4)
            self.spare = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                self.held += out
                return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left of them."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; nothing if it doesn't come."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(len(self.held) - len(mark) + 1, 0)
            if not self._more():
                return None
        return self.take(end + len(mark))


def parse_arc(data: bytes | pa.Buffer) -> Iterator[dict]:
    """The records of an ARC file's bytes, with header fields by name, offset and block; the version block is left out."""
    stream, names = Inflated(data), None
    while stream.peek(1):
        if stream.peek(1) == b"\n":
            stream.take(1)
            continue
        at = stream.at
        head = stream.until(b"\n")
        if head is None:
            raise ValueError(f"an ARC header line at byte {at} doesn't end")
        line = head[:-1].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ValueError(f"no length in the ARC header line at byte {at}") from None
        block = stream.take(max(length, 0))
        if length < 0 or len(block) < length:
            raise ValueError(f"the ARC record at byte {at} declares {length} bytes, beyond the file's end")
        if names is None:
            version, _, rest = block.partition(b"\n")
            names = rest.split(b"\n")[0].decode().strip().split(" ") if line[0].startswith("filedesc:") else None
            if names is None or version[:1] not in b"12" or len(names) != len(line):
                raise ValueError("not an ARC version block")
        else:
            if len(line) > len(names):  # blanks inside a URL or type: the fixed fields are counted from the end
                line = [" ".join(line[: len(line) - len(names) + 1]), *line[len(line) - len(names) + 1 :]]
            yield dict(zip(names, line, strict=True)) | {"offset": at, "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header (with its empty line) and payload of an HTTP message; all payload, if it isn't one."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (block, b"")


def _field(head: bytes, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        k, mark, v = line.partition(b":")
        if mark and k.strip().lower() == name.lower().encode():
            return v.strip().decode()
    return None


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def warc_date(digits: str) -> str:
    """ISO 8601 from an ARC date of 14 digits, or fewer: then the first month, day, hour, minute or second."""
    if not 4 <= len(digits) <= 14 or not digits.isdecimal():
        raise ValueError(f"not an ARC date: {digits!r}")
    d = digits + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _arc_rows(whole: bool):
    names = ["record_id", "key", "digest", "size", "url", "date"] + ["ip", "mime", "block"] * whole
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.string(), pa.string(), pa.binary()] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for r in parse_arc(content.as_buffer()):
                    head, payload = split_http(r["block"])
                    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}:{r['offset']}:{r['URL']}").urn
                    rows.append((rid, _number(_field(head, KEY)), hashlib.sha1(payload).hexdigest(), len(payload), _plain_url(r["URL"]), warc_date(r["Archive-date"]), *((r["IP-address"], r["Content-type"], r["block"]) if whole else ())))
                    size += len(r["block"]) if whole else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _files(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """All files of a folder (or of folders by a pattern), or those of a pattern of names; an error where there is no such
    folder, no rows where it has no file. Files whose names begin with a dot or an underscore are none, as for all of Spark's readers."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p):
        raise FileNotFoundError(path)
    reader = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    return (reader.option("pathGlobFilter", names) if names else reader).load(path).select("path", "content")


def _warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return quote(url.encode("utf-8", "surrogateescape"), safe="%!#$&'()*+,-./:;=?@[]^_`{|}~\"<>\\")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = None
    for b in batches:
        out = []
        if info is None and b.num_rows:
            info = f"<{uuid.uuid4().urn}>"
            out.append(member(_warc_record("warcinfo", [("WARC-Record-ID", info), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: lumenvec\r\nformat: WARC File Format 1.1\r\n")))
        for r in b.to_pylist():
            head, payload = split_http(r["block"])
            http = bool(head)
            fields = [("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Warcinfo-ID", info), ("WARC-IP-Address", r["ip"])]
            if r["url"] is not None:
                fields.append(("WARC-Target-URI", _uri(r["url"])))
            if r["key"] is not None:
                fields.append((KEY, str(r["key"])))
            kind, block = ("response" if http else "resource"), r["block"]
            if r["first_id"] is not None and r["first_id"] != r["record_id"]:
                kind, block = "revisit", head
                fields += [(SIZE, str(len(payload))), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{r['first_id']}>"), ("WARC-Refers-To-Date", r["first_date"])]
                if r["first_url"] is not None:
                    fields.append(("WARC-Refers-To-Target-URI", _uri(r["first_url"])))
                if r["first_key"] is not None:
                    fields.append((f"{KEY}-Referred", str(r["first_key"])))
            fields += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response" if http else r["mime"])]
            out.append(member(_warc_record(kind, fields, block)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, names: str | None = None) -> None:
    """All ARC files of a folder (or those whose names match a pattern) as WARC files in another."""
    brief = _files(spark, arc_path, names).mapInArrow(_arc_rows(False), "record_id string, key long, digest string, size long, url string, date string")
    first = brief.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("key", "record_id", "url", "date")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first.select(F.col("digest").alias("same"), *[F.col(f"first.{c}").alias(f"first_{n}") for c, n in (("key", "key"), ("record_id", "id"), ("url", "url"), ("date", "date"))]), "first_records")
    rows = _files(spark, arc_path, names).mapInArrow(_arc_rows(True), "record_id string, key long, digest string, size long, url string, date string, ip string, mime string, block binary")
    matched = rows.join(first, (rows["digest"] == first["same"]) & (rows["size"] >= REVISIT_BYTES), "left")
    records = matched.select("record_id", "key", "url", "date", "ip", "mime", "block", "first_id", "first_key", "first_url", "first_date").mapInArrow(_to_warc, "record binary")
    _write(records, warc_path)


def parse_warc(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case, and ``type``) and block of the records of a WARC file's bytes, by declared lengths."""
    stream = Inflated(data)
    while stream.peek(1):
        if stream.peek(2) == CRLF:
            stream.take(2)
            continue
        at = stream.at
        head = stream.until(b"\r\n\r\n") if stream.peek(5) == b"WARC/" else None
        if head is None:
            raise ValueError(f"no WARC record at byte {at}")
        lines = head[:-4].decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError(f"the WARC record at byte {at} declares {size} bytes, beyond the file's end")
        yield fields, block


_READ = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("refers_to_url", pa.string()), ("refers_to_date", pa.string())])


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column("content"):
            out = []
            for f, block in parse_warc(content.as_buffer()):
                if f["warc-type"] == "warcinfo":
                    continue
                head, payload = split_http(block)
                revisit = f["warc-type"] == "revisit"
                told, own = f.get("warc-payload-digest", ""), hashlib.sha1(payload).hexdigest()
                digest = base64.b32decode(told.removeprefix("sha1:").upper()).hex() if told.startswith("sha1:") else None if revisit else own
                if not revisit and own != digest:
                    raise ValueError(f"{f['warc-record-id']}: the payload doesn't have its digest")
                url = f.get("warc-target-uri")
                out.append({"record_type": f["warc-type"], "record_id": f["warc-record-id"].strip("<>"), "key": _number(f.get(KEY.lower())), "url": url, "date": f["warc-date"], "payload_digest": digest, "payload_bytes": _number(f.get(SIZE.lower()) or _field(head, "Content-Length")) if revisit else len(payload), "refers_to_id": f.get("warc-refers-to", "").strip("<>") or None, "refers_to": _number(f.get(f"{KEY}-Referred".lower())), "refers_to_url": f.get("warc-refers-to-target-uri"), "refers_to_date": f.get("warc-refers-to-date")})
            yield pa.RecordBatch.from_pylist(out, _READ)


def read_warc(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """The records of a folder's WARC files but the warcinfo ones; digests are bare hexadecimal, checked against the payload."""
    return _files(spark, path, names).mapInArrow(_read_rows, "record_type string, record_id string, key long, url string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, refers_to_url string, refers_to_date string")


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as ARC of version 1 (even pages) and 2, converted to WARC and read back."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("key"), "url", "html")
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    odd = F.coalesce(F.pmod("key", F.lit(2)) == 1, F.lit(False))
    write_arc(rows.filter(~odd), f"{arc}/version=1", 1)
    write_arc(rows.filter(odd), f"{arc}/version=2", 2)
    convert_arc(spark, f"{arc}/version=*", warc)
    drop_path(spark, arc)
    out = read_warc(spark, warc)
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB's SQL.
PAGES_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= {REVISIT_BYTES}
"""
