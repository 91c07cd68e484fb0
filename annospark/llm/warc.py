"""Legacy archive (ARC) to WARC conversion, writing and reading of both.

The converter reads the version block at the start of an ARC file, takes the
field names of its version from it, then parses each record's header line and
the content of the length it declares.  From that it makes an equivalent WARC
record: an identifier derived from the URL, date, digest and the record's
place, the date in WARC form, the type, and SHA-1 digests of block and payload.
Records whose payload an earlier one has become revisits, with the HTTP header
and no payload; they name the page that they revisit in a field of their own.

An archive file of about ``FILE_BYTES`` is one row of Spark's text writer, and
one file of it, so archives go to any file system that Spark writes to, with
Spark's commit protocol, and lost executors only repeat their own files.  They
are read with Spark's binary file source.  Files are compressed as a whole
(not a member a record), and what is not valid UTF-8 in a page goes through as
the bytes that it is.

Rows of :func:`archive_pages`, one out for each in: a null html is an empty
payload; a null url is ``urn:none``; spaces and control characters in urls are
percent-encoded; null page ids are kept: such records are always responses and
no other record refers to them; of rows with equal payloads and the same
smallest page id one is the response (the first by url, then place), the
others revisit that page id like any; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annospark.llm.common import Steps, remove

#: Uncompressed bytes of an archive file, or one record.
FILE_BYTES = 16 << 20
#: Header fields of the two ARC versions.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
#: Header of the made HTTP message that carries a page's id through both formats.
ID_HEADER = "X-Page-Id"
#: Field of a revisit that holds the id of the page it revisits.
PAGE_FIELD = "X-Refers-To-Page-Id"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]

    def http(self) -> tuple[bytes, bytes]:
        """The HTTP header with its empty line, and the payload; no header where there is none."""
        if not self.content.startswith(b"HTTP/"):
            return b"", self.content
        at = min((i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := self.content.find(x)) >= 0), default=len(self.content))
        return self.content[:at], self.content[at:]


def arc_version_block(name: str, version: str = "1", date: str = "19960101000000") -> bytes:
    body = f"{version} 0 annospark\n{ARC_FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("200 - - 0 {} ".format(name) if version == "2" else "")
    return f"{head}{len(body)}\n".encode() + body


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file; the version block is read, not returned.  A damaged file raises ValueError."""
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # separators between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without an end")
        head = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            length = int(head[-1])
        except ValueError:
            raise ValueError(f"no length in ARC header {head!r}") from None
        if end + 1 + length > len(data):
            raise ValueError("an ARC record is shorter than it declares")
        content = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if not names:
            if not head[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with a version block")
            lines = content.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            names = (lines[1] if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version]).split(" ")
            continue
        if len(head) != len(names):
            raise ValueError(f"an ARC header of {len(head)} fields, not {len(names)}")
        yield ArcRecord(dict(zip(names, head)), content)


def warc_date(arc_date: str) -> str:
    """14 digits (fewer: the start of that period) to WARC form."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, name: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, date, digest, name)))}>"


def to_warc(record: ArcRecord, refers_to: tuple[str, str, str, str] | None = None, place: str = "") -> bytes:
    """A WARC record without the separator after it.  refers_to: id, url, date and page id of the record it revisits; place tells records with equal fields apart."""
    head, payload = record.http()
    url, date, digest = record.url, warc_date(record.fields["Archive-date"]), sha1(payload)
    block = head if refers_to else record.content
    kind = "revisit" if refers_to else "response" if head else "resource"
    lines = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(url, date, digest, place)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    if record.fields.get("IP-address", "0.0.0.0") != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {record.fields['IP-address']}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {refers_to[0]}", f"WARC-Refers-To-Target-URI: {refers_to[1]}", f"WARC-Refers-To-Date: {refers_to[2]}", f"{PAGE_FIELD}: {refers_to[3]}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: " + ("application/http; msgtype=response" if head else record.fields.get("Content-type", "application/octet-stream")), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record without a header")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        n = int(fields["Content-Length"])
        if end + 4 + n > len(data):
            raise ValueError("a WARC record is shorter than it declares")
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line.startswith(f"{name}: "):
            return line[len(name) + 2 :]
    return None


def inflate(data: bytes) -> bytes:
    """A file's content; gzip files may have many members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def http_message(page_id, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def clean_url(url: str | None) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else "urn:none"


def _file_row(parts: list[bytes], separator: bytes) -> pa.RecordBatch:
    """One text row of bytes, valid UTF-8 or not."""
    return pa.RecordBatch.from_arrays([pa.array([separator.join(parts)], pa.binary()).view(pa.string())], ["value"])


def _write(files: DataFrame, path: str, line_sep: str) -> None:
    """One gzip file a row, compressed for speed."""
    files.write.option("lineSep", line_sep).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, version: str = "1", date: str = "20200101000000", file_bytes: int = FILE_BYTES) -> None:
    """ARC files of ``page_id, url, html``, with a version block each; every task cuts its rows into files, nothing is shuffled."""

    def run(batches):
        start = arc_version_block("pages.arc", version)
        more = " 200 - - 0 pages.arc" if version == "2" else ""
        out, size = [start], 0
        for b in batches:
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                content = http_message(page_id, html.as_py() or b"")
                out.append(f"{clean_url(url)} 0.0.0.0 {date} text/html{more} {len(content)}\n".encode() + content)
                size += len(content)
                if size >= file_bytes:
                    yield _file_row(out, b"\n")
                    out, size = [start], 0
        if len(out) > 1:
            yield _file_row(out, b"\n")

    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("html"))
    _write(rows.mapInArrow(run, "value string"), path, "\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("path", "content")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row a record of the ARC files at ``path``: file, place, page id, url, date, digest and length of the payload."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = []
                for i, r in enumerate(parse_arc(inflate(content.as_py()))):
                    head, payload = r.http()
                    rows.append((name.as_py(), i, http_field(head, ID_HEADER), r.url, warc_date(r.fields["Archive-date"]), sha1(payload), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 7, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], ["file", "at", "page", "url", "date", "digest", "size"])

    return read_files(spark, path).mapInArrow(run, "file string, at long, page string, url string, date string, digest string, size long")


def revisits(index: DataFrame, min_payload: int = 0) -> DataFrame:
    """Of records with equal payloads of at least ``min_payload`` bytes all but the first by page id: file, at and the first's page, url, date, file and place.

    The first of each digest comes from a minimum that is taken before the
    shuffle, and is joined back to narrow rows, so a payload that many pages
    have costs no task more than its share.
    """
    some = index.where(F.col("page").isNotNull() & (F.col("size") >= min_payload))
    order = F.struct(F.col("page").cast("long").alias("k"), "page", "url", "date", "file", "at")
    first = some.groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "f")
    again = some.join(first, "digest").where((F.col("file") != F.col("f.file")) | (F.col("at") != F.col("f.at")))
    return again.select("file", "at", F.col("f.page").alias("of_page"), F.col("f.url").alias("of_url"), F.col("f.date").alias("of_date"), "digest", F.col("f.file").alias("of_file"), F.col("f.at").alias("of_at"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_payload: int = 0) -> None:
    """ARC files to WARC files, file by file; revisits come from an index of all records.

    What a file needs of the index is collected by file, so it is bounded by
    the file, and meets the file's content by a join on the name.
    """
    again = revisits(arc_index(spark, arc_path), min_payload)
    by_file = again.groupBy("file").agg(F.collect_list(F.struct("at", "of_page", "of_url", "of_date", "digest", "of_file", "of_at")).alias("again"))

    def run(batches):
        for b in batches:
            for file, content, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                known = {x["at"]: (record_id(x["of_url"], x["of_date"], x["digest"], place(x["of_file"], x["of_at"])), x["of_url"], x["of_date"], x["of_page"]) for x in found.as_py() or []}
                yield _file_row([to_warc(r, known.get(i), place(file, i)) for i, r in enumerate(parse_arc(inflate(content.as_py())))], b"\r\n\r\n")

    files = read_files(spark, arc_path).withColumnRenamed("path", "file")
    joined = files.join(by_file.hint("shuffle_hash"), "file", "left").select("file", "content", "again")
    _write(joined.mapInArrow(run, "value string"), warc_path, "\r\n\r\n")


def place(file: str, at: int) -> str:
    """A record's place: the file's name and its number there."""
    return f"{file.rsplit('/', 1)[-1]} {at}"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page, record_id, record_type, refers_to_id, refers_to_page, url, date, payload_bytes, payload_digest.

    The digest of a response is computed from its payload and must be the one
    its header declares; a revisit has its payload's digest in its header and
    the size in its HTTP header.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parse_warc(inflate(content.as_py())):
                    head, payload = ArcRecord({}, block).http()
                    declared = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] != "revisit" and sha1(payload) != declared or sha1(block) != f["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"a digest of {f['WARC-Record-ID']} is wrong")
                    size = int(http_field(head, "Content-Length")) if f["WARC-Type"] == "revisit" else len(payload)
                    rows.append((http_field(head, ID_HEADER), f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Refers-To"), f.get(PAGE_FIELD), f["WARC-Target-URI"], f["WARC-Date"], size, declared))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 9, [pa.string()] * 7 + [pa.int64(), pa.string()])], names)

    names = ["page", "record_id", "record_type", "refers_to_id", "refers_to_page", "url", "date", "payload_bytes", "payload_digest"]
    return read_files(spark, path).select("content").mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names))


def archive_pages(pages: DataFrame, path: str, min_payload: int = 0, arc_version: str = "1") -> DataFrame:
    """Pages to ARC files, those converted to WARC files under ``path``, and the records read back, as :func:`read_warc` has them.

    The ARC files go when the WARC files are there.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{path}/arc", arc_version)
    with Steps(pages):
        convert(spark, f"{path}/arc", f"{path}/warc", min_payload)
    remove(spark, f"{path}/arc")
    return read_warc(spark, f"{path}/warc")
