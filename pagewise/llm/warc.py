"""WARC archives: a writer with revisit records, and a sequential, verifying reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, delete, new_dir, octets, small

#: Payloads of fewer octets are stored each time.
LEAST_REVISIT = 1000
CHUNK = 1 << 16
#: Octets after which a writer starts a new file.
FILE_SIZE = 1 << 30
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Repeated payloads (some 100 octets each) whose responses are broadcast; more are joined by shuffle.
BROADCAST_DIGESTS = 200_000


class WarcError(ValueError):
    """An archive that doesn't hold what its records say."""


def _digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _line(value: object) -> str:
    """A header's value: what can't stand in one line is percent-encoded, by its UTF-8 octets."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member. A revisit keeps the headers of the exchange, not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_digest(digest)}"]
    lines += [f"WARC-Block-Digest: {_digest(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    http: dict[str, str] = field(default_factory=dict)


class _Members:
    """The decompressed octets of one gzip member after another, no more than asked for at a time."""

    def __init__(self, file: BinaryIO):
        self.file, self.raw, self.z, self.held = file, b"", None, bytearray()

    def begin(self) -> bool:
        """Whether there is a further member."""
        self.raw = self.raw or self.file.read(CHUNK)
        self.z, self.held = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bytes:
        """The next octets of the member; none at its end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    raise WarcError("the archive ends within a member")
            try:
                out = self.z.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"a member cannot be decompressed: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """Octets up to and with ``mark``, which ends within ``most`` of them if that is given."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if most is not None and seen > most or not (new := self.more()):
                raise WarcError("a header block has no end")
            self.held += new
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not (new := self.more()):
                raise WarcError("a record is shorter than its Content-Length")
            self.held += new
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def rest(self) -> bytes:
        while new := self.more():
            self.held += new
            if len(self.held) > 8:
                break
        return bytes(self.held)


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def records(file: BinaryIO, keep: bool = True) -> Iterator[Record]:
    """The records of an archive in order; memory holds one record's headers (of any length),
    one block of CHUNK octets, and with ``keep`` one payload.

    Blocks are framed by Content-Length, and both digests are checked as the
    octets go by; a record that is cut short, has no length, is not followed by
    two line ends or doesn't match a digest raises WarcError.
    """
    source = _Members(file)
    while source.begin():
        head = _fields(source.until(b"\r\n\r\n"))
        if not head.get("content-length", "").isdigit():
            raise WarcError("a record has no Content-Length")
        left = int(head["content-length"])
        whole, inner = hashlib.sha1(), hashlib.sha1()
        http: dict[str, str] = {}
        if "application/http" in head.get("content-type", ""):
            first = source.until(b"\r\n\r\n", left)
            whole.update(first)
            http, left = _fields(first), left - len(first)
            if left < 0:
                raise WarcError("an exchange's headers pass the end of its block")
        size, parts = left, []
        while left:
            part = source.take(min(left, CHUNK))
            whole.update(part)
            inner.update(part)
            if keep:
                parts.append(part)
            left -= len(part)
        if source.rest() != b"\r\n\r\n":
            raise WarcError("a record doesn't end in two line ends")
        revisit = head.get("warc-type") == "revisit"
        told = head.get("warc-payload-digest")
        if "warc-block-digest" in head and _hex(head["warc-block-digest"]) != whole.hexdigest():
            raise WarcError("a block doesn't match its digest")
        if told and not revisit and _hex(told) != inner.hexdigest():
            raise WarcError("a payload doesn't match its digest")
        if revisit:
            length = http.get("content-length", "")
            yield Record(head, None, int(length) if length.isdigit() else 0, _hex(told) if told else "", http)
        else:
            yield Record(head, b"".join(parts) if keep else None, size, inner.hexdigest(), http)


def _plan(pages: DataFrame, least: int) -> DataFrame:
    """``page_id``, ``url``, ``html`` as octets, with ``digest``, ``revisit`` and ``refers_to``.

    Of rows with the same payload the greatest page_id (of equal ids: by hash of
    the url) is the response. Rows equal in id, url and payload are read as one
    with a count, so which of them is first depends on nothing that a repeated
    task could change. Only digests that occur twice are looked up; these are
    broadcast while they are few, else met by shuffle, where one cut-off row
    for each lets Spark split the rows of a payload that a third of all share.
    """
    octet = pages.select("page_id", "url", octets("html").alias("html"), F.xxhash64("url").alias("u"))
    rows = octet.withColumn("digest", F.sha1("html"))
    same = ["digest", "page_id", "u"]
    each = cut(rows.where(F.octet_length("html") >= least).groupBy(*same).agg(F.count("*").alias("n")))
    best = cut(each.groupBy("digest").agg(F.max(F.struct("page_id", "u")).alias("best"), F.sum("n").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "best"))
    often = cut(each.where("n > 1").select(*(F.col(c).alias(f"o_{c}") for c in same)))
    rows = rows.withColumn("i", F.lit(0).cast("long"))
    if not often.isEmpty():
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in same))
        few = small(often, BROADCAST_DIGESTS)
        one = rows.join(few, on, "left_semi").groupBy(*same).agg(F.first("url").alias("url"), F.first("html").alias("html"), F.count("*").alias("n"))
        copies = one.select("page_id", "url", "html", "u", "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
        rows = rows.join(few, on, "left_anti").union(copies)
    met = rows.join(small(best, BROADCAST_DIGESTS), (F.col("digest") == F.col("of")) & (F.octet_length("html") >= least), "left")
    response = F.col("best.page_id").eqNullSafe(F.col("page_id")) & (F.col("best.u") == F.col("u")) & (F.col("i") == 0)
    revisit = F.col("of").isNotNull() & ~response
    return met.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("best.page_id")).alias("refers_to"))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI; Spark's names of S3 are mapped to Arrow's."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("octets", T.LongType())])


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Archives of all pages under ``folder``, and the list of them: ``path``, ``n_records``, ``octets``.

    Each task writes files of its own names and lists them; a file of a failed
    or repeated attempt is in no list. The list is kept in reliable storage.
    """

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = _file_system(folder)
        at.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = at.open_output_stream(path, compression=None)
                m = member(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"], row["revisit"])
                out.write(m)
                n, size = n + 1, size + len(m)
                if size >= FILE_SIZE:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{p.rpartition('/')[2]}", "n_records": n, "octets": s} for p, n, s in done], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("octets", pa.int64())]))

    folder = folder if "://" in folder or folder.startswith("/") else f"/{folder}"
    return cut(_plan(pages, least).mapInArrow(archive, MANIFEST))


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def read(spark: SparkSession, paths: DataFrame, keep: bool = True) -> DataFrame:
    """The records of the archives in ``path``, each file read in order by one task; see ``records``."""
    names = [f.name for f in RECORD.fields]
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                at, base = _file_system(path)
                held, size = [], 0
                with at.open_input_stream(base, compression=None) as f:
                    for r in records(f, keep):
                        h = r.headers
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        held.append(dict(zip(names, (number("x-page-id"), h.get("warc-target-uri"), r.payload, r.payload_bytes, r.payload_digest, h.get("warc-type"), number("x-refers-to-page-id")))))
                        size += len(r.payload or b"")
                        if len(held) >= 1000 or size >= 1 << 23:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return paths.select("path").mapInArrow(scan, RECORD)


def unmatched(rows: DataFrame) -> DataFrame:
    """The revisits among ``rows`` whose digest and length are not those of the response they refer to, each once."""
    of = ["payload_digest", "payload_bytes"]
    told = rows.where("record_type = 'revisit'").groupBy("refers_to", *of).count().drop("count")
    held = rows.where("record_type = 'response'").groupBy("page_id", *of).count()
    held = held.select(F.col("page_id").alias("refers_to_"), *(F.col(c).alias(f"{c}_") for c in of))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("refers_to", *of)))
    return told.join(held, on, "left_anti")


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages written as archives to the shared folder and read back, one row per page.

    Null html is an empty payload; empty and short ones are responses; a null
    page_id or url is left out of its record and read back as null, and is a
    response's name only where a payload has no other; repeated rows make one
    response and revisits. Payloads and urls may have any length. Other columns
    are not read, so their names don't matter. No pages: no archives and no
    rows. A revisit that no response matches raises WarcError. The archives are
    deleted once their rows are kept.
    """
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    made = write(pages, folder, least)
    rows = cut(read(spark, made, keep=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    if not unmatched(rows).isEmpty():
        raise WarcError("a revisit's payload is not that of its response")
    delete(spark, folder)
    return rows


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, row_number() OVER (PARTITION BY sha1(b) ORDER BY page_id DESC NULLS LAST) AS rn,
        max(page_id) OVER (PARTITION BY sha1(b)) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND rn > 1 THEN best END AS refers_to FROM d
"""
