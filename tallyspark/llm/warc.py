"""WARC 1.1 archives as a Spark data source.

Read: one partition per committed file. Filters on ``record_type``, ``target_uri``,
``refers_to`` and ``record_id`` are pushed into the scan and tested on a record's
headers; the payload of a record they reject is skipped by its length, never read or
decoded. ``payload=false`` skips all payloads.

Each record is a gzip member of its own (``compression=none`` writes plain records). The
member states its compressed length in the extra field "sl", so a reader inflates no
more than the headers of a record it skips. Plain files and other gzip files are read too.

Write: each task writes one file under a name of its own; the driver lists the files
of the tasks that Spark committed in a manifest, and readers follow the manifest, so
retried and lost tasks leave no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage

from tallyspark.llm import common

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    """Any store that Arrow knows; a bare path is a local or mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value on one line: control characters would end it."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record_bytes(row) -> bytes:
    """One record: WARC headers, an HTTP response head, and the payload (none for a revisit)."""
    body = b"" if row.record_type == "revisit" else bytes(row.payload or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:x-record:{_clean(row.record_id)}>", f"WARC-Date: {DATE}"]
    if row.target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(row.target_uri)}")
    if row.refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:x-record:{_clean(row.refers_to)}>")
    if row.record_type == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head += [f"WARC-Payload-Digest: sha1:{row.payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """The record as a gzip member whose extra field "sl" holds its deflated and its full length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Member(io.RawIOBase):
    """One gzip member of known deflated length, inflated as it is read."""

    def __init__(self, file, length: int):
        self.file, self.left, self.inflate, self.ready = file, length, zlib.decompressobj(-15), b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.ready and self.left:
            raw = self.file.read(min(self.left, 1 << 11))
            self.left -= len(raw)
            self.ready = self.inflate.decompress(raw)
            if not raw:
                break
        data, self.ready = self.ready[: len(b)], self.ready[len(b) :]
        b[: len(data)] = data
        return len(data)


def read_archive(stream, accepts=lambda fields: True, payload: bool = True) -> Iterator[tuple]:
    """Rows of a seekable file of plain records, of members with "sl", or of any other gzip file."""
    while (magic := stream.read(2)) == b"\x1f\x8b":
        head = stream.read(10)
        extra = stream.read(struct.unpack("<H", head[8:10])[0]) if head[1] == 4 else b""
        if extra[:2] != b"sl":
            stream.seek(0)
            yield from read_records(_Forward(gzip.GzipFile(fileobj=stream)), accepts, payload)
            return
        length = struct.unpack("<I", extra[4:8])[0]
        start = stream.tell()
        # the first bytes hold the headers; the rest is inflated only if the record is wanted
        yield from read_records(_Forward(io.BufferedReader(_Member(stream, length), 1 << 11)), accepts, payload, alone=True)
        stream.seek(start + length + 8)
    if magic:
        stream.seek(0)
        yield from read_records(stream, accepts, payload)


class _Forward:
    """A stream that skips by reading, for those that can't seek."""

    def __init__(self, stream):
        self.stream, self.readline, self.read = stream, stream.readline, stream.read

    def seek(self, n: int, whence: int) -> None:
        while n > 0 and (got := len(self.stream.read(min(n, 1 << 16)))):
            n -= got


def _headers(stream) -> dict[str, str] | None:
    """The named fields of the next record, or None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:  # a folded line
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, _, value = line.partition(b":")
        name = key.strip().decode("ascii", "replace").lower()
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def _urn(value: str | None) -> str | None:
    if value is None:
        return None
    value = value.strip("<>")
    return value.removeprefix("urn:x-record:")


def read_records(stream, accepts=lambda fields: True, payload: bool = True, alone: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA; ``accepts`` sees the header columns alone and spares the rest. ``alone``: of the first record, whose rest the caller skips."""
    while (h := _headers(stream)) is not None:
        length = int(h.get("content-length", 0))
        fields = {
            "record_id": _urn(h.get("warc-record-id")),
            "record_type": h.get("warc-type"),
            "target_uri": h.get("warc-target-uri"),
            "refers_to": _urn(h.get("warc-refers-to")),
            "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        if not accepts(fields):
            if alone:
                return
            stream.seek(length, io.SEEK_CUR)
            continue
        body, n = None, length
        if "application/http" in h.get("content-type", ""):
            left = length
            n = None
            while left > 0:
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b"\n") or not line:
                    break
                if line.lower().startswith(b"content-length:"):
                    n = int(line.partition(b":")[2])
            n = left if n is None else n
        else:
            left = length
        if payload and fields["record_type"] != "revisit":
            body = stream.read(left)
        elif not alone:
            stream.seek(left, io.SEEK_CUR)
        yield (*fields.values(), n, body)
        if alone:
            return


# --- the data source ----------------------------------------------------------------


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Wrote(WriterCommitMessage):
    file: str
    records: int


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "target_uri", "refers_to", "record_id", "payload_digest")

    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.PUSHED and isinstance(f, EqualTo):
                self.tests.append(("in", column, (f.value,)))
            elif column in self.PUSHED and isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif column in self.PUSHED and isinstance(f, IsNotNull):
                self.tests.append(("set", column, None))
            elif column in self.PUSHED and isinstance(f, IsNull):
                self.tests.append(("unset", column, None))
            else:
                yield f

    def partitions(self):
        fs, path = _filesystem(self.path)
        names = [n for m in manifests(fs, path) for n in listed(fs, m)]
        return [_File(f"{path}/{n}") for n in names] or [_File("")]

    def _accepts(self, fields: dict) -> bool:
        for kind, column, values in self.tests:
            v = fields[column]
            if (v not in values or v is None) if kind == "in" else (v is None) == (kind == "set"):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as raw, io.BufferedReader(_Raw(raw), 1 << 20) as stream:
            yield from read_archive(stream, self._accepts, self.payload)


class _Raw(io.RawIOBase):
    """Arrow's file as a raw stream, so that short skips stay inside the buffer."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        self.file.seek(at, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()


def manifests(fs, path: str) -> list[str]:
    """The lists of archives below ``path``, one for each write that was committed; an error if there are none."""
    from pyarrow.fs import FileSelector

    found = sorted(f.path for f in fs.get_file_info(FileSelector(path)) if f.base_name.startswith("MANIFEST") and not f.base_name.endswith(".tmp"))
    if not found:
        raise FileNotFoundError(f"{path} has no archives")
    return found


def listed(fs, manifest: str) -> list[str]:
    with fs.open_input_stream(manifest) as f:
        return f.read().decode().split()


class WarcWriter(DataSourceWriter):
    """A write becomes visible by its manifest, which appears at once and whole.

    Appending adds one to those that are there, so writes at the same time keep each
    other's records. Overwriting removes what was there when it commits; a reader that
    comes while it does so may meet the old records beside the new ones.
    """

    def __init__(self, options, overwrite: bool = False):
        self.path = options["path"]
        self.plain = str(options.get("compression", "gzip")).lower() == "none"
        self.overwrite = overwrite

    def write(self, rows):
        fs, path = _filesystem(self.path)
        rows = iter(rows)
        if (row := next(rows, None)) is None:
            return _Wrote("", 0)
        fs.create_dir(path, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc{'' if self.plain else '.gz'}", 0
        with fs.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as out:
            for row in chain([row], rows):
                record = record_bytes(row)
                out.write(record if self.plain else gzip_member(record))
                n += 1
        return _Wrote(name, n)

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        old = [f.path for f in fs.get_file_info(FileSelector(path)) if f.base_name.startswith("MANIFEST")] if self.overwrite else []
        gone = [f"{path}/{n}" for m in old for n in listed(fs, m)]
        name = f"{path}/MANIFEST-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp") as f:
            f.write("\n".join(m.file for m in messages if m is not None and m.records).encode())
        fs.move(f"{name}.tmp", name)
        for f in [*old, *gone]:
            fs.delete_file(f)

    def abort(self, messages):
        fs, path = _filesystem(self.path)
        for m in messages:
            if m is not None and m.records:
                fs.delete_file(f"{path}/{m.file}")


def register(spark: SparkSession) -> None:
    common.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- archives of pages --------------------------------------------------------------


def write_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, mode: str = "append") -> None:
    """One record for each row below ``path``: of equal payloads the row with the largest id holds it, others revisit it.

    With ``mode`` "overwrite" they replace what is there, else they come beside it; equal
    payloads of an earlier write are not looked for. A null payload is an empty one. Payloads of fewer than ``least_bytes`` bytes are all
    written out. Rows that repeat the largest id are responses too; a null id is smaller
    than any other, and is written as an empty record id. The rows of a popular payload
    are found by a partially aggregated maximum; only then do pages meet it, in a join
    whose both sides are plain exchanges, so adaptive execution can split its hot keys.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.encode(common.text_or_empty(payload_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    largest = common.keep(rows.select("sha1", "id").groupBy("sha1").agg(F.max("id").alias("first")), "warc-largest")
    response = F.col("first").eqNullSafe(F.col("id")) | (F.col("payload_bytes") < least_bytes)
    records = rows.join(largest, "sha1").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.when(~response, F.col("first").cast("string")).alias("refers_to"),
        base32(F.col("sha1")).alias("payload_digest"),
        "payload_bytes",
        F.when(response, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode(mode).save(path)


def base32(hex_digest):
    """Upper-case base 32 of 40 hex digits: each five hex digits are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):
        v = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(letters, F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def _verify(rows: DataFrame) -> DataFrame:
    """Digest and size from the payload where there is one, else from the headers."""
    whole = F.col("payload").isNotNull()
    return rows.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("bigint").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(whole, base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to") != "", F.col("refers_to")).cast("bigint").alias("refers_to"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the archives."""
    register(spark)
    return _verify(spark.read.format("warc").load(path).filter(F.col("record_type").isin("response", "revisit")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
