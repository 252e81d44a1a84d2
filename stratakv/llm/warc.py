"""WARC archives as a Spark data source, written and read in Python.

Reading: a partition is a file, and files are dealt to partitions by size. Predicates on the record type and on header
columns are pushed down. Of each record only the header block is decoded; a record that the predicates reject, or whose
payload nobody wants (option payload=false), is stepped over by its length without decoding the rest. In compressed
archives every record is a gzip member of its own; the writer notes the member's length in the gzip header's extra field,
as the archive formats' `sl` subfield does, so members are stepped over as well. Members without the note are decoded to
their end.

Writing: each task attempt writes files of its own name; commit lists the files of the attempts that count in `_files`,
and readers of a folder with such a list read only those. A lost or repeated task leaves no record twice. Files are opened
by pyarrow's file systems, in the tasks too: local or mounted paths, s3 (s3a and s3n are taken for it), gs, abfs, and hdfs
where its library is installed on the workers.

write_pages() stores each distinct payload once: of the rows with equal payloads of at least `min_bytes`, that with the
largest id is a `response`, the others are `revisit` records that refer to it.

Defined cases: a null payload is empty; a null url becomes an empty target; a null id has no id header and reads back as
null, and revisits the largest id of its group, or is a response if the group has none; rows repeated with the id of the
response are responses too; an empty table makes an archive without records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .workdir import Table, new_folder, prepare

READ = "page_id long, record_type string, record_id string, target_uri string, warc_date string, payload_digest string, payload_length long, refers_to string, refers_to_page long, payload binary"
WRITTEN = "page_id long, url string, payload binary, digest string, refers_to long"

FILE_BYTES = 64 << 20
PART_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header of each column that predicates can be pushed to.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Names that Hadoop gives to stores which pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
_EXTRA = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def file_system(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def member(block: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field `sl` holds its own length and that of its content."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    total = len(_EXTRA) + 2 + 4 + 16 + len(body) + 8
    return b"".join([_EXTRA, struct.pack("<H2sHQQ", 20, b"sl", 16, total, len(block)), body, struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    content = http if refers_to is not None else http + payload
    clean = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(content)}")
    return b"".join(["\r\n".join(lines).encode("utf-8", "surrogatepass"), b"\r\n\r\n", content, b"\r\n\r\n"])


class Source:
    """Reads bytes forward in a file, with a window that can be looked into."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.step = file, step
        self.buffer, self.used, self.at = b"", 0, 0  # used: bytes of the buffer already stepped over; at: place in the file

    def peek(self, n: int) -> bytes:
        while len(self.buffer) - self.used < n:
            more = self.file.read(max(self.step, n))
            if not more:
                break
            self.buffer, self.used = self.buffer[self.used :] + more, 0
        return self.buffer[self.used : self.used + n]

    def skip(self, n: int) -> None:
        self.at += n
        self.used += n
        if self.used > len(self.buffer):
            self.buffer, self.used = b"", 0
            self.file.seek(self.at)

    def done(self) -> bool:
        return not self.peek(1)


def headers_of(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass").strip()
    return out


class Member:
    """A gzip member being decoded as far as asked for."""

    def __init__(self, source: Source):
        self.source, self.out, self.ended = source, b"", False
        head = source.peek(64)
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        self.length = None
        skip = 10
        if head[3] & 4:
            (n,) = struct.unpack_from("<H", head, 10)
            head = source.peek(12 + n)
            at = 12
            while at + 4 <= 12 + n:
                name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
                if name == b"sl" and size == 16:
                    (self.length,) = struct.unpack_from("<Q", head, at + 4)
                at += 4 + size
            skip = 12 + n
        if head[3] & 0b11010:  # a name, a comment or a checksum of the header: let zlib read it
            self.inflate, skip = zlib.decompressobj(31), 0
        else:
            self.inflate = zlib.decompressobj(-15)
        self.raw, self.read = skip == 0, skip

    def more(self, n: int = 4096) -> bool:
        """Decodes some more; false at the member's end."""
        if self.ended:
            return False
        have = self.source.peek(self.read + n)[self.read :]
        if not have:
            raise ValueError("the archive ends within a record")
        self.out += self.inflate.decompress(have)
        self.ended = self.inflate.eof
        self.read += len(have) - len(self.inflate.unused_data)
        return True

    def leave(self) -> None:
        """Steps to the next member."""
        if self.length is None:
            while self.more(1 << 16):
                self.out = b""
            self.length = self.read + (0 if self.raw else 8)
        self.source.skip(self.length)


def records(source: Source, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records that wanted(headers) accepts; the payload is None if not asked for or not there."""
    while not source.done():
        zipped = source.peek(2) == b"\x1f\x8b"
        if zipped:
            own = Member(source)
            while (cut := own.out.find(b"\r\n\r\n")) < 0 and own.more(1024):
                pass
            found = own.out
        else:
            n = 1024
            while (cut := (found := source.peek(n)).find(b"\r\n\r\n")) < 0 and len(found) == n:
                n *= 2
        if cut < 0:
            raise ValueError("a record without the end of its header")
        head = headers_of(found[:cut])
        begin, length = cut + 4, int(head["content-length"])
        take = wanted(head)
        payload = None
        if take and payloads and head.get("warc-type") != "revisit":
            if zipped:
                while len(own.out) < begin + length and own.more(1 << 16):
                    pass
                block = own.out[begin : begin + length]
            else:
                block = source.peek(begin + length)[begin:]
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        if zipped:
            own.leave()
        else:
            source.skip(begin + length + 4)
        if take:
            yield head, payload


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith)) and self._known(column, f.value):
                self.tests.append((HEADERS[column], type(f).__name__, f.value))
            else:
                yield f

    @staticmethod
    def _known(column: str, value) -> bool:
        return value is not None and not (isinstance(value, (list, tuple)) and None in value)

    def wanted(self, head: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = head.get(name)
            own = own.removeprefix("sha1:") if own and name == "warc-payload-digest" else own
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In" else own.startswith(value)):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, path = file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [Files([path])]
        listed = system.get_file_info(f"{path}/_files")
        if listed.type == fs.FileType.File:
            with system.open_input_stream(listed.path) as f:
                found = [(f"{path}/{x['name']}", x["bytes"]) for x in json.loads(f.read())]
        else:
            found = [(x.path, x.size) for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))]
        parts, held = [[]], 0
        for name, size in sorted(found, key=lambda x: -x[1]):
            if parts[-1] and held + size > PART_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(name)
            held += size
        return [Files(p) for p in parts]

    def read(self, partition: Files):
        system, _ = file_system(self.path)
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: int(x) if x not in (None, "") else None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for head, payload in records(Source(file), self.wanted, self.payloads):
                    rows.append((number(head.get("x-page-id")), head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, number(head.get("x-payload-length")), head.get("warc-refers-to"), number(head.get("x-refers-to-page-id")), payload))
                    held += len(payload or b"")
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Wrote(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", "1"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        stem = uuid.uuid4().hex
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(x.split()[0])) for x in WRITTEN.split(", ")]
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[k].as_py() for c in columns)
                if out is None:
                    files.append({"name": f"{stem}-{len(files):05d}.warc.gz"})
                    out, size = system.open_output_stream(f"{path}/{files[-1]['name']}", compression=None), 0
                data = member(record(page_id, url, payload or b"", digest, refers_to), self.level)
                out.write(data)
                size += len(data)
                files[-1]["bytes"] = size
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Wrote(files)

    def commit(self, messages) -> None:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_files") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        system, path = file_system(self.path)
        for x in (x for m in messages if m for x in m.files):
            system.delete_file(f"{path}/{x['name']}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(WarcDataSource)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1, from built-in functions: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    four = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, broadcast_rows: int = 100_000) -> None:
    """Archives page_id, url and html; equal payloads of at least min_bytes are stored once."""
    spark = pages.sparkSession
    register(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", base32_sha1(F.col("payload")))
    large = own.filter(F.octet_length("payload") >= min_bytes) if min_bytes else own
    groups = Table(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "payload-groups")
    small = groups.df.limit(broadcast_rows + 1).count() <= broadcast_rows  # about 60 bytes a row
    joined = own.join(F.broadcast(groups.df) if small else groups.df, "digest", "left")
    fits = F.octet_length("payload") >= min_bytes
    refers = F.when(fits & ~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull()), F.col("first"))
    joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).write.format("warc").mode("append").save(path)
    groups.drop()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives the pages and reads them back, once: responses with payloads, whose length and digest are taken anew, and
    revisits by their headers alone."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_pages(pages, path, min_bytes)
    both = read(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    here = F.col("record_type") == "response"
    return both.select(
        "page_id",
        F.when(here, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(here, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~here, F.col("refers_to_page")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(digest, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM g
"""
