"""WARC archives packaged in ZIP files, read by byte range.

Each package holds two stored (uncompressed) members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.cdxj``, one line a record with its offset and length.
The reader parses the ZIP's end records (ZIP64 ones too) and central directory, finds where the
members' bytes lie, and fetches records by range from the package itself; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._common import bounded_batches
from marlstone.session import materialize, scratch_path, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed beyond this many bytes; a read task takes this many records.
PACKAGE_BYTES, READ_ROWS = 256 << 20, 1000
#: Tasks that read, at most.
READ_TASKS = 20_000
#: Smaller payloads are always stored whole.
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"


# -- records ---------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, the version under ``""``) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {"": version} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a record is cut short")
    return headers, rest[:size]


def page_of(uri: str | None) -> int | None:
    """The page id in ``<urn:page:N>``."""
    n = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n.lstrip("-").isdigit() else None


def describe(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of a record.

    A response's payload is hashed and held against its header; a revisit carries the digest in its
    own header and the length in the HTTP header it repeats.
    """
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload is not what its header says")
    return page_of(headers["warc-record-id"]), length, digest, headers["warc-type"], page_of(headers.get("warc-refers-to"))


# -- the ZIP package --------------------------------------------------------------------------

class Package:
    """Random access to the stored members of a ZIP file through a seekable stream."""

    def __init__(self, stream: BinaryIO, size: int):
        self.stream, self.size = stream, size
        self.members = {name: self._data_start(at, stored) for name, (at, stored) in self._directory().items()}

    def read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        data = self.stream.read(n)
        if len(data) < n:
            raise ValueError("the package is cut short")
        return data

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name -> (offset of the local header, stored size), from the central directory."""
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record_at = struct.unpack_from("<Q", tail, end - 12)[0]
            end64 = self.read(record_at, 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at, out = self.read(start, length), 0, {}
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, full, n, x, c = struct.unpack_from("<IIHHH", directory, at + 20)
            header, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n].decode()
            extra, end_extra = at + 46 + n, at + 46 + n + x
            while extra + 4 <= end_extra:
                kind, size = struct.unpack_from("<HH", directory, extra)
                if kind == 1:  # 64-bit values stand here for each field that is all ones, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", directory, extra + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra += 4 + size
            if method == 0:  # only stored members can be read by range
                out[name] = (header, packed)
            at = end_extra + c
        return out

    def _data_start(self, header: int, stored: int) -> tuple[int, int]:
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        n, x = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + x, stored

    def range(self, member: str, offset: int, length: int) -> bytes:
        """Bytes of a stored member."""
        start, stored = self.members[member]
        if offset + length > stored:
            raise ValueError(f"{member}: the range ends beyond the member")
        return self.read(start + offset, length)

    def index(self, offset: int = 0, length: int | None = None) -> list[dict]:
        """The index lines, in record order: all, or those of a byte range that holds whole lines."""
        lines = self.range(INDEX, offset, self.members[INDEX][1] if length is None else length).decode().splitlines()
        return [json.loads(x.split(" ", 2)[2]) for x in lines]

    def record(self, entry: dict) -> bytes:
        """One record's bytes, by range."""
        return zlib.decompress(self.range(DATA, entry["offset"], entry["length"]), 31)


class Writer:
    """Writes one package to a shared file system under a passing name, and renames it when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.passing = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.passing)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, url: str | None, data: bytes) -> None:
        packed = zlib.compress(data, 3, 31)
        self.data.write(packed)
        entry = json.dumps({"url": url, "page": page_id, "offset": self.at, "length": len(packed)})
        self.lines.append(f"{quote(url or '-', safe='')} {DATE} {entry}\n")
        self.at += len(packed)

    def close(self) -> list[tuple[int, int]]:
        """Closes the package; byte ranges ``(offset, length)`` of its index, each of ``READ_ROWS`` lines at most."""
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.close()
        self.out.close()
        self.fs.move(self.passing, self.path)
        sizes = [sum(map(len, self.lines[k : k + READ_ROWS])) for k in range(0, len(self.lines), READ_ROWS)]
        return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


# -- over tables ------------------------------------------------------------------------------

def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``; refers_to is null for responses.

    Only digests that occur twice are joined back, so the join's small side has a row for each
    repeated payload, and adaptive execution splits the partition of a payload that many pages share.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(repeated.where("n > 1").select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes packages below ``folder`` (a shared URI) and returns the byte ranges ``(package, offset, length)`` of their indexes.

    A task names its packages by its partition and replaces them whole, so a repeated or doubled
    attempt leaves the same files.  Null payloads are not allowed (``mark_revisits`` makes them empty);
    repeated rows are records of their own; no rows give no package.
    """
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, writer = TaskContext.get().partitionId(), 0, None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{k:04d}.wacz"
                    writer = Writer(name)
                writer.add(page_id, url, record(page_id, url, payload, digest, refers_to))
                if writer.at > PACKAGE_BYTES:
                    done.extend((name, *r) for r in writer.close())
                    writer, k = None, k + 1
        if writer:
            done.extend((name, *r) for r in writer.close())
        names, first, n = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["package", "offset", "length"])

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return materialize(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "package string, offset long, length long"), "packages")


def read_packages(ranges: DataFrame) -> DataFrame:
    """Every record of the given index ranges ``(package, offset, length)``, read back by byte range.

    Ranges are dealt over as many tasks as there are (``READ_TASKS`` at most), a range holding
    ``READ_ROWS`` records at most.  A range given twice is read twice; no ranges give no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(path) as stream:
                    package = Package(stream, fs.get_file_info(path).size)
                    rows = [describe(package.record(e)) for e in package.index(offset, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    tasks = min(READ_TASKS, max(1, ranges.count()))
    dealt = ranges.select("package", "offset", "length").repartition(tasks, "package", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for every page into packages in the shared folder and reads them back.

    Null html is an empty payload; a null url leaves the target out; repeated rows of the smallest
    page_id of a payload are all responses; an empty table gives no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_packages(write_packages(mark_revisits(pages, page_id, url, html), folder))


def op4_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record in ZIP packages and read back by range."""
    return round_trip(table(spark, sf_dir, "pages"))
