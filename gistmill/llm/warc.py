"""WARC in ZIP packages: write one record per page into stored members, then read records by byte range, without extraction.

*Writing.*  Each record is a gzip member of its own.  A package holds ``archive/data.warc.gz`` and ``indexes/index.jsonl``
(record, offset and length within the archive member), both stored, and at most about ``PACKAGE_BYTES`` of payload.
Records whose payload equals that of a page with a smaller id, and has at least ``MIN_REVISIT`` bytes, are ``revisit``
records that refer to the smallest such page; all others are ``response`` records with the payload.

*Reading.*  From the end of the file: the end-of-directory record, its ZIP64 form where one is there, the central directory,
the local header of each stored member, the index; then each record by one range read.  Digests are recomputed and
compared.

Packages lie in the shared folder, named by a fresh id, the partition and the attempt, so a task that is run again never
meets another's file; only packages in the written manifest are read.  File access goes through ``pyarrow.fs``.

Defined cases: a null html is the empty payload; a null url leaves the target out; a null page_id is written and read as
null and never referred to; rows that repeat a page_id are each written, and those with the smallest id of a payload are
all responses; an empty table gives no packages and no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, fresh_path

PACKAGE_BYTES = 48 << 20
MIN_REVISIT = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


# -- records -----------------------------------------------------------------------------------------------------------


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}"] if url is not None else []), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


# -- packages ----------------------------------------------------------------------------------------------------------


#: What a record takes beside its packed bytes: its line of the index, as held while the package is filled.
ENTRY_BYTES = 256


class Package:
    """A package being filled in memory; ``size`` counts packed records and their index lines."""

    def __init__(self):
        self.data, self.index, self.size = io.BytesIO(), [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, compresslevel=1, mtime=0)
        self.index.append({"page": page_id, "offset": self.data.tell(), "length": len(packed)})
        self.data.write(packed)
        self.size += len(packed) + ENTRY_BYTES

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            package.writestr(DATA, self.data.getvalue())
            package.writestr(INDEX, "".join(json.dumps(x) + "\n" for x in self.index))
        return out.getvalue()


class ZipDirectory:
    """The stored members of a ZIP file, found from its end; ``read`` takes a byte range of a member."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        tail_at = max(0, size - 65_557)
        tail = self._at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end-of-directory record")
        count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            place = tail.rfind(b"PK\x06\x07", 0, end)
            if place < 0:
                raise ValueError("no ZIP64 locator")
            record = self._at(struct.unpack("<Q", tail[place + 8 : place + 16])[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end-of-directory record")
            count, length, offset = struct.unpack("<QQQ", record[32:56])
        self.members = self._entries(self._at(offset, length), count)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    @staticmethod
    def _entries(raw: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """name -> (method, stored size, place of the local header)"""
        out, at = {}, 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a directory entry is damaged")
            (method,) = struct.unpack("<H", raw[at + 10 : at + 12])
            packed, full, name_n, extra_n, note_n = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            (place,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + name_n].decode()
            extra, step = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while step + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[step : step + 4])
                if kind == 1:
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[step + 4 : step + 4 + n // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    place = next(wide) if place == 0xFFFFFFFF else place
                step += 4 + n
            out[name] = (method, packed, place)
            at += 46 + name_n + extra_n + note_n
        return out

    def locate(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        method, size, place = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed")
        head = self._at(place, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a local header is damaged")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return place + 30 + name_n + extra_n, size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.locate(name)
        return self._at(at + offset, size - offset if length is None else length)


def read_package(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of every record in the index, each by a range read."""
    directory = ZipDirectory(file)
    start, size = directory.locate(DATA)
    for line in directory.read(INDEX).splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > size:
            raise ValueError("the index points beyond the archive")
        yield parse_record(gzip.decompress(directory._at(start + entry["offset"], entry["length"])))


# -- tables ------------------------------------------------------------------------------------------------------------


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for a response).  Only payloads held by several pages take part in the join."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("_digest"), "first_id")
    joined = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("IF(page_id <=> first_id, NULL, first_id)").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the packages; returns the written manifest (path, bytes, records)."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        package, number = Package(), 0

        def save() -> pa.RecordBatch:
            nonlocal package, number
            name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}-{number:04d}.zip"
            raw, n = package.to_bytes(), len(package.index)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(raw)
            package, number = Package(), number + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(raw)], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(j)[i].as_py() for j in range(5))
                package.add(page_id, build_record(page_id, url, payload, digest, refers_to, date))
                if package.size >= package_bytes:
                    yield save()
        if package.index:
            yield save()

    return cut(plan(pages).mapInArrow(each, "path string, bytes long, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of every package: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and the payload on request (null for a revisit)."""
    n = max(1, manifest.count())
    schema = RECORD + (", payload binary" if payloads else "")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with store.open_input_file(place) as file:
                    for fields, payload in read_package(file):
                        revisit = fields["warc-type"] == "revisit"
                        length, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
                            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None, length, digest, *([None if revisit else payload] if payloads else [])))
                        size += len(payload) if payloads else 0
                        if size > 16 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return manifest.select("path").repartition(n).mapInArrow(each, schema)
