"""WARC records in ZIP-packaged archives.

An archive is a ZIP file whose members are stored, not compressed: a WARC file in which each
record is a gzip member of its own, and an index with a line for each record.  The reader
parses the end record, the ZIP64 records where there are any, and the central directory,
locates members from their local headers, and reads records by the offsets and lengths that
the index gives.  Nothing is extracted; it needs a function ``read_at(offset, length)`` and
the size, so it works on bytes, on files and on any store with range reads.

Writing: of records with equal payloads of at least 100 bytes, that with the smallest page id
is a response and the others revisit it; smaller payloads are always responses.  Tasks write
their archives as files into the shared folder (through Arrow's file systems: local, HDFS and
object stores), under a name with the task's attempt that is moved to its place when the file
is whole; only names, sizes and numbers of records move through Spark.  The table lists the
files of the attempts that Spark committed: files of lost or repeated attempts are in no row.

Defined results: a null payload is empty; a row without page id is a response and refers to
nothing; rows of one page id that is the smallest of its payload are all responses; a url's
control characters and spaces are percent-encoded in headers, a null url has no header.  A
payload of any length is one record; an empty table gives no archive.  Columns that the
caller names do not clash with those made here.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import steps
from .common import Workspace

REVISIT_BYTES = 100
#: An archive is closed once its records take this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Neighbouring records are read in one range of about this many bytes.
RANGE_BYTES = 1 << 20
LEVEL = 2
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def write_zip(write: Callable[[bytes], object], members: list[tuple[str, list[bytes]]], zip64: bool = False) -> int:
    """Write a ZIP file of stored members, each given in parts, and return its size; with
    ``zip64`` (or beyond 4 GB) in the ZIP64 form.  Parts are never joined."""
    directory, at = bytearray(), 0
    for name, parts in members:
        raw, size, crc = name.encode(), sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        big = zip64 or size >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        short = 0xFFFFFFFF if big else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        head = LOCAL + struct.pack("<5H3I2H", 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        directory += CENTRAL + struct.pack(
            "<6H3I5H2I", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at
        ) + raw + extra
        write(head)
        for part in parts:
            write(part)
        at += len(head) + size
    start, count = at, len(members)
    if zip64 or start >= 0xFFFFFFFF or count >= 0xFFFF:
        directory += END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, len(directory), start)
        directory += LOCATOR64 + struct.pack("<IQI", 0, start + len(directory) - 56, 1)
        directory += END + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        directory += END + struct.pack("<4H2IH", 0, 0, count, count, len(directory), start, 0)
    write(bytes(directory))
    return start + len(directory)


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    out = bytearray()
    write_zip(out.extend, [(name, [data]) for name, data in members], zip64)
    return bytes(out)


class ZipRanges:
    """Where the stored members of a ZIP file are."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        self.members: dict[str, tuple[int, int, int]] = {}  # local header, size, method
        tail_at = max(0, size - (22 + 0xFFFF))
        tail = bytes(read_at(tail_at, size - tail_at))
        at = tail.rfind(END)
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the signature may stand in the comment
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut short")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        locator_at = tail_at + at - 20
        if locator_at >= 0 and (locator := bytes(read_at(locator_at, 20)))[:4] == LOCATOR64:
            record = bytes(read_at(struct.unpack_from("<Q", locator, 8)[0], 56))
            if record[:4] != END64:
                raise ValueError("the ZIP64 end record is not where its locator says")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        directory = bytes(read_at(start, length))
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, plain = struct.unpack_from("<II", directory, at + 20)
            names, extras, comments = struct.unpack_from("<3H", directory, at + 28)
            local = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
            extra = directory[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                kind, width = struct.unpack_from("<HH", extra)
                if kind == 1:  # only the fields that are full in the fixed part, in this order
                    values = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    if plain == 0xFFFFFFFF:
                        plain = values.pop(0)
                    if packed == 0xFFFFFFFF:
                        packed = values.pop(0)
                    if local == 0xFFFFFFFF:
                        local = values.pop(0)
                extra = extra[4 + width :]
            self.members[name] = (local, packed, method)
            at += 46 + names + extras + comments

    def range_of(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        local, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed in the archive; only stored members have ranges")
        head = bytes(self.read_at(local, 30))
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        names, extras = struct.unpack_from("<HH", head, 26)
        return local + 30 + names + extras, size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, size = self.range_of(name)
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError(f"range outside of {name}")
        return bytes(self.read_at(start + offset, length))


def open_file(path: str) -> ZipRanges:
    """Ranges of a file in a local folder or a store, by its path or URI."""
    store, inner = stores.FileSystem.from_uri(path) if ":/" in path else (stores.LocalFileSystem(), path)
    file = store.open_input_file(inner)

    def read_at(at: int, length: int) -> bytes:
        file.seek(at)
        return file.read(length)

    out = ZipRanges(read_at, file.size())
    out.close = file.close
    return out


def open_bytes(content: bytes) -> ZipRanges:
    view = memoryview(content)
    return ZipRanges(lambda at, n: view[at : at + n], len(view))


def _quoted(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_quoted(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """A record's named fields (lower case), its block's HTTP fields and its payload."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    answer = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}
    return {"warc": fields, "http": answer, "payload": payload}


def members_of(records: list[tuple]) -> list[tuple[str, list[bytes]]]:
    """``(page_id, url, digest, type, gzip member)`` rows to the members of an archive."""
    lines, at = [], 0
    for page_id, url, digest, kind, raw in records:
        lines.append(json.dumps({"page": page_id, "url": url, "digest": digest, "type": kind, "offset": at, "length": len(raw)}))
        at += len(raw)
    index = ("\n".join(lines) + "\n" * bool(lines)).encode()
    return [(WARC_NAME, [r[4] for r in records]), (INDEX_NAME, [index])]


def entries_of(zip_file: ZipRanges) -> list[dict]:
    """The lines of an archive's index."""
    return [json.loads(line) for line in zip_file.read(INDEX_NAME).splitlines()]


def records_of(zip_file: ZipRanges, entries: list[dict] | None = None) -> Iterator[dict]:
    """The records that ``entries`` (all, if not given) name, in their order.  Records that stand
    side by side are read in one range."""
    entries = entries_of(zip_file) if entries is None else entries
    start, _ = zip_file.range_of(WARC_NAME)
    at = 0
    while at < len(entries):
        first, end, upto = entries[at]["offset"], entries[at]["offset"] + entries[at]["length"], at + 1
        while upto < len(entries) and entries[upto]["offset"] == end and end + entries[upto]["length"] - first <= RANGE_BYTES:
            end += entries[upto]["length"]
            upto += 1
        raw = memoryview(zip_file.read_at(start + first, end - first))
        for entry in entries[at:upto]:
            low = entry["offset"] - first
            yield parse_record(raw[low : low + entry["length"]])
        at = upto


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False,
) -> DataFrame:
    """Write archives to ``folder``, which all executors share, as the rows are asked for:
    ``(name, bytes, records)``, a row a file.

    Payloads move once, by page id; revisits are found on ids and digests alone.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    ids = rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).where(
        (F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()
    )
    firsts = ids.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    again = ids.join(firsts, "digest").where("id > first").select("id", "digest", "first")
    marked = rows.withColumn("digest", F.sha2("payload", 256)).join(again.dropDuplicates(), ["id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, inner = stores.FileSystem.from_uri(folder)
        context, number = TaskContext.get(), 0
        task = f"pages-{context.partitionId():06d}-{context.taskAttemptId():09d}"
        records: list[tuple] = []
        size = 0

        def close():
            nonlocal number, records, size
            name = f"{task}-{number:06d}.zip"
            store.create_dir(inner, recursive=True)
            with store.open_output_stream(f"{inner}/_{name}") as out:
                whole = write_zip(out.write, members_of(records), zip64)
            store.move(f"{inner}/_{name}", f"{inner}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([whole], pa.int64()), pa.array([len(records)], pa.int64())], ["name", "bytes", "records"])
            number, records, size = number + 1, [], 0
            return row

        for batch in batches:
            for part in steps(batch, 64):
                columns = [part.column(k).to_pylist() for k in range(5)]
                for page, digest, url, payload, first in zip(*columns):
                    raw = record_bytes(page, url, payload, digest, first, len(payload))
                    records.append((page, url, digest, "response" if first is None else "revisit", raw))
                    size += len(raw)
                    if size >= archive_bytes:
                        yield close()
        if records:
            yield close()

    return marked.select("id", "digest", "url", "payload", "first").mapInArrow(run, "name string, bytes long, records long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the ``archives(name)`` in ``folder``, read by the ranges that their indexes give.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact[, payload])``;
    ``intact`` says if a response's payload has the digest and length that its headers name, and
    if a revisit has no payload and names its length.
    """
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
        + ", payload binary" * payloads
    )
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()] + [pa.binary()] * payloads
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None  # noqa: E731  <urn:page:N>

    def row_of(record: dict) -> tuple:
        warc, size = record["warc"], int(record["http"]["content-length"])
        digest = warc["warc-payload-digest"].removeprefix("sha256:")
        revisit = warc["warc-type"] == "revisit"
        if revisit:
            intact = not record["payload"] and size >= REVISIT_BYTES
        else:
            intact = len(record["payload"]) == size and hashlib.sha256(record["payload"]).hexdigest() == digest
        row = (number(warc["warc-record-id"]), warc.get("warc-target-uri"), size, digest, warc["warc-type"],
               number(warc["warc-refers-to"]) if revisit else None, intact)
        return row + ((record["payload"],) if payloads else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                zip_file = open_file(f"{folder}/{name}")
                found, size = [], 0
                for record in records_of(zip_file):
                    found.append(row_of(record))
                    size += len(record["payload"]) if payloads else 512
                    if size >= RANGE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                zip_file.close()

    return archives.select("name").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all ``pages`` to archives in the shared folder, read their records back and delete
    the archives."""
    ws = Workspace(pages.sparkSession, "archives")
    folder = f"{ws.root}/files"
    written = ws.table(write_archives(pages, folder, id_col, url_col, payload_col), "names")
    tasks = max(1, min(written.count(), 4 * pages.sparkSession.sparkContext.defaultParallelism))
    out = ws.keep_only(read_archives(written.repartition(tasks), folder))
    ws.delete("files")
    return out
