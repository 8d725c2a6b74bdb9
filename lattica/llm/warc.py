"""Web archives packaged in ZIP files: a writer, and a reader that never extracts.

A package is a ZIP whose members are stored, not compressed: ``archive/*.warc.gz``,
in which every record is a gzip member of its own, and ``indexes/*.cdx``, whose
lines give each record's place in its archive.  As stored members lie in the file
byte for byte, a record is one range read: offset of the member's data plus offset
of the record.  The reader finds members from
the end-of-central-directory record, the ZIP64 records where they are needed,
and the central directory.

Files are written and read inside tasks through Arrow's file systems, in the
cluster's shared folder.  A file is written under a name of the attempt and then
moved to its own, so a repeated task leaves one whole file.

Defined cases: null html is an empty payload; payloads of fewer than
``LEAST_SHARED`` bytes never refer to another page; a repeated page_id is a
record each, and where rows repeat the smallest page_id with its payload, each of
them is a response; a null page_id is written as such, is a response and never
referred to; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.shared import fresh_path, map_batches, written

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 100
#: Bytes of archive in one package.
PACKAGE_BYTES = 16 << 20
#: From so many bytes or entries on, a ZIP number moves to its ZIP64 field.
ZIP32, ZIP16 = 0xFFFFFFFF, 0xFFFF


# --- records


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers alone and names the page that holds its payload."""
    kind = "response" if refers_to is None else "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(raw: bytes) -> Record:
    """A record from its bytes; a wrong length or version is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or rest[len(block) :] not in (b"\r\n\r\n", b""):
        raise ValueError("a WARC record's length doesn't match")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload)


# --- ZIP with stored members


@dataclass
class Member:
    name: str
    header: int
    size: int
    crc: int
    stored: bool


def _zip64(fields: list[tuple[int, int]]) -> bytes:
    big = b"".join(struct.pack("<Q", value) for value, limit in fields if value >= limit)
    return struct.pack("<HH", 1, len(big)) + big if big else b""


class Packer:
    """Writes stored members one after another to a stream, and the directory at the end."""

    def __init__(self, stream, zip32: int = ZIP32, zip16: int = ZIP16) -> None:
        self.stream, self.at, self.members, self.zip32, self.zip16 = stream, 0, [], zip32, zip16

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, name: str, data: bytes) -> None:
        m = Member(name, self.at, len(data), zlib.crc32(data), True)
        big = m.size >= self.zip32
        extra = struct.pack("<HHQQ", 1, 16, m.size, m.size) if big else b""
        size = ZIP32 if big else m.size
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 0x21, m.crc, size, size, len(name.encode()), len(extra)) + name.encode() + extra)
        self._put(data)
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            extra = _zip64([(m.size, self.zip32), (m.size, self.zip32), (m.header, self.zip32)])
            size, header = (ZIP32 if m.size >= self.zip32 else m.size), (ZIP32 if m.header >= self.zip32 else m.header)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if extra else 20, 0x800, 0, 0, 0x21, m.crc, size, size, len(m.name.encode()), len(extra), 0, 0, 0, 0, header) + m.name.encode() + extra)
        size, n = self.at - start, len(self.members)
        if start >= self.zip32 or size >= self.zip32 or n >= self.zip16:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, size, start = ZIP16, ZIP32, ZIP32
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))


class Package:
    """Range reads from a ZIP file that ``read_at(offset, length)`` gives access to."""

    def __init__(self, read_at, size: int) -> None:
        self.read_at = read_at
        self.members = {m.name: m for m in self._directory(size)}
        self._starts: dict[str, int] = {}

    def _directory(self, size: int) -> Iterator[Member]:
        tail_at = max(0, size - 65557)
        tail = self.read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: it has no end-of-central-directory record")
        n, length, start = struct.unpack_from("<HII", tail, end + 10)
        if ZIP16 == n or ZIP32 in (length, start):
            where = tail_at + end - 20
            sign, _, at, _ = struct.unpack("<4sIQI", self.read_at(where, 20)) if where >= 0 else (b"", 0, 0, 0)
            if sign == b"PK\x06\x07":
                sign, _, _, _, _, _, _, n, length, start = struct.unpack("<4sQHHIIQQQQ", self.read_at(at, 56))
                if sign != b"PK\x06\x06":
                    raise ValueError("a ZIP64 locator points to no ZIP64 record")
        raw, at = self.read_at(start, length), 0
        for _ in range(n):
            sign, _, _, flags, method, _, _, crc, packed, whole, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, at)
            if sign != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, i = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while i + 4 <= len(extra):
                tag, n_field = struct.unpack_from("<HH", extra, i)
                if tag == 1:
                    big = iter(struct.unpack_from(f"<{n_field // 8}Q", extra, i + 4))
                    whole = next(big) if whole == ZIP32 else whole
                    packed = next(big) if packed == ZIP32 else packed
                    header = next(big) if header == ZIP32 else header
                i += 4 + n_field
            yield Member(name, header, whole, crc, method == 0 and packed == whole and not flags & 1)
            at += 46 + n_name + n_extra + n_note

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member, read in place."""
        m = self.members[name]
        if not m.stored:
            raise ValueError(f"{name} is compressed or encrypted; only stored members can be read by range")
        length = m.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > m.size:
            raise ValueError(f"{name} has no such range")
        if name not in self._starts:
            sign, n_name, n_extra = struct.unpack("<4s22xHH", self.read_at(m.header, 30))
            if sign != b"PK\x03\x04":
                raise ValueError(f"{name} has no local header")
            self._starts[name] = m.header + 30 + n_name + n_extra
        return self.read_at(self._starts[name] + offset, length)

    def checked(self, name: str) -> bytes:
        data = self.read(name)
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} is damaged")
        return data


# --- Spark jobs


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plan(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses): equal long payloads refer to the smallest page."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    shared = rows.filter(F.octet_length("html") >= LEAST_SHARED).select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "first")
    # copies are found among digests and ids alone, so a payload that a third of all pages share gathers nowhere
    refs = rows.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest").join(shared, F.col("digest") == F.col("of")).filter("page_id > first").select(F.col("page_id").alias("again"), F.col("of"), "first").distinct()
    joined = rows.join(refs, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("of")), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, *, package_bytes: int = PACKAGE_BYTES, **columns) -> DataFrame:
    """Writes every page as a record into packages in ``folder``; returns one row per package: its path and records."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        part, nth = TaskContext.get().partitionId(), 0
        held, index, size = [], [], 0

        def closed() -> pa.RecordBatch:
            name = f"part-{part:06d}-{nth:04d}"
            scratch = f"{base}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(scratch) as out:
                zipped = Packer(out)
                zipped.add(f"archive/{name}.warc.gz", b"".join(held))
                zipped.add(f"indexes/{name}.cdx", "".join(index).encode())
                zipped.close()
            files.move(scratch, f"{base}/{name}.zip")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.zip"], "n_records": pa.array([len(held)], pa.int64())})

        for rb in batches:
            for page, url, html, digest, refers in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                raw = gzip.compress(record(page, url, html.encode(), digest, refers), compresslevel=4, mtime=0)
                index.append(f"{size} {len(raw)} {_line(url)}\n")
                held.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield closed()
                    held, index, size, nth = [], [], 0, nth + 1
        if held:
            yield closed()

    return written(map_batches(plan(pages, **columns), packed, "path string, n_records long"), "packages")


def open_package(path: str) -> Package:
    files, base = _file_system(path)
    source = files.open_input_file(base)
    return Package(lambda at, n: source.read_at(n, at), source.size())


READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_packages(paths: DataFrame, *, payloads: bool = True) -> DataFrame:
    """One row per record of the packages named in ``path``, by range reads along their indexes.

    A response's payload is checked against its digest; a revisit has none, and
    its length and digest are those in its headers.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None  # noqa: E731  <urn:page:N>
        for rb in batches:
            for path in rb.column("path").to_pylist():
                package = open_package(path)
                for name in [n for n in package.members if n.startswith("indexes/")]:
                    archive = f"archive/{name[8:-4]}.warc.gz"
                    rows, size = [], 0
                    for line in package.checked(name).decode().split("\n")[:-1]:
                        offset, length, _ = line.split(" ", 2)
                        r = parse(gzip.decompress(package.read(archive, int(offset), int(length))))
                        kind, digest = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(r.payload).hexdigest() != digest:
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        refers = r.headers.get("warc-refers-to")
                        rows.append((number(r.headers["warc-record-id"]), r.headers["warc-target-uri"], kind, r.payload if payloads else None, int(r.http["content-length"]), digest, None if refers is None else number(refers)))
                        size += len(r.payload)
                        if size >= 4 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return map_batches(paths.select("path").repartition(max(1, paths.count())), records, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=READ.names)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes the pages to packages in the shared folder and reports each record as it is read back."""
    paths = write_packages(pages, fresh_path(pages.sparkSession, "archive"), **columns)
    return read_packages(paths, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
