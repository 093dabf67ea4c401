"""WARC archives packaged in ZIP files, written and read by ranges.

A package is a ZIP file whose members are stored, not deflated: an archive of
separately compressed records, and an index with each record's place. A reader
finds the members in the central directory at the file's end (ZIP64 or not),
the records in the index, and then reads runs of records, many tasks a package,
without extracting anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bytes of an archive after which the next package begins, of a run of records that one task reads, and of one read.
PACKAGE_BYTES, RUN_BYTES, BLOCK = 256 << 20, 8 << 20, 1 << 20
LEVEL = 4
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE = "urn:kinetext:page:"
DATE = "1970-01-01T00:00:00Z"
#: Of a URL, what may stand in a header as it is.
PLAIN = "".join(chr(c) for c in range(33, 127))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as an address that Python's file systems open too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    scheme = {"s3a": "s3", "s3n": "s3"}.get(uri.getScheme(), uri.getScheme())
    return f"{scheme}://{uri.getAuthority() or ''}{uri.getPath()}"


# --- Writing -----------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, headers: dict[str, str], block: bytes) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE} | headers | {"Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(page: str | None, url: str | None, payload: bytes, first: str | None) -> tuple[str, bytes]:
    """The name and the record of a page: a revisit of page ``first``, without the payload, or a response. The HTTP headers give the payload's length either way."""
    name = PAGE + quote(page or "", safe="")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Target-URI": quote(url or "", safe=PLAIN), "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "Content-Type": "application/http; msgtype=response"}
    if first is None:
        return name, record("response", name, headers, head + payload)
    headers |= {"WARC-Refers-To": f"<{PAGE}{quote(first, safe='')}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return name, record("revisit", name, headers, head)


class Package:
    """A package being written, front to back."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"  # a name of its own for each attempt: what a lost task has left is in no list
        fs, path = pafs.FileSystem.from_uri(self.path)
        self.raw = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(Unseekable(self.raw), "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.lines = 0, []
        self.add("", record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))

    def add(self, url: str, data: bytes) -> None:
        squeeze = zlib.compressobj(LEVEL, wbits=31)
        data = squeeze.compress(data) + squeeze.flush()
        self.archive.write(data)
        self.lines.append(f"{url_key(url)} {json.dumps({'url': url, 'filename': ARCHIVE.rpartition('/')[2], 'offset': str(self.size), 'length': str(len(data))})}\n")
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE, "bytes": self.size}]}))
        self.zip.close()
        self.raw.close()
        return self.path, len(self.lines), self.size


class Unseekable(io.RawIOBase):
    """A sink that is written front to back, as object stores want it."""

    def __init__(self, raw) -> None:
        self.raw = raw

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.raw.write(data)
        return len(data)


def url_key(url: str) -> str:
    """The host back to front, then the path, and a date: the order of an index."""
    try:
        at = urlsplit(url)
        host = at.hostname or ""
    except ValueError:
        return f"{quote(url, safe='')}) {DATE[:4]}"
    return f"{','.join(reversed(host.split('.')))}){quote(at.path or '/', safe='/')} {DATE[:4]}"


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record a row into packages in ``folder``, and returns them: path, records, bytes (of the archive).

    Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest id are responses and the others revisit it. Rows without an id
    revisit it too; if none of the rows has one, all are responses. A null
    payload is empty, a null URL too. An empty table makes no package.
    """
    spark = pages.sparkSession
    C.scratch_dir(spark)
    where = qualified(spark, folder)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    firsts = rows.select(digest.alias("digest"), "id").where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first is not null").drop("n")
    firsts = C.sized_broadcast(C.materialize(firsts, "firsts"), F.lit(96))
    decided = rows.withColumn("digest", digest).join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    decided = decided.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for part in C.slices(batch, "payload"):
                for row in zip(*(part.column(c).to_pylist() for c in ("id", "url", "payload", "first")), strict=True):
                    now = now or Package(where)
                    now.add(row[1] or "", page_record(*row)[1])
                    if now.size >= PACKAGE_BYTES:
                        done.append(now.close())
                        now = None
        if now:
            done.append(now.close())
        path, records, size = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    made = spark._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)
    return C.materialize(decided.mapInArrow(run, "path string, records long, bytes long"), "packages")


# --- Reading -----------------------------------------------------------------

Read = Callable[[int, int], bytes]  # bytes of a file from a place on


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int  # as stored
    header: int  # where its local header is

    def stored(self) -> bool:
        return self.method == 0 and not self.flags & 1  # neither deflated nor encrypted


def directory_place(read: Read, size: int) -> tuple[int, int, int]:
    """Where the central directory starts, its bytes, and how far all offsets are off (by what stands before the package)."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    else:
        raise ValueError("no end of a central directory: not a ZIP file")
    length, start = struct.unpack_from("<II", tail, at + 12)
    end = tail_at + at
    locator = read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":  # some writers add ZIP64 records that they don't need
        big = struct.unpack_from("<Q", locator, 8)[0]
        found = read(big, 56)
        if found[:4] != b"PK\x06\x06":  # something stands before the package
            big = end - 20 - 56
            found = read(big, 56)
        if found[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory where the locator says")
        length, start = struct.unpack_from("<QQ", found, 40)
        end = big
    off = end - length - start
    if off < 0:
        raise ValueError("the central directory reaches beyond its end")
    return start + off, length, off


def members(read: Read, size: int) -> Iterator[Member]:
    """The members that the central directory lists, read block by block."""
    at, left, off = directory_place(read, size)
    held = b""
    while left or held:
        while left and len(held) < 46 + 3 * 0xFFFF:
            more = read(at, min(left, BLOCK))
            at, left, held = at + len(more), left - len(more), held + more
            if not more:
                raise ValueError("the central directory ends early")
        while len(held) >= 46:
            if held[:4] != b"PK\x01\x02":
                raise ValueError("no entry of a central directory where there should be one")
            flags, method = struct.unpack_from("<HH", held, 8)
            packed, whole, n, x, c = struct.unpack_from("<IIHHH", held, 20)
            header = struct.unpack_from("<I", held, 42)[0]
            if len(held) < 46 + n + x + c:
                break
            extra, i = held[46 + n : 46 + n + x], 0
            while i + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, i)
                if kind == 1:  # ZIP64: in this order, those that don't fit 32 bits
                    big = iter(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                    whole, packed, header = (next(big) if v == 0xFFFFFFFF else v for v in (whole, packed, header))
                i += 4 + length
            yield Member(held[46 : 46 + n].decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, header + off)
            held = held[46 + n + x + c :]
        if held and not left and (len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28))):
            raise ValueError("the central directory ends early")


def data_start(read: Read, member: Member) -> int:
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def runs_of(read: Read, size: int, skip_packed: bool = False) -> Iterator[tuple[int, int, bool]]:
    """Runs of whole records (start and end in the file, and whether they are compressed), each of about RUN_BYTES.

    The index cuts an archive into runs if its places cover the archive without
    a gap; else the whole archive is one run.
    """
    found = list(members(read, size))
    archives = [m for m in found if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))]
    places: dict[str, list[tuple[int, int]]] = {}
    for m in found:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")) and m.stored():
            start = data_start(read, m)
            data = read(start, m.size)
            for line in (gzip.decompress(data) if m.name.endswith(".gz") else data).splitlines():
                at = line.find(b"{")
                if at >= 0:
                    x = json.loads(line[at:])
                    places.setdefault(x["filename"], []).append((int(x["offset"]), int(x["length"])))
    for m in archives:
        if not m.stored():
            if skip_packed:
                continue
            raise ValueError(f"{m.name} is deflated or encrypted, and can't be read by ranges")
        start, packed = data_start(read, m), m.name.endswith(".gz")
        spots = np.array(sorted(set(places.get(m.name.rpartition("/")[2], []))), np.int64).reshape(-1, 2)
        ends = spots.sum(1)
        if len(spots) == 0 or spots[0, 0] != 0 or ends[-1] != m.size or (spots[1:, 0] != ends[:-1]).any():
            spots, ends = np.array([[0, m.size]]), np.array([m.size])
        i = 0
        while i < len(spots):
            j = max(i + 1, int(np.searchsorted(ends, spots[i, 0] + RUN_BYTES, "right")))
            yield start + int(spots[i, 0]), start + int(ends[j - 1]), packed
            i = j


def records(read: Read, start: int, end: int, packed: bool) -> Iterator[bytes]:
    """The records between two places, one in memory at a time."""

    def blocks() -> Iterator[bytes]:
        for at in range(start, end, BLOCK):
            yield read(at, min(BLOCK, end - at))

    if packed:
        squeeze, out = zlib.decompressobj(31), []
        for data in blocks():
            while data:
                out.append(squeeze.decompress(data))
                data = squeeze.unused_data
                if squeeze.eof:
                    if whole := b"".join(out):
                        yield whole
                    squeeze, out = zlib.decompressobj(31), []
        if any(out):
            raise ValueError("a record ends early")
        return
    held, need = bytearray(), 0
    for data in blocks():
        held += data
        while len(held) >= need:
            while held[:2] == b"\r\n":
                del held[:2]
            at = held.find(b"\r\n\r\n")
            if at < 0:
                need = len(held) + 1
                break
            need = at + 4 + int(dict(fields(bytes(held[:at])))["content-length"])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("a record ends early")


def fields(head: bytes) -> Iterator[tuple[str, str]]:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        yield name.strip().lower(), value.strip()


def parsed(data: bytes) -> tuple:
    """Name, type, URI, date, payload bytes and digest, whether the digest is the one declared, name of the record referred to, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    got = dict(fields(head))
    block = rest[: int(got.get("content-length", 0))]
    told = got.get("warc-payload-digest", "").removeprefix("sha1:") or None
    bare = lambda name: got[name].strip("<>") if name in got else None
    kind, payload, n = got.get("warc-type"), block, len(block)
    if got.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = len(payload)
    if kind == "revisit":
        length = dict(fields(http)).get("content-length") if got.get("content-type", "").startswith("application/http") else None
        return bare("warc-record-id"), kind, bare("warc-target-uri"), got.get("warc-date"), int(length) if length else None, told, None, bare("warc-refers-to"), None
    digest = base32_sha1(payload)
    return bare("warc-record-id"), kind, bare("warc-target-uri"), got.get("warc-date"), n, digest, None if told is None else told == digest, None, payload


RECORD = T.StructType([T.StructField(n, k) for n, k in (("path", T.StringType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("target_uri", T.StringType()), ("date", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("sound", T.BooleanType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def opened(path: str) -> tuple[Read, int]:
    fs, name = pafs.FileSystem.from_uri(path)
    source = fs.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    return read, source.size()


def read_packages(packages: DataFrame, payload: bool = False, skip_packed: bool = False) -> DataFrame:
    """The records of packages (column ``path``): path, record_id, record_type, target_uri, date, payload_bytes, payload_digest, sound, refers_to and, if wanted, payload.

    Length and digest are computed from a response's payload (``sound``: the
    digest is the one declared, null if none is); of a revisit they are those
    declared. Members other than WARC archives and indexes are passed over. An
    archive that is not stored as it is raises an error, unless ``skip_packed``.
    Null paths are passed over. No packages give no records.
    """
    spark = packages.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                runs = list(runs_of(*opened(path), skip_packed))
                start, end, packed = zip(*runs, strict=True) if runs else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(packed, pa.bool_())], names=["path", "start", "end", "packed"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "packed")), strict=True):
                read, _ = opened(path)
                rows, held = [], 0
                for data in records(read, start, end, packed):
                    row = (path, *parsed(data))
                    rows.append(row if payload else row[:-1])
                    held += len(data) if payload else 256
                    if held >= RUN_BYTES:
                        yield shaped(rows)
                        rows, held = [], 0
                yield shaped(rows)
        C.give_back()

    schema = RECORD if payload else T.StructType(RECORD.fields[:-1])
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.binary()]

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema.fields)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=schema.names)

    runs = C.materialize(packages.where("path is not null").select("path").mapInArrow(find, "path string, start long, end long, packed boolean"), "runs")
    # A run is a few bytes to Spark and megabytes to read, so tasks are counted by runs.
    tasks = max(1, min(runs.count(), 100_000))
    return runs.repartition(tasks, "path", "start").mapInArrow(load, schema)


def page_of(name):
    """The page that a record's name is made of, null if of none."""
    found = F.when(name.startswith(PAGE), F.substring(name, len(PAGE) + 1, 1 << 30))
    return F.when(found != "", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Pages written to packages and read back: the id, payload_bytes, payload_digest, record_type and refers_to.

    See ``write_packages`` for revisits and nulls. Rows that repeat an id are
    records of their own. A page without an id comes back without one.
    """
    spark = pages.sparkSession
    packages = write_packages(pages, folder or f"{C.own_folder(spark)}/wacz-{uuid.uuid4().hex}", id_col, url_col, payload_col, least)
    kind = pages.schema[id_col].dataType
    found = read_packages(packages).where(F.col("record_type").isin("response", "revisit"))
    return found.select(page_of(F.col("record_id")).cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).cast(kind).alias("refers_to"))
