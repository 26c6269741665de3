"""WARC records in ZIP-packaged archives, read by ranges and never extracted.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member per record,
and `indexes/index.cdx`, one line per record with its offset and length in that member. The reader finds the
end record, follows the ZIP64 records, walks the central directory to the members, reads the index, and then
reads only the byte ranges of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from doseframe.session import scratch_path, staged

# Payloads from this size on are written once and revisited.
REVISIT_FROM = 1_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
SALTS = 16
# Index bytes of one task's share of an archive, and bytes of a range that is read at once.
INDEX_CHUNK, RANGE = 1 << 20, 4 << 20
# Signatures and sizes of the ZIP records.
END, END_SIZE, END64_LOCATOR, LOCATOR_SIZE, END64, CENTRAL, LOCAL = 0x06054B50, 22, 0x07064B50, 20, 0x06064B50, 0x02014B50, 0x04034B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# --- writing -----------------------------------------------------------------------------------------------

def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the payload's length and digest, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


class _Counted(io.RawIOBase):
    """A stream that cannot be sought, as object stores give."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(data)
        return len(data)


def write_archive(stream, records: Iterator[tuple[bytes, str]], zip64: bool = True) -> int:
    """Writes records (gzip member, index key) as one archive and returns their number.

    Only the index lines of one archive are held in memory. `zip64` allows members and offsets beyond 4 GB.
    """
    day = (1980, 1, 1, 0, 0, 0)
    lines, at = [], 0
    with zipfile.ZipFile(_Counted(stream), "w", zipfile.ZIP_STORED, allowZip64=zip64) as archive:
        with archive.open(zipfile.ZipInfo(DATA, day), "w", force_zip64=zip64) as member:
            for data, key in records:
                member.write(data)
                lines.append(b"%s %d %d\n" % (key.encode(), at, len(data)))
                at += len(data)
        with archive.open(zipfile.ZipInfo(INDEX, day), "w", force_zip64=zip64) as member:
            for line in lines:
                member.write(line)
    return len(lines)


def write_archives(pages: DataFrame, key: str, url: str, html: str, folder: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes a record for every row into archives below `folder` (shared by all executors); returns (path, records).

    Of rows with equal payloads of at least `revisit_from` bytes those with the largest key are responses,
    the others revisit it; null keys revisit, too, and get an empty record id. A null payload is empty.
    The owners of shared payloads are found from digests alone; rows are then joined with salted copies of
    them, so that a payload that very many pages share is not gathered in one task.

    A task writes its archive under a name of its own and moves it into place, so a task that runs again
    replaces whole archives only.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int"))
    big = rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest").agg(F.max("page").alias("owner"), F.count("*").alias("n"))
    big = big.where("n > 1 and owner is not null")
    copies = big.select("digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    refers = F.when(~F.col("page").eqNullSafe(F.col("owner")), F.col("owner"))
    linked = rows.join(copies, ["digest", "salt"], "left").select("page", "url", "payload", "digest", refers.alias("refers"))
    # Records in the order of their keys within an archive.
    linked = linked.sortWithinPartitions("page")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith(("file:", "/")) else f"file://{folder}")
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}.wacz"
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"

        def records():
            def of(batch):
                for page, link, data, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record_bytes(page, link, data, digest, refers_to), digest
            yield from of(first)
            for batch in batches:
                yield from of(batch)

        with system.open_output_stream(own) as stream:
            n = write_archive(stream, records())
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return staged(linked.mapInArrow(write, "path string, records long"), "manifest")


# --- reading -----------------------------------------------------------------------------------------------

class Ranges:
    """Reads byte ranges of one file of a file system."""

    def __init__(self, path: str):
        self.system, self.path = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.file = self.system.open_input_file(self.path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset) if length else b""
        if len(data) != length:
            raise ValueError(f"{self.path}: {length} bytes at {offset} lie outside the file")
        return bytes(data)

    def close(self) -> None:
        self.file.close()


def central_directory(source) -> tuple[int, int, int]:
    """Offset, size and entries of the central directory, from the end record or the ZIP64 one it points to."""
    tail_size = min(source.size, END_SIZE + FULL16)
    tail = source.read(source.size - tail_size, tail_size)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0:
        if at + END_SIZE <= len(tail):
            _, _, _, _, entries, size, offset, comment = struct.unpack_from("<IHHHHIIH", tail, at)
            if at + END_SIZE + comment == len(tail):
                break
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive, or cut off")
    if FULL16 not in (entries,) and FULL32 not in (size, offset):
        return offset, size, entries
    place = source.size - tail_size + at - LOCATOR_SIZE
    if place >= 0:
        signature, _, end64, _ = struct.unpack("<IIQI", source.read(place, LOCATOR_SIZE))
        if signature == END64_LOCATOR:
            signature, _, _, _, _, _, _, entries, size, offset = struct.unpack("<IQHHIIQQQQ", source.read(end64, 56))
            if signature != END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
            return offset, size, entries
    return offset, size, entries


def members(source) -> dict[str, tuple[int, int]]:
    """Offset and size of the data of every stored member, by name; compressed members are left out."""
    start, size, entries = central_directory(source)
    data, out, at = source.read(start, size), {}, 0
    for _ in range(entries):
        (signature, _, _, flags, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _, local) = struct.unpack_from(
            "<IHHHHHHIIIHHHHHII", data, at
        )
        if signature != CENTRAL:
            raise ValueError("the central directory is damaged")
        name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that are full above, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                full = next(wide) if full == FULL32 else full
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            extra = extra[4 + n:]
        if method == 0 and packed == full:
            head = source.read(local, 30)
            signature, n_name, n_extra = struct.unpack("<I", head[:4])[0], *struct.unpack("<HH", head[26:30])
            if signature != LOCAL:
                raise ValueError(f"{name}: no local header where the directory says")
            out[name] = (local + 30 + n_name + n_extra, packed)
    return out


def index_lines(source, offset: int, size: int) -> Iterator[list[bytes]]:
    """The lines of an index member, a bounded number of bytes at a time."""
    rest, at = b"", 0
    while at < size:
        n = min(INDEX_CHUNK, size - at)
        *lines, rest = (rest + source.read(offset + at, n)).split(b"\n")
        at += n
        yield lines
    if rest:
        yield [rest]


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page, payload bytes, payload digest, type, refers_to, payload of one record; a response's payload is
    measured and hashed here and must agree with its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its header")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return number("WARC-Record-ID"), length, digest, kind, number("WARC-Refers-To"), payload


def record_ranges(paths: DataFrame) -> DataFrame:
    """(path, ranges) of archives' records (column path): runs of neighbouring records of about RANGE bytes, from
    the archives' own directories and indexes."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source = Ranges(path)
                found = members(source)
                if DATA in found and INDEX in found:
                    base = found[DATA][0]
                    start, lengths, total, next_at = 0, [], 0, None
                    for lines in index_lines(source, *found[INDEX]):
                        for line in lines:
                            _, at, size = line.split()
                            at, size = int(at), int(size)
                            if lengths and (total + size > RANGE or at != next_at):
                                yield pa.RecordBatch.from_pydict({"path": [path], "start": [base + start], "lengths": [lengths]}, schema=schema)
                                lengths, total = [], 0
                            if not lengths:
                                start = at
                            lengths.append(size)
                            total += size
                            next_at = at + size
                    if lengths:
                        yield pa.RecordBatch.from_pydict({"path": [path], "start": [base + start], "lengths": [lengths]}, schema=schema)
                source.close()

    return paths.select("path").mapInArrow(locate, "path string, start long, lengths array<long>")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload) of every record.

    Archives without the two members give no rows; a damaged one raises. Ranges are dealt out evenly,
    so that one large archive is read by many tasks.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    keep = len(names) - (not payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                source = Ranges(path)
                data, at, rows = source.read(start, sum(lengths)), 0, []
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(data[at:at + n], 31))[:keep])
                    at += n
                source.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[:keep])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    spread = staged(record_ranges(paths), "ranges")
    return spread.repartition(F.xxhash64("path", "start")).mapInArrow(read, schema)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    return scratch_path(spark, "archives")


def round_trip(pages: DataFrame, key: str, url: str, html: str, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Writes all rows to archives in the shared folder and reads them back."""
    manifest = write_archives(pages, key, url, html, archive_folder(pages.sparkSession), revisit_from)
    return read_archives(manifest)
