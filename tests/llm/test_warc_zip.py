"""Archives: a library reads what is written, ranges read what a library writes, ZIP64, damage, revisits."""

import glob
import hashlib
import io
import os
import struct
import zipfile

import pytest

from doseframe.llm import warc_zip as wz


class Memory:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, offset, length):
        assert 0 <= offset and offset + length <= self.size
        return self.data[offset:offset + length]


def archive(zip64, n=5):
    out = io.BytesIO()
    records = [(wz.record_bytes(i, f"http://x/{i}\r\nEvil: 1", b"p%d" % i * 50, hashlib.sha1(b"p%d" % i * 50).hexdigest(), None), f"k{i}") for i in range(n)]
    assert wz.write_archive(out, iter(records), zip64) == n
    return out.getvalue(), records


@pytest.mark.parametrize("zip64", [True, False])
def test_members_and_records(zip64):
    data, records = archive(zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == [wz.DATA, wz.INDEX] and z.testzip() is None
        whole = z.read(wz.DATA)
    found = wz.members(Memory(data))
    offset, size = found[wz.DATA]
    assert data[offset:offset + size] == whole
    lines = [x for part in wz.index_lines(Memory(data), *found[wz.INDEX]) for x in part]
    assert len(lines) == 5
    for i, line in enumerate(lines):
        _, at, n = line.split()
        raw = __import__("gzip").decompress(data[offset + int(at):offset + int(at) + int(n)])
        assert wz.parse_record(raw) == (i, 100, hashlib.sha1(b"p%d" % i * 50).hexdigest(), "response", None, b"p%d" % i * 50)


def test_zip64_directory_and_comment():
    """The end record's fields are full, the real ones stand in the ZIP64 record; a comment holds a false signature."""
    data, _ = archive(False)
    start, size, entries = wz.central_directory(Memory(data))
    end64 = struct.pack("<IQHHIIQQQQ", wz.END64, 44, 45, 45, 0, 0, entries, entries, size, start)
    locator = struct.pack("<IIQI", wz.END64_LOCATOR, 0, len(data) - wz.END_SIZE, 1)
    comment = b"note " + struct.pack("<I", wz.END) + b"PK"
    end = struct.pack("<IHHHHIIH", wz.END, 0, 0, wz.FULL16, wz.FULL16, wz.FULL32, wz.FULL32, len(comment)) + comment
    wide = Memory(data[:-wz.END_SIZE] + end64 + locator + end)
    assert wz.central_directory(wide) == (start, size, entries) and wz.members(wide) == wz.members(Memory(data))


def test_foreign_and_damaged_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"x" * 99, zipfile.ZIP_DEFLATED)
        z.writestr("é", b"stored", zipfile.ZIP_STORED)
    assert list(wz.members(Memory(out.getvalue()))) == ["é"]
    data, records = archive(True)
    with pytest.raises(ValueError):
        wz.central_directory(Memory(data[:-40]))
    with pytest.raises(ValueError):
        wz.central_directory(Memory(b""))
    raw = bytearray(__import__("gzip").decompress(records[0][0]))
    raw[-6] ^= 1
    with pytest.raises(ValueError):
        wz.parse_record(bytes(raw))


def test_round_trip_with_revisits(spark):
    big, other = "é" * 500, "y" * 999
    rows = [(1, "u1", big, 7), (2, "u2", big, 7), (9, "u9", big, 7), (9, "u9", big, 7), (3, None, other, 7), (4, "u4", other, 7), (5, "u5", None, 7), (6, "u6", "", 7), (None, "n", big, 7), (8, "u8", "z" * 300_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = [tuple(r) for r in wz.round_trip(df, "page_id", "url", "html").collect()]
    digest = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [
        (p, len((h or "").encode()), digest(h), "revisit" if h == big and p != 9 else "response", 9 if h == big and p != 9 else None) for p, _, h, _ in rows
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert wz.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_payloads_and_parts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"text {i} " * i) for i in range(200)], "page_id long, url string, html string")
    manifest = wz.write_archives(df, "page_id", "url", "html", str(tmp_path))
    assert sorted(os.path.basename(r.path) for r in manifest.collect()) == sorted(map(os.path.basename, glob.glob(f"{tmp_path}/*.wacz")))
    got = {r.page_id: bytes(r.payload).decode() for r in wz.read_archives(manifest, payloads=True).collect()}
    assert got == {i: f"text {i} " * i for i in range(200)}
