"""Headers of made files: sizes, tags, bytes read, torn files, filters."""

import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinlight.sources import headers


def tiff(order, tags, sub=()):
    """A TIFF structure with (tag, type, value) entries and a sub-directory of more."""
    def block(entries, at, link=None):
        entries = [*entries, *([(0x8769, 4, link)] if link else [])]
        data, heap = b"", b""
        end = at + 2 + 12 * len(entries) + 4
        for tag, kind, value in sorted(entries):
            raw = value.encode() + b"\0" if kind == 2 else struct.pack(order + {3: "H", 4: "I"}[kind], value)
            count = len(raw) if kind == 2 else 1
            if len(raw) > 4:
                data += struct.pack(order + "HHII", tag, kind, count, end + len(heap))
                heap += raw
            else:
                data += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return struct.pack(order + "H", len(entries)) + data + b"\0\0\0\0" + heap

    one = block(tags, 8, 1 if sub else None)
    main = block(tags, 8, 8 + len(one)) if sub else one
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + main + (block(sub, 8 + len(main)) if sub else b"")


TAGS = [(0x112, 3, 6), (0x10F, 2, "Acme"), (0x110, 2, "Acme X1")]
TIMES = [(0x9003, 2, "2021:02:03 04:05:06"), (0x9004, 2, "2020:01:01 00:00:00")]


def jpeg(order="<", frame=0xC0, tags=True, picture=200_000):
    exif = b"Exif\0\0" + tiff(order, TAGS, TIMES)
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif if tags else b""
    other = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xdb" + struct.pack(">H", 67) + b"\0" * 65
    return b"\xff\xd8" + other + app + bytes([0xFF, frame]) + struct.pack(">HBHHB", 11, 8, 300, 400, 1) + b"\0" * 3 + b"\xff\xda" + b"\0" * picture


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(tags=False):
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 31, 41, 8, 2, 0, 0, 0))
    return head + (chunk(b"eXIf", tiff(">", TAGS, TIMES)) if tags else b"") + chunk(b"IDAT", b"\0" * 9000) + chunk(b"IEND", b"")


def webp(kind):
    body = {"VP8 ": b"\0" * 3 + b"\x9d\x01\x2a" + struct.pack("<HH", 50, 60), "VP8L": b"\x2f" + struct.pack("<I", 49 | 59 << 14), "VP8X": b"\0" * 4 + (49).to_bytes(3, "little") + (59).to_bytes(3, "little")}[kind]
    data = kind.encode() + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    if kind == "VP8X":
        exif = tiff("<", [(0x112, 3, 8)])
        data += b"VP8 " + struct.pack("<I", 3000) + b"\0" * 3000 + b"EXIF" + struct.pack("<I", len(exif)) + exif
    return b"RIFF" + struct.pack("<I", len(data) + 4) + b"WEBP" + data


FILES = {
    "a/little.jpg": jpeg("<"), "a/big.JPG": jpeg(">", 0xC2), "a/bare.jpeg": jpeg(tags=False), "b/plain.png": png(), "b/tagged.png": png(True), "b/lossy.webp": webp("VP8 "),
    "b/lossless.webp": webp("VP8L"), "b/extended.webp": webp("VP8X"), "b/up.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 70, -80) + b"\0" * 500,
    "b/scan.tif": tiff(">", [*TAGS, (0x100, 4, 90), (0x101, 3, 95)], TIMES[1:]), "torn.jpg": jpeg()[:120], "empty.jpg": b"", "text.txt": b"just words", ".hidden.jpg": jpeg(),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    for name, data in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_metadata(spark, folder):
    found = {r.path.removeprefix(f"{folder}/"): tuple(r)[1:] for r in headers.metadata(headers.picture_headers(spark, folder)).collect()}
    taken, digitised = datetime(2021, 2, 3, 4, 5, 6), datetime(2020, 1, 1)
    assert found == {
        "a/little.jpg": (300, 400, 6, taken, "Acme X1"), "a/big.JPG": (300, 400, 6, taken, "Acme X1"), "a/bare.jpeg": (400, 300, 1, None, None), "b/plain.png": (31, 41, 1, None, None),
        "b/tagged.png": (41, 31, 6, taken, "Acme X1"), "b/lossy.webp": (50, 60, 1, None, None), "b/lossless.webp": (50, 60, 1, None, None), "b/extended.webp": (60, 50, 8, None, None),
        "b/up.bmp": (70, 80, 1, None, None), "b/scan.tif": (95, 90, 6, digitised, "Acme X1"), "torn.jpg": (None, None, 1, None, None), "empty.jpg": (None, None, 1, None, None), "text.txt": (None, None, 1, None, None),
    }


def test_only_headers_of_wanted_files_are_read(spark, folder):
    rows = headers.picture_headers(spark, folder)
    total = rows.agg(F.sum("bytes_read")).first()[0]
    assert total < 5000 < sum(map(len, FILES.values())) and rows.filter("path LIKE '%little%'").first().bytes_read < 1000
    reader = headers.HeaderReader(folder, 2)
    left = list(reader.pushFilters([headers.EqualTo(("extension",), ".png"), headers.GreaterThan(("size",), 9200), headers.EqualTo(("width",), 3)]))
    assert [f.attribute for f in left] == [("width",)] and [len(p.rows) for p in reader.partitions()] == [1]
    few = rows.filter("extension = '.png' and size > 9200")
    assert few.count() == 1 and rows.filter("extension = '.gif'").count() == 0


def test_cut_anywhere():
    for data in FILES.values():
        for n in range(0, min(len(data), 400), 7):
            assert isinstance(headers.header(headers._within(data[:n])), dict)
