"""Metadata of picture files from their headers, as a Spark data source.

``spark.read.format("picture_headers").option("path", folder)`` lists a folder on the driver, deals the files out, and
lets each task read the first segments of its files: sizes, orientation, camera and time of JPEG and TIFF files (both
byte orders), sizes of PNG, WebP and BMP files, and the tags that PNG and WebP carry. No picture is read whole. Filters
on extension, size and modification time are taken over, so files that they rule out aren't opened, where the session
sets ``spark.sql.python.filterPushdown.enabled``. A torn header gives nulls.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from kinlight.functions.text import camera, taken_time

SCHEMA = "path string, extension string, size long, modified long, width int, height int, orientation int, make string, model string, original string, digitised string, bytes_read long"
FILES_A_PARTITION = 1000
#: Most bytes of a block of tags that are read.
MOST_TAGS = 1 << 16

# Fixed values of the formats: tags of a directory, and the bytes of a value by its type.
WIDTH, HEIGHT, MAKE, MODEL, ORIENTATION, SUB_DIRECTORY, ORIGINAL, DIGITISED = 0x100, 0x101, 0x10F, 0x110, 0x112, 0x8769, 0x9003, 0x9004
NAMES = {WIDTH: "width", HEIGHT: "height", MAKE: "make", MODEL: "model", ORIENTATION: "orientation", ORIGINAL: "original", DIGITISED: "digitised"}
VALUE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1}

Read = Callable[[int, int], bytes]


def _directory(read: Read, at: int, order: str, found: dict, deep: bool = True) -> None:
    """The tags of one directory of a TIFF structure that ``read`` is relative to."""
    (n,) = struct.unpack(f"{order}H", read(at, 2))
    entries = read(at + 2, 12 * n)
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(f"{order}HHI4s", entries, 12 * i)
        if tag == SUB_DIRECTORY and deep:
            _directory(read, struct.unpack(f"{order}I", value)[0], order, found, False)
        elif tag in NAMES and kind in VALUE_BYTES:
            size = VALUE_BYTES[kind] * count
            raw = value[:size] if size <= 4 else read(struct.unpack(f"{order}I", value)[0], min(size, MOST_TAGS))
            if kind in (2, 7):
                found[NAMES[tag]] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif count == 1:
                found[NAMES[tag]] = int.from_bytes(raw, "little" if order == "<" else "big")


def tiff_tags(read: Read) -> dict:
    order = {b"II": "<", b"MM": ">"}[read(0, 2)]
    magic, first = struct.unpack(f"{order}HI", read(2, 6))
    if magic != 42:
        raise ValueError("not a TIFF structure")
    found: dict = {}
    _directory(read, first, order, found)
    return found


def _within(data: bytes) -> Read:
    def read(at: int, n: int) -> bytes:
        if at + n > len(data):
            raise ValueError("tags end early")
        return data[at : at + n]

    return read


def _tags_of(data: bytes) -> dict:
    """Tags beside a picture's own header: all but sizes, which that header has."""
    try:
        found = tiff_tags(_within(data.removeprefix(b"Exif\0\0")))
    except (ValueError, KeyError, struct.error):
        return {}
    return {k: v for k, v in found.items() if k not in ("width", "height")}


def _jpeg(read: Read) -> dict:
    at, found = 2, {}
    while True:
        mark, kind, size = struct.unpack(">BBH", read(at, 4))
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xE1 and "orientation" not in found and read(at + 4, min(6, size - 2)) == b"Exif\0\0":
            found = _tags_of(read(at + 4, size - 2)) | found
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", read(at + 5, 4))
            return found | {"width": width, "height": height}
        elif kind == 0xDA:
            raise ValueError("no frame before the scan")
        at += 2 + size


def _png(read: Read) -> dict:
    width, height = struct.unpack(">II", read(16, 8))
    at, found = 33, {"width": width, "height": height}
    try:
        while (chunk := struct.unpack(">I4s", read(at, 8)))[1] not in (b"IDAT", b"IEND"):
            if chunk[1] == b"eXIf":
                return _tags_of(read(at + 8, min(chunk[0], MOST_TAGS))) | found
            at += 12 + chunk[0]
    except (ValueError, struct.error):
        pass
    return found


def _webp(read: Read) -> dict:
    kind = read(12, 4)
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", read(26, 4))
        return {"width": width & 0x3FFF, "height": height & 0x3FFF}
    if kind == b"VP8L":
        bits = int.from_bytes(read(21, 4), "little")
        return {"width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1}
    if kind != b"VP8X":
        raise ValueError("unknown WebP")
    size = read(24, 6)
    found = {"width": int.from_bytes(size[:3], "little") + 1, "height": int.from_bytes(size[3:], "little") + 1}
    at = 30
    try:
        while True:
            name, n = struct.unpack("<4sI", read(at, 8))
            if name == b"EXIF":
                return _tags_of(read(at + 8, min(n, MOST_TAGS))) | found
            at += 8 + n + n % 2
    except (ValueError, struct.error):
        return found


def _bmp(read: Read) -> dict:
    width, height = struct.unpack("<ii", read(18, 8))
    return {"width": width, "height": abs(height)}


def header(read: Read) -> dict:
    """width, height, orientation, make, model, original and digitised, as far as a picture's header has them; sizes are
    as stored. Nothing for files of another kind and for torn headers."""
    try:
        start = read(0, 12)
        if start[:2] == b"\xff\xd8":
            return _jpeg(read)
        if start[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(read)
        if start[:4] == b"RIFF" and start[8:] == b"WEBP":
            return _webp(read)
        if start[:2] == b"BM":
            return _bmp(read)
        if start[:4] in (b"II*\0", b"MM\0*"):
            return tiff_tags(read)
    except (ValueError, KeyError, OSError, struct.error):
        pass
    return {}


def header_of_file(path: str) -> tuple[dict, int]:
    """A file's header, and how many bytes of the file were read for it."""
    total = 0
    with open(path, "rb", buffering=0) as f:

        def read(at: int, n: int) -> bytes:
            nonlocal total
            f.seek(at)
            data = f.read(n)
            total += len(data)
            if len(data) < n:
                raise ValueError("the file ends early")
            return data

        return header(read), total


@dataclass
class Files(InputPartition):
    """Files of one task: (path, extension, size, modified in seconds)."""

    rows: list[tuple[str, str, int, int]]


_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
_LISTED = {("extension",): 1, ("size",): 2, ("modified",): 3}


class HeaderReader(DataSourceReader):
    def __init__(self, root: str, at_once: int) -> None:
        self.root, self.at_once, self.tests = root, at_once, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in _LISTED:
                self.tests.append((_LISTED[f.attribute], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _listed(self) -> Iterator[tuple[str, str, int, int]]:
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if not d.startswith("."))
            for name in sorted(n for n in names if not n.startswith(".")):
                path = os.path.join(folder, name)
                state = os.stat(path)
                row = (path, os.path.splitext(name)[1].lower(), state.st_size, int(state.st_mtime))
                if all(_TESTS[kind](row[i], value) for i, kind, value in self.tests):
                    yield row

    def partitions(self) -> list[Files]:
        rows = list(self._listed())
        return [Files(rows[i : i + self.at_once]) for i in range(0, len(rows), self.at_once)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        names = ["width", "height", "orientation", "make", "model", "original", "digitised"]
        for path, extension, size, modified in partition.rows:
            try:
                found, n = header_of_file(path)
            except OSError:
                found, n = {}, 0
            yield (path, extension, size, modified, *(found.get(c) for c in names), n)


class PictureHeaders(DataSource):
    """Options: ``path``, the folder, and ``filesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "picture_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options["path"], int(self.options.get("filesPerPartition", FILES_A_PARTITION)))


def picture_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The source's rows, registered for this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PictureHeaders)
    return spark.read.format("picture_headers").option("path", folder).load()


def metadata(headers: DataFrame) -> DataFrame:
    """path, width and height as seen upright, orientation (1 if unknown), taken_utc and camera of the source's rows."""
    from kinlight.functions.geometry import upright_size

    size = upright_size(F.col("width"), F.col("height"), F.col("orientation"))
    return headers.select("path", size["width"].alias("width"), size["height"].alias("height"), F.coalesce("orientation", F.lit(1)).alias("orientation"), taken_time(F.col("original"), F.col("digitised")).alias("taken_utc"), camera(F.col("make"), F.col("model")).alias("camera"))
