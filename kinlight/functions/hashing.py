"""Perceptual and content hashes as column expressions.

A perceptual hash is two longs that hold 64 bits each: of a 9 x 8 grid, whether a cell is brighter than its
right neighbour, and of an 8 x 8 grid, whether it is brighter than the mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes taken from each end of a file for its content hash.
SAMPLE_BYTES = 64 * 1024
#: Greatest distance of pictures that count as alike, and greatest time between their captures.
ALIKE_BITS, ALIKE_SECONDS = 12, 120


def _word(bits: list[Column]) -> Column:
    """64 booleans as a long, the first in the lowest bit."""
    parts = [F.when(b, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, b in enumerate(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def gradient_hash(grid: Column | str, columns: int = 9, rows: int = 8) -> Column:
    """Bits of a row-major grid: brighter than the right neighbour."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    return _word([F.get(grid, F.lit(y * columns + x)) > F.get(grid, F.lit(y * columns + x + 1)) for y in range(rows) for x in range(columns - 1)])


def ring_gradient_hash(grid: Column | str) -> Column:
    """For a flat grid of 64 cells: brighter than the next cell, the last one's next being the first."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    return _word([F.get(grid, F.lit(i)) > F.get(grid, F.lit((i + 1) % 64)) for i in range(64)])


def brightness_hash(grid: Column | str) -> Column:
    """Bits of a grid of 64 cells: brighter than their mean."""
    grid = F.col(grid) if isinstance(grid, str) else grid
    mean = F.aggregate(grid, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double")) / 64
    return _word([F.get(grid, F.lit(i)).cast("double") > mean for i in range(64)])


def hamming(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Differing bits, 0 to 128, of two hashes of two words each."""
    return (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))).cast("int")


def hash_hex(gradient: Column, brightness: Column) -> Column:
    """32 upper-case hex digits."""
    return F.concat(F.lpad(F.hex(gradient), 16, "0"), F.lpad(F.hex(brightness), 16, "0"))


def within(a: Column, b: Column, seconds: float | None) -> Column:
    """Whether two times lie within a window; an unknown time, or no window, passes."""
    if seconds is None:
        return F.lit(True)
    return a.isNull() | b.isNull() | (F.abs(F.unix_micros(a) - F.unix_micros(b)) <= int(seconds * 1_000_000))


def content_hash(content: Column | str) -> Column:
    """A digest of a binary's length, its head and its tail, as upper-case hex: cheap on large files and
    enough to tell files apart."""
    content = F.col(content) if isinstance(content, str) else content
    n = F.octet_length(content)
    tail = F.when(n > SAMPLE_BYTES, F.substring(content, -SAMPLE_BYTES, SAMPLE_BYTES)).otherwise(F.lit(b""))
    return F.upper(F.sha2(F.concat(F.encode(n.cast("string"), "UTF-8"), F.lit(b":"), F.substring(content, 1, SAMPLE_BYTES), tail), 256))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def cell(i: Column, cells: int, size: Column) -> Column:
    """Which of ``cells`` equal parts of 0 to size - 1 holds i."""
    return F.least(F.lit(cells - 1), F.floor(i * cells / size).cast("int"))
