"""Names, paths and captions as column expressions. Case is folded for ASCII letters only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NAME = 100
MAX_FOLDER = 120
#: Extensions that can be decoded (fixed values).
DECODABLE = [".jpg", ".jpeg", ".jpe", ".png", ".webp", ".bmp", ".tif", ".tiff"]
DECODABLE_HEIF = [".heic", ".heif"]
#: Names that some systems reserve whatever extension follows (fixed values).
RESERVED = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_case(c: Column | str) -> Column:
    """A to Z as a to z; other letters stay."""
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def contains_text(c: Column | str, fragment: str) -> Column:
    """Whether ``fragment`` occurs literally, ignoring ASCII case; a blank fragment occurs nowhere."""
    if not fragment.strip():
        return F.lit(False)
    return F.contains(fold_case(c), F.lit(fragment.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))


def like_pattern(fragment: str) -> str:
    """A LIKE pattern, with escape character backslash, for a literal substring."""
    for special in "\\%_":
        fragment = fragment.replace(special, "\\" + special)
    return f"%{fragment}%"


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def parent(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column | str) -> Column:
    """The last extension in lower case with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def canonical(path: Column | str) -> Column:
    """Forward slashes, without repeated, ``.`` and ``..`` segments and without a trailing one."""
    p = F.regexp_replace(F.translate(_col(path), "\\", "/"), "/+", "/")
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == "..") & rooted, acc).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def inside(path: Column, root: Column, itself: bool = True) -> Column:
    """Whether a path lies in a folder, by whole segments and ignoring case."""
    p, r = fold_case(path), F.rtrim(fold_case(root), F.lit("/"))
    under = p.startswith(F.concat(r, F.lit("/")))
    return under | (p == r) if itself else under


def supported(path: Column | str) -> Column:
    return extension(path).isin(DECODABLE + DECODABLE_HEIF)


def decoder_of(path: Column | str) -> Column:
    """The first decoder that can read a file; null if none can."""
    return F.when(extension(path).isin(DECODABLE), F.lit("raster")).when(extension(path).isin(DECODABLE_HEIF), F.lit("heif"))


def valid_name(name: Column | str) -> Column:
    """The trimmed name; null if it is blank or too long."""
    trimmed = F.regexp_replace(_col(name), r"^\s+|\s+$", "")
    return F.when((F.char_length(trimmed) > 0) & (F.char_length(trimmed) <= MAX_NAME), trimmed)


def folder_name(name: Column | str) -> Column:
    """A name that is safe as one folder on any system."""
    safe = F.regexp_replace(F.coalesce(_col(name), F.lit("")), r'[\x00-\x1f"<>|:*?\\/]', "_")
    cleaned = F.regexp_replace(F.regexp_replace(safe, r"^\s+|\s+$", ""), r"[. ]+$", "")
    base = F.regexp_replace(cleaned, r"\.[^.]*$", "")
    guarded = F.when(F.upper(base).isin(RESERVED), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)
    short = F.when(F.char_length(guarded) > MAX_FOLDER, F.regexp_replace(F.substring(guarded, 1, MAX_FOLDER), r"[. ]+$", "")).otherwise(guarded)
    return F.when(cleaned == "", F.lit("Unnamed")).otherwise(short)


def natural_key(c: Column | str) -> list[Column]:
    """Sort keys that order digit runs by value: case is ignored, leading zeros only break ties."""
    c = _col(c)
    tokens = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(t: Column) -> Column:
        digits = F.regexp_replace(t, r"^0+(?=\d)", "")
        # a run sorts by its length, then its digits; any length works
        return F.when(t.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(F.char_length(digits).cast("string"), 6, "0"), digits)).otherwise(F.lower(t))

    return [F.array_join(F.transform(tokens, key), ""), F.char_length(c), c]


def camera(make: Column, model: Column) -> Column:
    """The model, after the make unless it already begins with it; whichever is known."""
    a, b = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    return F.when(b.isNull(), a).when(a.isNull() | F.lower(b).startswith(F.lower(a)), b).otherwise(F.concat_ws(" ", a, b))


def taken_time(original: Column, digitised: Column) -> Column:
    """The capture time of two tags, read as UTC; null if neither parses."""
    pattern = "yyyy:MM:dd HH:mm:ss"
    return F.coalesce(F.try_to_timestamp(original, F.lit(pattern)), F.try_to_timestamp(digitised, F.lit(pattern)))


def _decimals(value: Column, places: int) -> Column:
    return F.format_number(value, places)


def byte_size(n: Column | str) -> Column:
    """A size for people: bytes, KB, MB to one place, GB to two."""
    n = _col(n)
    return (
        F.when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" B")))
        .when(n < 1024**2, F.concat(_decimals(n / 1024, 0), F.lit(" KB")))
        .when(n < 1024**3, F.concat(_decimals(n / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(_decimals(n / 1024**3, 2), F.lit(" GB")))
    )


def _fixed(value: Column, places: int) -> Column:
    """Fixed places without separators; of two equally near values the even one, as printf has it (Java's formatter
    rounds halves up)."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places if places else "0"))


def byte_size_short(n: Column | str) -> Column:
    """A size for a summary: whole KB and MB, GB to one place."""
    n = _col(n)
    return (
        F.when(n >= 1024**3, F.concat(_fixed(n / 1024**3, 1), F.lit(" GB")))
        .when(n >= 1024**2, F.concat(_fixed(n / 1024**2, 0), F.lit(" MB")))
        .when(n >= 1024, F.concat(_fixed(n / 1024, 0), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def byte_size_tile(n: Column | str) -> Column:
    """A size for a tile: MB to one place, whole KB, or bytes."""
    n = _col(n)
    return F.when(n >= 1024**2, F.concat(_fixed(n / 1024**2, 1), F.lit(" MB"))).when(n >= 1024, F.concat(_fixed(n / 1024, 0), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def percentage(share: Column) -> Column:
    return F.concat(_fixed(share * 100, 0), F.lit("%"))


def uuid7(at: Column | None = None) -> Column:
    """A new UUID of version 7: milliseconds of ``at`` (now, if None), then random bits."""
    ms = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp() if at is None else at)), 12, "0"))
    rest = F.expr("uuid()")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 16, 21))


def initial(name: Column | str) -> Column:
    """The first letter in upper case."""
    return F.upper(F.substring(_col(name), 1, 1))


def counted(n: Column, one: str, many: str) -> Column:
    """``1 photo``, ``2 photos``."""
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def progress(done: Column, total: Column) -> Column:
    """The share done between 0 and 1; null without a total."""
    return F.when(total > 0, F.least(F.greatest(done / total, F.lit(0.0)), F.lit(1.0)))


def shard_path(root: str, hex_id: Column) -> Column:
    """``root/ab/abcdef.jpg``: files by the first two digits of their id."""
    return F.concat_ws("/", F.lit(root), F.substring(hex_id, 1, 2), F.concat(hex_id, F.lit(".jpg")))


def uuid7_time(hex_id: Column) -> Column:
    """The time in the first 48 bits of a version 7 UUID in hex."""
    return F.timestamp_millis(F.conv(F.substring(F.regexp_replace(hex_id, "-", ""), 1, 12), 16, 10).cast("bigint"))
