"""Files as rows: listing, stat, decoding through pluggable decoders, and binary codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlight.functions.text import decoder_of, file_name, supported

#: The listing's columns; file contents are never read for it.
LISTING = "path string, length long, modificationTime timestamp"


def list_files(spark: SparkSession, root: str, recursive: bool = True, only_supported: bool = True) -> DataFrame:
    """path, length and modificationTime of the files below a folder: hidden ones (a leading dot or
    underscore) are left out, and files that go meanwhile are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    found = reader.load(root if recursive else f"{root.rstrip('/')}/*.*").select("path", "length", "modificationTime")
    return found.filter(supported("path")) if only_supported else found


def stat_file(spark: SparkSession, path: str) -> DataFrame:
    """The row of one file; none if it doesn't exist."""
    folder, _, name = path.rpartition("/")
    found = spark.read.format("binaryFile").option("pathGlobFilter", name).option("ignoreMissingFiles", "true").load(folder or ".")
    return found.select("path", "length", "modificationTime").filter(file_name("path") == name)


def folder_bytes(spark: SparkSession, root: str) -> DataFrame:
    """The total size of a folder's files."""
    return list_files(spark, root, only_supported=False).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


#: What a decoder returns: width, height, bytes a row, pixel format and pixels, or None.
Decoder = Callable[[bytes, int | None], tuple[int, int, int, str, bytes] | None]
DECODED = "path string, width int, height int, stride int, format string, pixels binary"


def decode_images(files: DataFrame, decoders: dict[str, Decoder], long_edge: int | None = None) -> DataFrame:
    """Decode ``files(path, content)`` by the decoder that each extension names, a batch at a time.

    ``decoders`` maps ``raster`` and ``heif`` to functions, which shrink to ``long_edge`` themselves. What no
    decoder reads has null pixels, so that failures can be recorded.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, kind in zip(batch["path"], batch["content"], batch["decoder"], strict=True):
                made = None
                if kind in decoders and content is not None:
                    try:
                        made = decoders[kind](bytes(content), long_edge)
                    except (ValueError, OSError):
                        made = None
                rows.append((path, *(made or (None, None, None, None, None))))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "stride", "format", "pixels"])

    return files.select("path", "content", decoder_of("path").alias("decoder")).mapInPandas(decode, DECODED)


METADATA = "width int, height int, orientation int, taken_utc timestamp, camera string"


def read_metadata(files: DataFrame, reader: Callable[[bytes], dict | None]) -> DataFrame:
    """Image metadata of ``files(path, content)`` by an injected tag reader that returns raw tags: width,
    height, orientation, make, model, original and digitised. Null where it fails."""
    from kinlight.functions.geometry import upright_size
    from kinlight.functions.text import camera, taken_time

    names = ["width", "height", "orientation", "make", "model", "original", "digitised"]

    @F.pandas_udf("width int, height int, orientation int, make string, model string, original string, digitised string")
    def tags(contents: pd.Series) -> pd.DataFrame:
        def one(content: bytes | None) -> dict:
            try:
                return (reader(bytes(content)) if content is not None else None) or {}
            except (ValueError, OSError):
                return {}

        return pd.DataFrame([[t.get(n) for n in names] for t in map(one, contents)], columns=names)

    t = files.select("path", tags("content").alias("t"))
    size = upright_size(F.col("t.width"), F.col("t.height"), F.col("t.orientation"))
    return t.select("path", size["width"].alias("width"), size["height"].alias("height"), F.coalesce("t.orientation", F.lit(1)).alias("orientation"), taken_time(F.col("t.original"), F.col("t.digitised")).alias("taken_utc"), camera(F.col("t.make"), F.col("t.model")).alias("camera"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary as an array."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """An array of floats as little-endian bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_uuid(blob: Column | str) -> Column:
    """16 big-endian bytes as a UUID string."""
    h = F.lower(F.hex(blob))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
