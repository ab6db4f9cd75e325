"""Image scans: listing without reading, decoding by the JVM's readers, orientation from photo tags."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lumidisc.raster.kernels import orient
from lumidisc.session import ship

# Suffixes of image files.
SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")
SCHEMA = "path string, height int, width int, channels int, data binary"


def plain(path: Column) -> Column:
    """A local path without its scheme; others stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def find_images(spark: SparkSession, source: str, recursive: bool = False) -> DataFrame:
    """path, relative and length of the image files below ``source``; the scan never reads contents. Hidden files and anything below a folder named outputs stay out."""
    return _images_of(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(source), source)


def new_images(spark: SparkSession, source: str, recursive: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of files that its checkpoint doesn't know yet, whatever their age."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", str(recursive).lower())
    return _images_of(found.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "365000d").load(source), source)


def _images_of(files: DataFrame, source: str) -> DataFrame:
    listed = files.select(plain(F.col("path")).alias("path"), "length", "modificationTime")
    relative = F.expr(f"substring(path, {len(source.rstrip('/')) + 2})")
    out = listed.withColumn("relative", relative)
    name = F.element_at(F.split("relative", "/"), -1)
    return out.where(F.lower(F.element_at(F.split("relative", r"\."), -1)).isin(*SUFFIXES) & ~name.startswith(".") & ~F.array_contains(F.split("relative", "/"), "outputs"))


def orientation(content: bytes) -> int:
    """The orientation tag (274) of a JPEG's first Exif block; 1 if there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        block = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order and len(tiff) >= 8:
                begin = struct.unpack(order + "I", tiff[4:8])[0]
                count = struct.unpack(order + "H", tiff[begin : begin + 2])[0] if begin + 2 <= len(tiff) else 0
                for i in range(count):
                    entry = tiff[begin + 2 + 12 * i : begin + 14 + 12 * i]
                    if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 274:
                        tag = struct.unpack(order + "H", entry[8:10])[0]
                        return tag if 1 <= tag <= 8 else 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def read_images(spark: SparkSession, paths: str | list[str], recursive: bool = False, alpha: bool = False) -> DataFrame:
    """path, height, width, channels, data (rows of RGB or RGBA bytes). A file that can't be decoded has height -1.

    Only turned photos meet in the join that fetches tags: a few numbers a file. paths: a list names files, no folders.
    """
    small_batches(spark)  # before any function is made: a function takes what its workers are sent when it is made
    option = str(recursive).lower()
    images = spark.read.format("image").option("recursiveFileLookup", option).load(paths).select(plain(F.col("image.origin")).alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n"), F.col("image.data").alias("bytes"))

    @F.arrow_udf(IntegerType())
    def tag(content: pa.Array) -> pa.Array:
        return pa.array([orientation(c.as_py()) for c in content], pa.int32())

    photos = spark.read.format("binaryFile").option("recursiveFileLookup", option).load(paths).where(F.lower("path").rlike(r"\.jpe?g$"))
    turned = photos.select(plain(F.col("path")).alias("path"), tag("content").alias("tag")).where("tag > 1")
    channels = 4 if alpha else 3

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"path": [], "height": [], "width": [], "channels": [], "data": []}
            for r in batch.to_pylist():
                image = decoded(r["bytes"], r["height"], r["width"], r["n"], channels)
                if image is not None:
                    image = orient(image, r["tag"] or 1)
                rows["path"].append(r["path"])
                rows["height"].append(-1 if image is None else image.shape[0])
                rows["width"].append(-1 if image is None else image.shape[1])
                rows["channels"].append(channels)
                rows["data"].append(b"" if image is None else image.tobytes())
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    if isinstance(paths, list) and not any(p.lower().endswith((".jpg", ".jpeg")) for p in paths):  # files by name, none of them a photo: no join of their bytes
        return images.withColumn("tag", F.lit(None).cast("int")).mapInArrow(each, SCHEMA)
    return images.join(turned, "path", "left").mapInArrow(each, SCHEMA)


def small_batches(spark: SparkSession) -> None:
    """The workers get this package. A full-size image is some 12 MB; Spark ends Arrow batches by bytes, so a few are in one, and the session's settings stay as they are."""
    ship(spark)


def decoded(data: bytes, height: int, width: int, n: int, channels: int) -> np.ndarray | None:
    """From the image source's bytes (blue first) to RGB or RGBA."""
    if height <= 0 or width <= 0 or not data:
        return None
    raw = np.frombuffer(data, np.uint8).reshape(height, width, n)
    rgb = raw.repeat(3, 2) if n == 1 else raw[..., 2::-1]
    if channels == 3:
        return np.ascontiguousarray(rgb)
    return np.dstack((rgb, raw[..., 3] if n == 4 else np.full((height, width), 255, np.uint8)))


def array_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
