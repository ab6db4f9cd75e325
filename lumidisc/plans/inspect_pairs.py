"""A look at downloaded data: do files of a second collection show discs too, and of how many colours, beside the natural frames of the same time?"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.operators import mirror
from lumidisc.raster import kernels as K
from lumidisc.session import checkpointed
from lumidisc.sinks import png
from lumidisc.sinks.files import find_root, land  # noqa: F401  roots of this plan too
from lumidisc.sources import images as I
from lumidisc.sources import metadata
from lumidisc.sources.derived import numbered

SCHEMA = "path string, height int, width int, fill double, aspect double, is_disc boolean, colors int, thumb binary"
#: Side of a thumbnail.
THUMB = 160


def pairs(spark: SparkSession, root: str, other: str = "cloud", form: str = "png") -> DataFrame:
    """stamp, natural and cloud: paths of files of both collections with the same time in their names."""
    files = lambda name: metadata.inventory(spark, f"{root}/{name}").where(F.col("path").endswith(f".{form}")).select(F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("image"), F.col("path").alias("event_id"))
    return mirror.pair_by_stamp(files("natural"), files(other)).where("stamp <> ''")


def spread(found: DataFrame, most: int = 6) -> DataFrame:
    """Up to ``most`` pairs, evenly from the first on in the order of their times: every nth, then the first of those."""
    order = checkpointed(numbered(found, "stamp", "k"))
    step = max(1, order.count() // most)
    return found.join(order.where((F.col("k") % step == 0) & (F.col("k") < step * most)), "stamp")


def described(images: DataFrame) -> DataFrame:
    """What the disc detector says of each image, how many colours the detected region has, and a thumbnail. images: path, height, width, channels, data."""
    arrow = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("fill", pa.float64()), ("aspect", pa.float64()), ("is_disc", pa.bool_()), ("colors", pa.int32()), ("thumb", pa.binary())])

    def one(r: dict) -> dict:
        if r["height"] < 0:
            return {"path": r["path"], "height": -1, "width": -1, "fill": None, "aspect": None, "is_disc": None, "colors": None, "thumb": None}
        image = I.array_of(r)
        s = K.segment(image)
        colors = len(np.unique(image[s.mask].astype(np.int32) @ np.array((65536, 256, 1), np.int32)))
        return {"path": r["path"], "height": r["height"], "width": r["width"], "fill": s.fill, "aspect": s.aspect, "is_disc": bool(s.is_disc), "colors": colors, "thumb": K.resize_nearest(image, THUMB).tobytes()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], arrow)

    return images.mapInArrow(each, SCHEMA)


def inspect(spark: SparkSession, root: str, out: str | None = None, other: str = "cloud", most: int = 6) -> DataFrame:
    """A row for each sampled file of the other collection; ``out``: a sheet with the natural frame above each."""
    if other == "natural":
        raise ValueError("natural frames can't be held against themselves")
    root = os.path.abspath(root)
    chosen = sorted(tuple(r) for r in spread(pairs(spark, root, other), most).select("stamp", "natural", "cloud").collect())  # ``most`` rows
    if not chosen:
        return spark.createDataFrame([], f"stamp string, {SCHEMA}").drop("thumb")
    names = spark.createDataFrame([(stamp, path, kind) for stamp, *both in chosen for kind, path in zip(("natural", "other"), both, strict=True)], "stamp string, path string, kind string")
    found = checkpointed(described(I.read_images(spark, [p for _, *both in chosen for p in both])).join(F.broadcast(names), "path"))
    if out:
        tiles = {(r["stamp"], r["kind"]): r["thumb"] for r in found.where("thumb IS NOT NULL").select("stamp", "kind", "thumb").collect()}
        tile = lambda key: np.frombuffer(tiles[key], np.uint8).reshape(THUMB, THUMB, 3) if key in tiles else np.zeros((THUMB, THUMB, 3), np.uint8)
        land(out, png.encode(np.hstack([np.vstack([tile((stamp, kind)) for kind in ("natural", "other")]) for stamp, *_ in chosen])))
    return found.where("kind = 'other'").select("stamp", *(c for c in found.columns if c not in ("stamp", "kind", "thumb")))
