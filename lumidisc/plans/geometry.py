"""Where the disc lies in each frame, found once: a table beside the mirror remembers it for each file and segmentation setting.

The store lies in ``<root>/.cache/discs`` (see ``sinks.versions``): each run that met new files adds a folder, and many folders are merged
into one. A file is known by collection, image, format, length and time of its last change, so another format, a replaced
file and a repaired one are measured anew, and of several results for a file the newest counts. A run joins its frames with the
store, reads and segments only files that it doesn't hold, and adds them. That a file shows no disc, or can't be decoded, is
remembered of that file as it is; once it changes, it is another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.plans.segment_batch import Settings
from lumidisc.raster import kernels as K
from lumidisc.sinks.versions import Versions
from lumidisc.sources import images as I
from lumidisc.sources import metadata

FOUND = "cx double, cy double, radius double, is_disc boolean"
#: What a file is known by.
FILE = ("collection", "image", "form", "length", "modified")
STORE = f"collection string, image string, form string, length bigint, modified timestamp, settings string, {FOUND}, decoded boolean, measured timestamp"
#: Folders of the store beyond which a run merges them.
MOST_FOLDERS = 16
_FOUND = (*((c, pa.float64()) for c in ("cx", "cy", "radius")), ("is_disc", pa.bool_()), ("decoded", pa.bool_()))


def key_of(settings: Settings) -> str:
    return json.dumps(asdict(settings), sort_keys=True)


def store(spark: SparkSession, root: str) -> Versions:
    return Versions(spark, f"{root.rstrip('/')}/.cache/discs", STORE, (*FILE, "settings"), "measured")


def stored(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """What the store holds for these settings, each file once."""
    table = store(spark, root)
    return table.newest(table.read().where(F.col("settings") == key_of(settings))).drop("settings", "measured")


def files_of(frames: DataFrame, root: str) -> DataFrame:
    """The frames whose files are there, with form, length and modified."""
    there = metadata.inventory(frames.sparkSession, root).select("path", "length", F.col("modificationTime").alias("modified"))
    form = F.lower(F.element_at(F.split("path", r"\."), -1)).alias("form")
    return frames.join(there, "path").select(*frames.columns, form, "length", "modified")


def lookup(frames: DataFrame, store: DataFrame, on: tuple[str, ...] = ("collection", "image")) -> DataFrame:
    """The frames with what the store holds of them, and ``found``: cached or compute."""
    joined = frames.join(store.withColumn("_hit", F.lit(True)), list(on), "left")
    return joined.withColumn("found", F.when(F.col("_hit"), "cached").otherwise("compute")).drop("_hit")


def measured(images: DataFrame, settings: Settings) -> DataFrame:
    """The file's columns with the disc's centre and radius, from the segmentation's tight box; nulls where there is none. images: the columns of FILE, height, width, channels, data."""
    keywords = asdict(settings)

    def one(r: dict) -> dict:
        s = K.segment(I.array_of(r), **keywords) if r["height"] > 0 else None
        if s is None or s.tight is None:
            return {"cx": None, "cy": None, "radius": None, "is_disc": False, "decoded": s is not None}
        left, top, right, bottom = s.tight
        return {"cx": (left + right) / 2, "cy": (top + bottom) / 2, "radius": (right - left + bottom - top) / 4, "is_disc": bool(s.is_disc), "decoded": True}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = pa.RecordBatch.from_pylist([one(r) for r in batch.select(["height", "width", "channels", "data"]).to_pylist()], pa.schema(_FOUND))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in FILE), *found.columns], [*FILE, *found.schema.names])

    files = ", ".join(f"{c} {dict(images.dtypes)[c]}" for c in FILE)
    return images.select(*FILE, "height", "width", "channels", "data").mapInArrow(each, f"{files}, {FOUND}, decoded boolean")


def located(spark: SparkSession, root: str, frames: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """The frames that show a proper disc, with cx, cy and radius; how many files were measured now. frames: collection, image, path, and more."""
    I.small_batches(spark)
    files = files_of(frames, root)
    before = lookup(files, stored(spark, root, settings), FILE)
    paths = [r["path"] for r in before.where("found = 'compute'").select("path").distinct().collect()]  # names of one run's candidates alone
    if paths:
        images = I.read_images(spark, paths).join(files.select("path", *FILE).distinct(), "path")
        new = measured(images, settings).withColumns({"settings": F.lit(key_of(settings)), "measured": F.current_timestamp()})
        table = store(spark, root)
        table.add(new.select(*(c.split()[0] for c in STORE.split(", "))))
        if len(table.folders()) > MOST_FOLDERS:
            table.merge()
        before = lookup(files, stored(spark, root, settings), FILE)
    return before.where("is_disc").select(*frames.columns, "cx", "cy", "radius"), len(paths)
