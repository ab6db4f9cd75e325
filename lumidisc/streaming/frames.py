"""Frames as a stream: new metadata files of a mirror, daily counts with a watermark, and an archive that is polled for new days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lumidisc.operators.mirror import parse_frames
from lumidisc.sources.metadata import SCHEMA


def stream_index(spark: SparkSession, root: str, collection: str = "natural", files_per_trigger: int = 1000) -> DataFrame:
    """The frames of metadata files as they appear."""
    raw = spark.readStream.schema(SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(f"{root}/{collection}/*/*/*/metadata.json")
    good = raw.where("_corrupt_record IS NULL").select("image", "date", F.col("centroid_coordinates.lat").alias("lat"), F.col("centroid_coordinates.lon").alias("lon"))
    return parse_frames(good).withColumn("collection", F.lit(collection))


def daily_counts(frames: DataFrame, late: str = "2 days") -> DataFrame:
    """Frames by day of capture; a frame that repeats within the watermark counts once."""
    once = frames.withColumn("captured", F.col("captured").cast("timestamp")).withWatermark("captured", late).dropDuplicatesWithinWatermark(["image"])
    return once.groupBy(F.window("captured", "1 day").alias("day")).agg(F.count("*").alias("frames"), F.avg("lat").alias("mean_lat"))


class ArchiveDays(DataSource):
    """format("archive_days"): (day, image) of every day from option ``start`` on, polled a day at a time. Options: base, collection, start. One reader on the driver, so requests stay paced."""

    @classmethod
    def name(cls) -> str:
        return "archive_days"

    def schema(self) -> str:
        return "day date, image string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Days(self.options)


class _Days(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def _rows(self, day: dt.date) -> list[tuple]:
        from lumidisc.sources.http import Client

        found = Client(self.options["base"], delay=float(self.options.get("delay", "0.5"))).get_json(f"api/{self.options.get('collection', 'natural')}/date/{day}")
        return [(day, x["image"]) for x in found if isinstance(x, dict) and "image" in x] if isinstance(found, list) else []

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        day, last = dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(self.options.get("end", str(dt.datetime.now(dt.UTC).date())))
        if day > last:
            return iter(()), start
        return iter(self._rows(day)), {"day": str(day + dt.timedelta(days=1))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        day = dt.date.fromisoformat(start["day"])
        while day < dt.date.fromisoformat(end["day"]):
            yield from self._rows(day)
            day += dt.timedelta(days=1)
