"""Frame metadata: JSON files of a mirror, read without touching an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.functions import text as T
from lumidisc.operators.mirror import parse_frames
from lumidisc.sources.images import plain

SCHEMA = "identifier string, image string, date string, centroid_coordinates struct<lat double, lon double>, _corrupt_record string"


def frame_index(spark: SparkSession, root: str, collection: str = "natural") -> DataFrame:
    """collection, image, archive_day, captured, lat, lon of all days of a mirror. Files that are no JSON are left out."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/{collection}/*/*/*/metadata.json")
    good = raw.where("_corrupt_record IS NULL").select("image", "date", F.col("centroid_coordinates.lat").alias("lat"), F.col("centroid_coordinates.lon").alias("lon"))
    return parse_frames(good).select(F.lit(collection).alias("collection"), "*")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every file of a mirror but unfinished ones; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(~F.col("path").endswith(".part")).select(plain(F.col("path")).alias("path"), "length", "modificationTime")


def mirror_bytes(spark: SparkSession, root: str) -> int:
    return inventory(spark, root).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def located(frames: DataFrame, root: str, form: str) -> DataFrame:
    return frames.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), T.archive_path(F.col("collection"), F.col("archive_day"), F.col("image"), form)))


def available_dates(raw: DataFrame, column: str = "date") -> DataFrame:
    """Distinct days from texts that begin with one; others are skipped."""
    return raw.select(F.try_to_date(F.substring(column, 1, 10)).alias("d")).where("d IS NOT NULL").distinct()
