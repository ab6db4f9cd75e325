"""Planning a mirror: what is there, what is missing, what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.functions import geo as G
from lumidisc.functions import text as T


def parse_frames(raw: DataFrame) -> DataFrame:
    """raw: image, date (text), lat, lon. The day comes from the name; rows whose name ends in no time go; an unreadable date falls back to the name's time."""
    named = raw.withColumn("named", T.stamp(F.col("image"))).where("named IS NOT NULL")
    return named.select("image", F.to_date("named").alias("archive_day"), F.when(F.col("date").isNotNull(), F.coalesce(F.try_to_timestamp("date"), F.col("named"))).alias("captured"), "lat", "lon")


def present(frames: DataFrame, inventory: DataFrame) -> DataFrame:
    return frames.join(inventory.select("image"), "image", "left_semi")


def missing(frames: DataFrame, inventory: DataFrame) -> DataFrame:
    return frames.join(inventory.select("image"), "image", "left_anti")


def with_sizes(missing_frames: DataFrame, sizes: DataFrame, form: str) -> DataFrame:
    """Probed sizes, or the nominal one of the format."""
    return missing_frames.join(sizes.select("image", F.col("bytes").alias("probed")), "image", "left").withColumn("need", F.coalesce("probed", F.lit(T.NOMINAL_BYTES[form])))


def longitude_span(frames: DataFrame, by: str = "day") -> DataFrame:
    """The way that longitudes sweep over each day, by the shorter way round at each step."""
    w = W.partitionBy(by).orderBy("captured", "event_id")
    step = F.abs(G.wrap(F.col("lon") - F.lag("lon").over(w)))
    return frames.where("lon IS NOT NULL").withColumn("step", step).groupBy(by).agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 6).alias("span"))


def report_by_day(frames: DataFrame, inventory: DataFrame, sizes: DataFrame, form: str) -> DataFrame:
    """day, frames, missing, bytes and the span of each day."""
    here = inventory.select("image").distinct().withColumn("here", F.lit(True))
    probed = sizes.groupBy("image").agg(F.max("bytes").alias("probed"))
    joined = frames.join(here, "image", "left").join(probed, "image", "left")
    need = F.when(F.col("here").isNull(), F.coalesce("probed", F.lit(T.NOMINAL_BYTES[form])))
    days = joined.groupBy("day").agg(F.count("*").alias("frames"), F.count_if(F.col("here").isNull()).alias("missing"), F.coalesce(F.sum(need), F.lit(0)).cast("bigint").alias("bytes"))
    return days.join(longitude_span(frames), "day", "left").withColumn("size", T.human_bytes(F.col("bytes")))


def running_budget(planned: DataFrame, most: int) -> DataFrame:
    """planned: day, event_id, bytes. The sum up to each file within its day, after the sums of the days before, and whether it still fits. Sums by day come first, so only one row a day meets the global window."""
    days = planned.groupBy("day").agg(F.sum("bytes").alias("day_bytes"))
    before = days.select("day", (F.sum("day_bytes").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)) - F.col("day_bytes")).alias("before"))
    w = W.partitionBy("day").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    out = planned.join(before, "day").withColumn("running", F.col("before") + F.sum("bytes").over(w))
    return out.select("day", "event_id", "bytes", "running", (F.col("running") <= most).alias("fits"))


def fetch_stats(results: DataFrame) -> DataFrame:
    """One row over per-file results (status, bytes)."""
    return results.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("downloaded", "skipped", "current", "failed")), F.coalesce(F.sum(F.when(F.col("status") == "downloaded", F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"))


def pair_by_stamp(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of two collections that share the time in their names."""
    key = F.regexp_extract("image", r"(\d{14})$", 1)
    return a.select(key.alias("stamp"), F.col("event_id").alias("natural")).join(b.select(key.alias("stamp"), F.col("event_id").alias("cloud")), "stamp")


def with_etags(files: DataFrame, store: DataFrame) -> DataFrame:
    """files (path, ...) with the etag that the store (path, etag) holds; null for files it doesn't know."""
    return files.join(store, "path", "left")
