"""Archive-shaped views of generic tables: small images, frames and dates, for queries on any data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.session import checkpointed

SIDE = 8


def levels(embedding: str = "embedding") -> Column:
    """Grey levels of a vector read as an image."""
    return F.transform(F.col(embedding), lambda e: F.least(F.greatest(F.floor((e.cast("double") + 0.6) / 1.2 * 255), F.lit(0)), F.lit(255)).cast("int"))


def images(embeddings: DataFrame) -> DataFrame:
    """image_id and levels: one row for each image."""
    return embeddings.select(F.col("vec_id").alias("image_id"), levels().alias("levels"))


def pixels(embeddings: DataFrame) -> DataFrame:
    """image_id, row, col and r, g, b: the red levels, and green and blue from rotated positions."""
    n = SIDE * SIDE
    flat = images(embeddings).select("image_id", "levels", F.posexplode("levels").alias("i", "r"))
    at = lambda k: F.element_at("levels", (F.col("i") + k) % n + 1)
    return flat.select("image_id", F.expr(f"i div {SIDE}").cast("int").alias("row"), (F.col("i") % SIDE).alias("col"), "r", at(21).alias("g"), at(42).alias("b"))


def frames(events: DataFrame) -> DataFrame:
    """Frames with a name that ends in their time, a day and the place below the camera."""
    e = F.col("event_id")
    return events.select(
        "event_id",
        F.concat(F.lit("disc_"), F.date_format("ts", "yyyyMMddHHmmss")).alias("image"),
        F.to_date("ts").alias("day"),
        F.date_trunc("second", "ts").alias("captured"),
        ((e * 7919) % 1801 / 10.0 - 90.0).alias("lat"),
        ((e * 104729) % 3600 / 10.0 - 180.0).alias("lon"),
        F.floor(F.abs("value") * 1000).cast("bigint").alias("bytes"),
    )


def available(orders: DataFrame) -> DataFrame:
    """Distinct days, with a hole of some months."""
    day = F.to_date("o_orderdate").alias("d")
    return orders.select(day).where(~F.col("d").between("1998-03-01", "1998-10-14")).distinct()


def discs(events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Every frame with its image, that of the id that is its own modulo the number of images; the disc fills the image."""
    n = max(1, embeddings.count())
    code = lambda i, k: F.lpad(F.hex(F.element_at("levels", (i + k) % (SIDE * SIDE) + 1)), 2, "0")
    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    data = F.unhex(F.array_join(F.transform(places, lambda i: F.concat(*(code(i, k) for k in (0, 21, 42)))), ""))
    images_ = images(embeddings).select("image_id", data.alias("data"))
    mid = F.lit((SIDE - 1) / 2)
    side = F.lit(SIDE)
    found = frames(events).withColumn("image_id", F.pmod(F.col("event_id"), F.lit(n))).join(images_, "image_id")
    return found.select(F.col("event_id").alias("idx"), "lat", "lon", mid.alias("cx"), mid.alias("cy"), mid.alias("radius"), side.alias("height"), side.alias("width"), F.lit(3).alias("channels"), "data")


def numbered(df: DataFrame, key: str, number: str) -> DataFrame:
    """The distinct keys in order, numbered from 0 without a gap and without one task that reads them all."""
    keys = checkpointed(df.select(key).distinct().orderBy(key).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in keys.groupBy("part").count().collect())
    first, at = [], 0
    for part, n in sizes:
        first.append((part, at))
        at += n
    before = df.sparkSession.createDataFrame(first, "part int, before bigint")
    within = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return keys.join(F.broadcast(before), "part").select(key, (F.col("before") + within).alias(number))
