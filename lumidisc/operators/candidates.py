"""Which frames can show something to which viewpoints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.functions import geo as G


#: Viewpoints of one rotation.
MOST_VIEWS = 100_000


def viewpoints(spark, count: int, lat: float = 0.0) -> DataFrame:
    """Evenly spaced longitudes, the end excluded."""
    if not 0 <= count <= MOST_VIEWS:
        raise ValueError(f"{count} viewpoints; up to {MOST_VIEWS} are allowed")
    return spark.range(count).select(F.col("id").cast("int").alias("vp"), F.lit(float(lat)).alias("vp_lat"), (F.col("id") * 360.0 / count).alias("vp_lon"))


#: Side of the index's cells in degrees; 413 of them cover the sphere.
CELL_DEG = 10


def _band(lat: Column, deg: float) -> Column:
    return F.least(F.floor((lat + 90.0) / deg), F.lit(math.ceil(180 / deg) - 1)).cast("int")


def _widest(band: Column, deg: float) -> Column:
    """The cosine of the latitude of a band that is nearest to the equator."""
    south = band * deg - 90.0
    return F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.abs(south), F.abs(south + deg)) * F.signum(south * (south + deg)))))


def _around(band: Column, deg: float) -> Column:
    """Cells of a band: none is wider than it is high."""
    return F.greatest(F.lit(1), F.ceil(_widest(band, deg) * 360.0 / deg)).cast("int")


def cell_of(lat: Column, lon: Column, deg: float = CELL_DEG) -> tuple[Column, Column]:
    """Band and cell of a place."""
    band = _band(lat, deg)
    n = _around(band, deg)
    return band, F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n - 1).cast("int")


def _cell(band: Column, cell: Column, deg: float) -> tuple[Column, Column, Column]:
    """A cell's centre, and a radius that reaches all of it: half a side along the meridian, then half the width along the widest parallel."""
    n = _around(band, deg)
    return (band + 0.5) * deg - 90.0, (cell + 0.5) * 360.0 / n - 180.0, F.lit(deg / 2) + _widest(band, deg) * 180.0 / n


def nearest_frames(frames: DataFrame, views: DataFrame, k: int, limit_deg: float | None = None, deg: float = CELL_DEG) -> DataFrame:
    """The k nearest frames of each viewpoint within twice a cap, by a spherical cell index.

    Frames are counted by cell, views are put into cells too. From the counts (one row, as large as the grid of cells) follows for
    each cell with views how far their k nearest frames can lie at most, and so which cells they need: those that the limit or that
    distance reaches. Views and frames meet by cell in equi-joins; exact distances and the rank decide, and rows beyond k leave before
    the shuffle by WindowGroupLimit. ``deg`` trades cells against pairs: with many frames finer cells leave fewer of them.
    """
    limit = 2 * G.cap_radius() if limit_deg is None else limit_deg
    at = lambda lat, lon: dict(zip(("band", "cell"), cell_of(F.col(lat), F.col(lon), deg), strict=True))
    placed = frames.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns(at("lat", "lon"))
    lat, lon, radius = _cell(F.col("band"), F.col("cell"), deg)
    counts = placed.groupBy("band", "cell").agg(F.count("*").alias("n"))
    census = counts.agg(F.collect_list(F.struct("band", "cell", "n", lat.alias("lat"), lon.alias("lon"), radius.alias("radius"))).alias("cells"))

    def reach(c: Column) -> Column:
        d, both = G.great_circle(lat, lon, c["lat"], c["lon"]), c["radius"] + radius
        return F.struct((d + both).alias("far"), (d - both).alias("near"), c["band"].alias("band"), c["cell"].alias("cell"), c["n"].alias("n"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("far"))
    enough = F.aggregate("cells", none, lambda had, c: F.when(had["n"] >= k, had).otherwise(F.struct((had["n"] + c["n"]).alias("n"), c["far"].alias("far"))), lambda had: F.when(had["n"] >= k, had["far"]).otherwise(F.lit(360.0)))
    seen = views.withColumns(at("vp_lat", "vp_lon"))
    needs = seen.select("band", "cell").distinct().withColumn("cells", census.scalar())
    needs = needs.withColumn("cells", F.array_sort(F.transform("cells", reach)))
    needs = needs.withColumn("most", F.least(enough, F.lit(float(limit))) + 1e-4)  # distances are rounded later
    needs = needs.select("band", "cell", F.explode(F.filter("cells", lambda c: c["near"] <= F.col("most"))).alias("c"))
    asked = seen.join(needs, ["band", "cell"]).select("vp", "vp_lat", "vp_lon", "c.band", "c.cell")
    near = placed.join(asked, ["band", "cell"])
    near = near.withColumn("distance", G.great_circle(F.col("vp_lat"), F.col("vp_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance") < limit)
    near = near.withColumn("distance", F.round("distance", 6))
    rank = F.row_number().over(W.partitionBy("vp").orderBy("distance", "image", "event_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("vp", "rank", "event_id", "image", "distance")


def union_frames(near: DataFrame) -> DataFrame:
    """Each frame once, as its first viewpoint saw it."""
    first = F.min_by(F.struct("vp", "rank", "event_id"), F.struct("vp", "rank")).alias("f")
    return near.groupBy("image").agg(first).select("image", "f.*")
