"""Thresholds, boxes and mask quality as aggregates over pixel rows (image_id, row, col, grey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.functions import text as T


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "grey").agg(F.count("*").alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """image_id, threshold: the middle of the levels that separate best.

    Only levels that occur are rows; a level stands for itself and the empty ones up
    to the next, whose split is the same. At most 256 rows an image reach the windows.
    """
    w = W.partitionBy("image_id")
    up = w.orderBy("grey").rowsBetween(W.unboundedPreceding, 0)
    h = histogram(px).select(
        "image_id", "grey", F.lead("grey").over(w.orderBy("grey")).alias("next"),
        F.sum("n").over(up).alias("below"), F.sum(F.col("n") * F.col("grey")).over(up).alias("mass"), F.sum("n").over(w).alias("total"), F.sum(F.col("n") * F.col("grey")).over(w).alias("whole"),
    )
    gap = F.col("whole").cast("double") * F.col("below") - F.col("total").cast("double") * F.col("mass")
    split = F.try_divide(gap * gap, F.col("below").cast("double") * (F.col("total") - F.col("below")))
    h = h.where("next IS NOT NULL").withColumn("split", split).withColumn("best", F.max("split").over(w))
    h = h.where(F.col("split") >= F.col("best") * (1 - 1e-12))
    n = F.col("next") - F.col("grey")
    found = h.groupBy("image_id").agg(F.rint(F.sum(n * (F.col("grey") + F.col("next") - 1) / 2.0) / F.sum(n)).cast("int").alias("threshold"))
    # one level alone: every threshold ties
    return px.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("threshold", F.lit(128)).alias("threshold"))


def threshold(px: DataFrame, levels: DataFrame) -> DataFrame:
    """Mask rows: pixels above their image's threshold."""
    return px.join(levels, "image_id").where("grey > threshold")


def quality(px: DataFrame, levels: DataFrame, min_area: float = 0.0, pad: int = 0) -> DataFrame:
    """One row an image: area, boxes (right and bottom exclusive), coverage, fill, aspect, deviation, is_disc; one pass over the pixels."""
    on = F.col("grey") > F.col("threshold")
    low = lambda c: F.min(F.when(on, F.col(c)))
    high = lambda c: F.max(F.when(on, F.col(c))) + 1
    one = px.join(levels, "image_id").groupBy("image_id").agg(
        F.count_if(on).alias("found"), F.count("*").alias("size"), (F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"),
        low("col").alias("l"), low("row").alias("t"), high("col").alias("r"), high("row").alias("b"),
    )
    kept = (F.col("found") > 0) & (F.col("found") >= min_area * F.col("size"))
    one = one.withColumn("area", F.when(kept, F.col("found")).otherwise(0))
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    fill, aspect = F.when(kept, F.col("area") / F.greatest(w * h, F.lit(1))).otherwise(0.0), F.when(kept, T.aspect_ratio(w, h)).otherwise(0.0)
    out = one.withColumns({"empty": ~kept, "fill": fill, "aspect": aspect})
    return out.select(
        "image_id", "area", "empty",
        F.when(kept, F.greatest(F.col("l") - pad, F.lit(0))).alias("box_left"), F.when(kept, F.greatest(F.col("t") - pad, F.lit(0))).alias("box_top"),
        F.when(kept, F.least(F.col("r") + pad, F.col("width"))).alias("box_right"), F.when(kept, F.least(F.col("b") + pad, F.col("height"))).alias("box_bottom"),
        (F.col("area") / F.greatest(F.col("size"), F.lit(1))).alias("coverage"), "fill", "aspect",
        T.disc_deviation(F.col("fill"), F.col("aspect")).alias("deviation"), T.looks_like_disc(F.col("fill"), F.col("aspect"), F.col("empty")).alias("is_disc"),
    )


def status_counts(outcomes: DataFrame) -> DataFrame:
    """One row: images found, by status, and how many need a look. outcomes: status, needs_review."""
    by = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("ok", "skipped", "empty", "failed", "dry-run")]
    return outcomes.agg(F.count("*").alias("found"), *by, F.count_if("needs_review").alias("needs_review"))
