"""Shared palettes: a histogram of colours, a median cut in rounds of grouped medians, and nearest swatches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.session import checkpointed


def color_histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def cuts_of(colors: DataFrame) -> DataFrame:
    """box, channel, spread, pixels, cut for every box of colours (r, g, b, n, box) and channel: ``cut`` is the first level up to which half of its pixels lie; something is left above it."""
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias("v")) for i, c in enumerate("rgb")))).alias("x")
    counted = colors.select("box", "n", levels).groupBy("box", "x.channel", "x.v").agg(F.sum("n").alias("n"))  # at most 768 rows a box
    all_of = W.partitionBy("box", "channel")
    run = counted.withColumns({"below": F.sum("n").over(all_of.orderBy("v")), "pixels": F.sum("n").over(all_of), "top": F.max("v").over(all_of)})
    under = lambda condition: F.when(condition & (F.col("v") < F.col("top")), F.col("v"))
    cut = F.coalesce(F.min(under(F.col("below") * 2 >= F.col("pixels"))), F.max(under(F.lit(True))))
    return run.groupBy("box", "channel").agg((F.max("v") - F.min("v")).alias("spread"), F.max("pixels").alias("pixels"), cut.alias("cut"))


def boxes(colors: DataFrame, most: int) -> DataFrame:
    """colors (r, g, b, n) with ``box``: a median cut. In each of log2(most) rounds every box is cut at the median of its widest channel, as long as there are at most ``most``; those with the largest spread times pixels come first.

    The colours never move: a round sums them up by box and level, and its cuts, fewer than ``most`` rows, are joined with them.
    """
    found, count = colors.withColumn("box", F.lit(0)), 1
    for _ in range(max(0, math.ceil(math.log2(max(1, most))))):
        widest = {}
        for r in sorted(cuts_of(found).where("spread > 0").collect(), key=lambda r: (-r["spread"], r["channel"])):  # three rows a box
            widest.setdefault(r["box"], r)
        chosen = sorted(widest.values(), key=lambda r: (-r["spread"] * r["pixels"], r["box"]))[: max(0, most - count)]
        count += len(chosen)
        cuts = found.sparkSession.createDataFrame([(r["box"], r["channel"], r["cut"]) for r in chosen], "box int, channel int, cut int")
        level = F.when(F.col("channel") == 0, F.col("r")).when(F.col("channel") == 1, F.col("g")).otherwise(F.col("b"))
        high = F.when(level > F.col("cut"), 1).otherwise(0)
        found = found.join(F.broadcast(cuts), "box", "left").select("r", "g", "b", "n", (F.col("box") * 2 + high).alias("box"))
    return found


def shared_palette(px: DataFrame, colors: int = 32) -> DataFrame:
    """idx, r, g, b: at most ``colors`` swatches for all images together, the means of a median cut's boxes. No colour reaches the driver."""
    counted = checkpointed(color_histogram(px))
    mean = lambda c: F.rint(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    swatches = boxes(counted, colors).groupBy("box").agg(*map(mean, "rgb")).select("r", "g", "b").distinct()  # at most ``colors`` rows
    return swatches.select((F.row_number().over(W.orderBy("r", "g", "b")) - 1).alias("idx"), "r", "g", "b")


def nearest(px: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Distinct colours with the first of their nearest swatches. A palette has at most some hundred entries, so it is part of the expression."""
    d = lambda i, c: F.struct((F.pow(F.col("r") - c[0], F.lit(2)) + F.pow(F.col("g") - c[1], F.lit(2)) + F.pow(F.col("b") - c[2], F.lit(2))).cast("int").alias("d2"), F.lit(i).alias("swatch"))
    best = F.array_min(F.array(*(d(i, c) for i, c in enumerate(palette))))
    return px.select("r", "g", "b").distinct().withColumn("best", best).select("r", "g", "b", "best.swatch", "best.d2")
