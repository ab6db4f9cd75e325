"""The functions by name in SQL. Scalars are SQL functions, which Catalyst inlines; pixels() is a table function over dense images."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lumidisc.session import ship

_MOST = "greatest(r, g, b)"
_COS = "(sin(radians(lat0)) * sin(radians(lat1)) + cos(radians(lat0)) * cos(radians(lat1)) * cos(radians(lon1 - lon0)))"

FUNCTIONS = {
    "disc_luminance(r INT, g INT, b INT) RETURNS INT": "CAST(least(greatest(rint(0.2126D * r + 0.7152D * g + 0.0722D * b), 0), 255) AS INT)",
    "disc_cloud_score(r INT, g INT, b INT) RETURNS DOUBLE": f"{_MOST} / 255D * pow(1 - coalesce(try_divide({_MOST} - least(r, g, b), {_MOST}), 0D), 2)",
    "disc_great_circle(lat0 DOUBLE, lon0 DOUBLE, lat1 DOUBLE, lon1 DOUBLE) RETURNS DOUBLE": f"degrees(acos(least(greatest({_COS}, -1D), 1D)))",
    "disc_wrap_lon(lon DOUBLE) RETURNS DOUBLE": "pmod(lon + 180D, 360D) - 180D",
    "disc_looks_round(fill DOUBLE, aspect DOUBLE) RETURNS BOOLEAN": "fill > 0 AND greatest(abs(fill - pi() / 4) / (pi() / 4), abs(aspect - 1)) < 0.12D",
}


class Pixels:
    """row, col and channels of an image given as bytes, height, width and channels."""

    def eval(self, data: bytes, height: int, width: int, channels: int):
        for i in range(height * width):
            p = data[i * channels : (i + 1) * channels]
            yield i // width, i % width, p[0], p[1 % channels], p[2 % channels]


def register(spark: SparkSession) -> list[str]:
    """Registers all for the session; returns their names."""
    ship(spark)
    for head, body in FUNCTIONS.items():
        name, returns = head.rsplit(" RETURNS ", 1)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {returns} RETURN {body}")
    spark.udtf.register("disc_pixels", udtf(Pixels, returnType="row int, col int, r int, g int, b int"))
    return [h.split("(")[0] for h in FUNCTIONS] + ["disc_pixels"]
