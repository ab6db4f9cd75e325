"""Spherical geometry as Columns. Angles are degrees; image rows grow downwards, north is up."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_COS = 0.35


def cap_radius(min_cos: float = MIN_COS) -> float:
    """The angle from the centre of a disc up to which a place counts as visible."""
    return math.degrees(math.acos(min_cos))


def cos_distance(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    a, b, d = F.radians(lat0), F.radians(lat1), F.radians(lon1 - lon0)
    return F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)


def great_circle(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(cos_distance(lat0, lon0, lat1, lon1), F.lit(-1.0)), F.lit(1.0))))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column, cx: Column, cy: Column, radius: Column) -> tuple[Column, Column, Column]:
    """Orthographic: column, row and the cosine of the distance from the disc's centre."""
    p, q, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    col = cx + radius * F.cos(p) * F.sin(d)
    row = cy - radius * (F.cos(q) * F.sin(p) - F.sin(q) * F.cos(p) * F.cos(d))
    return col, row, cos_distance(lat0, lon0, lat, lon)


def unproject(col: Column, row: Column, lat0: Column, lon0: Column, cx: Column, cy: Column, radius: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude in [-180, 180) and whether the place is on the disc."""
    x, y = (col - cx) / radius, (cy - row) / radius
    rho = F.hypot(x, y)
    c = F.asin(F.least(rho, F.lit(1.0)))
    q = F.radians(lat0)
    up = F.when(rho == 0, 0.0).otherwise(F.try_divide(y * F.sin(c) * F.cos(q), rho))
    lat = F.degrees(F.asin(F.least(F.greatest(F.cos(c) * F.sin(q) + up, F.lit(-1.0)), F.lit(1.0))))
    turn = F.degrees(F.atan2(x * F.sin(c), rho * F.cos(q) * F.cos(c) - y * F.sin(q) * F.sin(c)))
    return lat, wrap(lon0 + turn), rho <= 1


def wrap(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def cell_center(row: Column, col: Column, height: int, width: int) -> tuple[Column, Column]:
    """Of a cell of an equirectangular grid; row 0 is at the north pole, column 0 at -180."""
    return F.lit(90.0) - (row + 0.5) / height * 180.0, F.lit(-180.0) + (col + 0.5) / width * 360.0


def cell_at(lat: Column, lon: Column, height: int, width: int) -> tuple[Column, Column]:
    """Fractional row and column; columns wrap."""
    return (F.lit(90.0) - lat) / 180.0 * height - 0.5, F.pmod((lon + 180.0) / 360.0 * width - 0.5, F.lit(float(width)))
