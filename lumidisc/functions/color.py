"""Colour arithmetic as Columns: everything stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rec. 709 luma weights.
LUMA = (0.2126, 0.7152, 0.0722)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Grey level 0 to 255, halves to even."""
    total = reduce(lambda x, y: x + y, (F.lit(w) * c.cast("double") for w, c in zip(LUMA, (r, g, b), strict=True)))
    return clip(F.rint(total), 0, 255).cast("int")


def cloud_score(r: Column, g: Column, b: Column) -> Column:
    """Bright and grey is cloudy: value * (1 - saturation)^2; larger is cloudier."""
    most, least = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    grey = F.lit(1.0) - ratio(most - least, most)
    return most / 255.0 * grey * grey


def unavailable(r: Column, g: Column, b: Column) -> Column:
    raise NotImplementedError("no calibrated cloud fraction exists for colour images")


#: Scorers by name. A scorer makes a Column from three channels; only its order matters.
SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {"rgb": cloud_score, "cloudfraction": unavailable}


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """h, s, v from 0 to 1; the first channel that has the maximum decides the sextant."""
    r, g, b = (c.cast("double") / 255.0 for c in (r, g, b))
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    sixth = F.when(d == 0, 0.0).when(v == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(v == g, F.try_divide(b - r, d) + 2.0).otherwise(F.try_divide(r - g, d) + 4.0)
    return sixth / 6.0, ratio(d, v), v


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Channels 0 to 255, not rounded: each falls off with its distance from its own place on the hue circle."""

    def channel(n: float) -> Column:
        k = F.pmod(F.lit(n) + h * 6.0, F.lit(6.0))
        return (v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))) * 255.0

    return channel(5.0), channel(3.0), channel(1.0)


def hue_delta(a: Column, b: Column) -> Column:
    """The shorter way round from a to b, from -0.5 on."""
    return F.pmod(b - a + 0.5, F.lit(1.0)) - 0.5


@dataclass(frozen=True)
class Grade:
    """Settings of the colour grade; hues are shares of the circle."""

    amount: float = 1.0
    saturation_boost: float = 1.8
    gamma: float = 2.4
    contrast: float = 0.35
    black_point: float = 0.05
    land_green: float = 1.0
    land_hue_center: float = 35 / 360
    land_hue_width: float = 35 / 360
    land_hue_rotation: float = 90 / 360
    land_min_saturation: float = 0.12
    land_saturation_ramp: float = 0.15
    land_bright_low: float = 0.28
    land_bright_high: float = 0.55


def vibrance(s: Column, boost: float) -> Column:
    return clip(F.lit(1.0) - F.pow(F.lit(1.0) - s, F.lit(1.0 + boost)), 0, 1)


def tone(v: Column, g: Grade) -> Column:
    """Black point, gamma, contrast around the middle."""
    x = clip((v - g.black_point) / max(1e-6, 1 - g.black_point), 0, 1)
    x = F.pow(x, F.lit(1.0 / max(1e-6, g.gamma)))
    return clip(F.lit(0.5) + (x - 0.5) * (1 + g.contrast), 0, 1)


def land_weight(h: Column, s: Column, v: Column, g: Grade) -> Column:
    """How much a pixel looks like dry land, from its colours before grading."""
    near = clip(F.lit(1.0) - F.abs(hue_delta(F.lit(g.land_hue_center), h)) / max(1e-6, g.land_hue_width), 0, 1)
    vivid = clip((s - g.land_min_saturation) / g.land_saturation_ramp, 0, 1)
    dark = clip((F.lit(g.land_bright_high) - v) / (g.land_bright_high - g.land_bright_low), 0, 1)
    return near * vivid * dark * g.land_green


def grade(r: Column, g: Column, b: Column, settings: Grade = Grade()) -> tuple[Column, Column, Column]:
    """Graded channels 0 to 255, blended with the original by ``amount``, halves to even."""
    s = settings
    if s.amount <= 0:
        return tuple(c.cast("int") for c in (r, g, b))
    hue, sat, val = rgb_to_hsv(r, g, b)
    turned = F.pmod(hue + land_weight(hue, sat, val, s) * s.land_hue_rotation, F.lit(1.0))
    graded = hsv_to_rgb(turned, vibrance(sat, s.saturation_boost), tone(val, s))
    return tuple(clip(F.rint(c.cast("double") * (1 - s.amount) + x * s.amount), 0, 255).cast("int") for c, x in zip((r, g, b), graded, strict=True))


def flatten(c: Column, alpha: Column, background: int) -> Column:
    """A channel over a solid background."""
    return F.rint((c * alpha + F.lit(background) * (F.lit(255) - alpha)) / 255.0).cast("int")
