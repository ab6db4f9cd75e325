"""Names, paths, sizes and identities."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideal share of its box that a disc fills.
DISC_FILL = math.pi / 4
#: Bytes of a file by format where nothing better is known.
NOMINAL_BYTES = {"png": 2_650_000, "jpg": 213_000, "thumbs": 6_000}
# Byte units.
_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12} | {u + e: 1 << 10 * (i + 1) for i, u in enumerate("kmgt") for e in ("", "ib")}


def human_bytes(n: Column) -> Column:
    """One decimal (halves to even) in GiB, MiB or KiB, or whole bytes."""
    out = F.when(n >= 1 << 30, F.format_string("%.1f GiB", F.bround(n / float(1 << 30), 1)))
    for unit, size in (("MiB", 1 << 20), ("KiB", 1 << 10)):
        out = out.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n / float(size), 1)))
    return out.otherwise(F.format_string("%d B", n))


def parse_bytes(text: Column, strict: bool = False) -> Column:
    """The size that a literal such as ``10GiB`` or ``1_000 kb`` names; null, or an error if strict, for others."""
    plain = F.lower(F.regexp_replace(text, "[ _]", ""))
    number = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?|\.[0-9]+)([a-z]*)$", 1)
    unit = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?|\.[0-9]+)([a-z]*)$", 2)
    sizes = F.create_map(*(F.lit(x) for pair in _UNITS.items() for x in pair))
    value = F.when(number != "", F.floor(number.try_cast("double") * F.try_element_at(sizes, unit))).cast("bigint")
    return F.coalesce(value, F.raise_error(F.concat(F.lit("not a size: "), text)).cast("bigint")) if strict else value


def archive_path(collection: Column, day: Column, image: Column, form: str) -> Column:
    """collection/YYYY/MM/DD/format/image.extension; thumbnails are jpg."""
    return F.concat(collection, F.lit("/"), F.date_format(day, "yyyy/MM/dd"), F.lit(f"/{form}/"), image, F.lit(".jpg" if form == "thumbs" else f".{form}"))


def stamp(image: Column) -> Column:
    """The time that a frame's name ends with; null if its 14 digits are no time."""
    digits = F.regexp_extract(image, r"(\d{14})$", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.coalesce(width / F.greatest(height, F.lit(1)), F.lit(0.0))


def disc_deviation(fill: Column, aspect: Column) -> Column:
    return F.greatest(F.abs(fill - DISC_FILL) / DISC_FILL, F.abs(aspect - 1.0))


def looks_like_disc(fill: Column, aspect: Column, empty: Column, tolerance: float = 0.12) -> Column:
    return ~empty & (disc_deviation(fill, aspect) < tolerance)


def review_reason(error: Column, empty: Column, fill: Column, aspect: Column) -> Column:
    """Why an image needs a look: its error, nothing found, or the larger deviation (aspect on a tie)."""
    a, f = F.abs(aspect - 1.0), F.abs(fill - DISC_FILL) / DISC_FILL
    return F.when(error.isNotNull(), error).when(empty, "no object found").when(a >= f, F.format_string("aspect ratio %.3f", F.bround(aspect, 3))).otherwise(F.format_string("fill ratio %.3f", F.bround(fill, 3)))


def run_id(**settings) -> str:
    """Eight hex digits that name a run by its settings."""
    told = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:8]


def run_id_of(**settings: Column) -> Column:
    """The same as a Column, for settings that are texts, whole numbers or booleans; a null is told as such."""
    told = F.to_json(F.struct(*(settings[k].alias(k) for k in sorted(settings))), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(told, 256), 1, 8)
