"""Contact sheets."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sheet_columns(n: int) -> int:
    return max(1, math.ceil(math.sqrt(n)))


def sheet_pixels(pixels: DataFrame, tiles: int, side: int) -> DataFrame:
    """Pixels (k: the tile's number, row, col, ...) with their places y and x on a sheet, however large it is."""
    columns = F.lit(sheet_columns(tiles))
    return pixels.withColumns({"y": (F.col("row") + F.floor(F.col("k") / columns) * side).cast("int"), "x": (F.col("col") + F.col("k") % columns * side).cast("int")})


def flatten(rgba: np.ndarray, background: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """An RGBA image over a solid background."""
    a = rgba[..., 3:].astype(float) / 255
    return np.clip(np.rint(rgba[..., :3] * a + np.array(background) * (1 - a)), 0, 255).astype(np.uint8)


def contact_sheet(frames: Iterable[np.ndarray], n: int, background: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """RGB tiles of equal size, row by row in a near square. The n frames are taken one at a time."""
    columns, out = sheet_columns(n), None
    for k, frame in enumerate(frames):
        h, w = frame.shape[:2]
        if out is None:
            out = np.full((-(-n // columns) * h, columns * w, 3), background, np.uint8)
        y, x = k // columns * h, k % columns * w
        out[y : y + h, x : x + w] = flatten(frame, background) if frame.shape[2] == 4 else frame
    return out
