"""The least cloudy observation of each cell of a latitude-longitude grid, from many full-disc frames.

Frames stream through a task one at a time: it keeps the ``blend_k`` best observations of each cell over all frames it
reads and sends those on, once. So memory is the grid's, not the frames', there is no join of cells with frames, and what
is shuffled is at most ``blend_k`` grids a task. A frame is held against the rows and columns that its cap reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.functions import geo as G
from lumidisc.functions.color import SCORERS
from lumidisc.raster import kernels as K
from lumidisc.session import ship
from lumidisc.sources import images as I

SEEN = "cell_row int, cell_col int, idx bigint, score double, r double, g double, b double"


def dense_score(rgb: np.ndarray) -> np.ndarray:
    """The cloud score of color.cloud_score on arrays."""
    most, least = rgb.max(-1).astype(float), rgb.min(-1).astype(float)
    grey = 1 - np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)
    return most / 255 * grey**2


def dense_least(rgb: np.ndarray) -> np.ndarray:
    """For each place of images (n, height, width, 3): what dense_score gives at least for whole levels between it and its right and lower neighbours."""

    def square(x: np.ndarray, of: np.ufunc) -> np.ndarray:
        x = of(x, np.concatenate((x[:, 1:], x[:, -1:]), 1))
        return of(x, np.concatenate((x[:, :, 1:], x[:, :, -1:]), 2)).astype(float)

    # the score is least ** 2 / (255 * most), of the levels of three channels
    return square(rgb.min(-1), np.minimum) ** 2 / (255 * np.maximum(square(rgb.max(-1), np.maximum), 1))


DENSE_SCORERS = {"rgb": dense_score}
DENSE_LEAST = {"rgb": dense_least}
#: Cells of all frames that are worked on together.
GROUP_CELLS = 1 << 17


def dense_project(lat: np.ndarray, lon: np.ndarray, lat0: float, lon0: float, cx: float, cy: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, row and the cosine of the distance from the disc's centre, of one frame or (with further axes) of many."""
    p, q, d = np.radians(lat), np.radians(lat0), np.radians(lon - lon0)
    turned = np.cos(p) * np.cos(d)
    cos_c = np.sin(q) * np.sin(p) + np.cos(q) * turned
    return cx + radius * (np.cos(p) * np.sin(d)), cy - radius * (np.cos(q) * np.sin(p) - np.sin(q) * turned), cos_c


def dense_unproject(col: np.ndarray, row: np.ndarray, lat0: float, lon0: float, cx: float, cy: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = (col - cx) / radius, (cy - row) / radius
    rho = np.hypot(x, y)
    c, q, safe = np.arcsin(np.minimum(rho, 1)), math.radians(lat0), np.where(rho == 0, 1, rho)
    lat = np.degrees(np.arcsin(np.clip(np.cos(c) * np.sin(q) + y * np.sin(c) * np.cos(q) / safe, -1, 1)))
    lon = lon0 + np.degrees(np.arctan2(x * np.sin(c), rho * np.cos(q) * np.cos(c) - y * np.sin(q) * np.sin(c)))
    return lat, np.mod(lon + 180, 360) - 180, rho <= 1


def reach(lat0: float, lon0: float, height: int, width: int, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows and columns of the grid that a cap reaches, in order."""
    cap = math.degrees(math.acos(min_cos))
    row_at = lambda lat: (90 - lat) / 180 * height - 0.5
    rows = np.arange(max(0, math.floor(row_at(lat0 + cap))), min(height - 1, math.ceil(row_at(lat0 - cap))) + 1)
    if abs(lat0) + cap >= 90:
        return rows, np.arange(width)
    half = math.degrees(math.asin(min(1.0, math.sin(math.radians(cap)) / math.cos(math.radians(lat0)))))
    first, last = ((lon0 + side * half + 180) / 360 * width - 0.5 for side in (-1, 1))
    n = min(width, math.ceil(last) - math.floor(first) + 1)
    return rows, np.sort((math.floor(first) + np.arange(n)) % width)


def sampled(image: np.ndarray, row: np.ndarray, col: np.ndarray, cos_c: np.ndarray, scorer: str, floor: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which places are bright enough, their colours, their scores): bilinear colours; whole levels decide. A score is low for clear sky seen from above."""
    rgb = K.bilinear(image, row, col)
    whole = np.floor(np.clip(rgb, 0, 255) + 1e-6).astype(np.uint8)  # equal taps may sum up to a hair less
    bright = np.flatnonzero(K.to_uint8(whole @ K.LUMA) >= floor)
    return bright, rgb[bright], np.round(DENSE_SCORERS[scorer](whole[bright]) + penalty * (1 - cos_c[bright]), 9)


def alike(frames: list[dict], most: int) -> Iterator[list[dict]]:
    """Runs of up to ``most`` frames of one size: small ones on a small grid are worked on together."""
    i = 0
    while i < len(frames):
        shape = [frames[i][c] for c in ("height", "width", "channels")]
        j = i + 1
        while j < min(len(frames), i + most) and [frames[j][c] for c in ("height", "width", "channels")] == shape and len(frames[i]["data"]) < 1 << 16:
            j += 1
        yield frames[i:j]
        i = j


def check(scorer: str, blend_k: int) -> None:
    if blend_k < 1:
        raise ValueError("blend_k must be at least 1")
    if scorer not in SCORERS:
        raise KeyError(scorer)
    if scorer not in DENSE_SCORERS:
        raise NotImplementedError(scorer)


class Best:
    """The k best observations of each place, whatever the order in which they come; the smaller idx on a tie."""

    def __init__(self, k: int, places: int):
        self.k = k
        self.score = np.full((k, places), np.inf)
        self.who = np.full((k, places), -1, np.int64)
        self.color = np.zeros((k, places, 3))

    def insert(self, at: np.ndarray, idx: int | np.ndarray, score: np.ndarray, color: np.ndarray) -> None:
        """One frame's observations, or one level of others' best; each place once. Overwrites score and color."""
        who = np.broadcast_to(np.asarray(idx, np.int64), len(at)).copy()
        for level in range(self.k):  # insert, and carry on with what was pushed out
            wins = np.flatnonzero((score < self.score[level, at]) | (score == self.score[level, at]) & (who < self.who[level, at]))
            x = at[wins]
            out = self.score[level, x], self.who[level, x], self.color[level, x]
            self.score[level, x], self.who[level, x], self.color[level, x] = score[wins], who[wins], color[wins]
            if level + 1 < self.k:
                score[wins], who[wins], color[wins] = out

    def blended(self, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Colours, and the best one's idx; -1 where nothing was observed."""
        near = np.isfinite(self.score) & (self.score <= self.score[0] * margin + 1e-6)
        weight = np.where(near, 1 / np.maximum(np.where(near, self.score, 1), 1e-6), 0)
        total = weight.sum(0)
        return (weight[..., None] * self.color).sum(0) / np.where(total > 0, total, 1)[:, None], self.who[0]


def observed(discs: DataFrame, height: int, width: int, *, blend_k: int = 1, scorer: str = "rgb", min_cos: float = G.MIN_COS, floor: float = 30, penalty: float = 0.5, batch_rows: int = 4) -> DataFrame:
    """The best observations of each cell that a task saw. discs: idx, lat, lon, cx, cy, radius, height, width, channels, data. batch_rows: frames that a worker gets at once, few as they may be large."""
    check(scorer, blend_k)
    k = blend_k

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.radians(90 - (np.arange(height) + 0.5) / height * 180)
        lon = -180 + (np.arange(width) + 0.5) / width * 360
        sin_p, cos_p = np.sin(p), np.cos(p)
        kept = Best(k, height * width)
        for batch in (b.slice(i, batch_rows) for b in batches for i in range(0, b.num_rows, batch_rows)):
            for group in alike(batch.to_pylist(), max(1, GROUP_CELLS // (height * width))):
                rows, cols = reach(group[0]["lat"], group[0]["lon"], height, width, min_cos) if len(group) == 1 else (np.arange(height), np.arange(width))
                lat0, lon0, cx, cy, radius = (np.array([r[c] for r in group], float) for c in ("lat", "lon", "cx", "cy", "radius"))
                h, w = group[0]["height"], group[0]["width"]
                q, d = np.radians(lat0), np.radians(lon[None, cols] - lon0[:, None])
                sin_q, cos_q, sin_d, cos_d = np.sin(q), np.cos(q), np.sin(d), np.cos(d)
                cos_c = (sin_q[:, None] * sin_p[rows])[:, :, None] + cos_q[:, None, None] * (cos_p[rows][None, :, None] * cos_d[:, None, :])
                # scorers give no less than 0, so the penalty alone rules out most places once a task has seen some frames
                worst = kept.score[k - 1].reshape(height, width)[np.ix_(rows, cols)]
                near = cos_c >= (np.maximum(min_cos, 1 - (worst + 1e-8) / penalty - 1e-12) if penalty > 0 else min_cos)
                frame, cell = np.nonzero(near.reshape(len(group), -1))
                cos_c = cos_c.reshape(len(group), -1)[frame, cell]
                i, j = np.repeat(rows, len(cols))[cell], np.tile(np.arange(len(cols)), len(rows))[cell]
                seen = i * width + cols[j]
                col = cx[frame] + radius[frame] * (cos_p[i] * sin_d[frame, j])
                row = cy[frame] - radius[frame] * (cos_q[frame] * sin_p[i] - sin_q[frame] * (cos_p[i] * cos_d[frame, j]))
                may = (cos_c >= min_cos) & (col >= 0) & (col <= w - 1) & (row >= 0) & (row <= h - 1)
                images = np.concatenate([I.array_of(r)[..., :3] for r in group]) if len(group) > 1 else I.array_of(group[0])[..., :3]
                if len(group) > 1 and scorer in DENSE_LEAST:  # of small frames, so do the levels around a place
                    may = np.flatnonzero(may)
                    least = DENSE_LEAST[scorer](images.reshape(len(group), h, w, 3))[frame[may], row[may].astype(int), col[may].astype(int)]
                    may = may[least + penalty * (1 - cos_c[may]) <= kept.score[k - 1, seen[may]] + 1e-8]
                frame, seen, cos_c, row, col = frame[may], seen[may], cos_c[may], row[may], col[may]
                bright, rgb, now = sampled(images, row + frame * h, col, cos_c, scorer, floor, penalty)
                better = np.flatnonzero(now <= kept.score[k - 1, seen[bright]])
                frame, seen, rgb, now = frame[bright][better], seen[bright][better], rgb[better], now[better]
                cuts = np.searchsorted(frame, np.arange(len(group) + 1))
                for r, a, z in zip(group, cuts, cuts[1:], strict=False):
                    if a < z:
                        kept.insert(seen[a:z], r["idx"], now[a:z], rgb[a:z])
        for level in range(k):
            at = np.flatnonzero(kept.who[level] >= 0)
            for i in range(0, len(at), 50_000):
                x = at[i : i + 50_000]
                place = {"cell_row": (x // width).astype(np.int32), "cell_col": (x % width).astype(np.int32)}
                yield pa.RecordBatch.from_pydict({**place, "idx": kept.who[level, x], "score": kept.score[level, x], **{c: np.ascontiguousarray(kept.color[level, x, j]) for j, c in enumerate("rgb")}})

    ship(discs.sparkSession)
    return discs.mapInArrow(each, SEEN)


def winners(seen: DataFrame) -> DataFrame:
    """The observation of least score for each cell; the smaller idx on a tie."""
    best = F.min_by(F.struct("idx", "r", "g", "b", "score"), F.struct("score", "idx")).alias("w")
    return seen.groupBy("cell_row", "cell_col").agg(best).select("cell_row", "cell_col", "w.*")


def blend(seen: DataFrame, k: int = 3, margin: float = 1.5) -> DataFrame:
    """Means weighted by 1 / score over the k best whose score is within the margin of the least; idx is the best one's."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = W.partitionBy("cell_row", "cell_col")
    ranked = seen.withColumn("rank", F.row_number().over(w.orderBy("score", "idx"))).where(F.col("rank") <= k)
    near = ranked.withColumn("best", F.min("score").over(w)).where(F.col("score") <= F.col("best") * margin + 1e-6)
    weight = F.lit(1.0) / F.greatest("score", F.lit(1e-6))
    mean = lambda c: (F.sum(F.col(c) * weight) / F.sum(weight)).alias(c)
    return near.groupBy("cell_row", "cell_col").agg(F.min_by("idx", "rank").alias("idx"), mean("r"), mean("g"), mean("b"), F.count("*").alias("n"))


def coverage(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.agg(F.count("*").alias("covered"), (F.count("*") / F.lit(float(height * width))).alias("share"))


def sample(points: DataFrame, grid: DataFrame, height: int, width: int, nearest: bool = False) -> DataFrame:
    """points (id, lat, lon) with r, g, b from the grid (cell_row, cell_col, r, g, b); columns wrap, rows stop at the poles.

    Bilinear: four taps, each an equi-join key, summed up by weight; empty cells count as black. Nearest: one tap; empty cells give nulls.
    """
    row, col = G.cell_at(F.col("lat"), F.col("lon"), height, width)
    placed = points.withColumns({"fr": F.least(F.greatest(row, F.lit(0.0)), F.lit(height - 1.0)), "fc": col})
    if nearest:
        taps = placed.select("id", F.rint("fr").cast("int").alias("cell_row"), F.pmod(F.rint("fc").cast("int"), F.lit(width)).alias("cell_col"))
        return taps.join(grid.select("cell_row", "cell_col", "r", "g", "b"), ["cell_row", "cell_col"], "left").select("id", "r", "g", "b")
    r0, c0 = F.floor("fr").cast("int"), F.floor("fc").cast("int")
    tap = lambda dr, dc: F.struct(
        F.least(r0 + dr, F.lit(height - 1)).alias("cell_row"), F.pmod(c0 + dc, F.lit(width)).alias("cell_col"),
        (_share(F.col("fr") - r0, dr) * _share(F.col("fc") - c0, dc)).alias("w"),
    )
    taps = placed.select("id", F.explode(F.array(*(tap(i, j) for i in (0, 1) for j in (0, 1)))).alias("t")).select("id", "t.*")
    joined = taps.join(grid.select("cell_row", "cell_col", "r", "g", "b"), ["cell_row", "cell_col"], "left")
    return joined.groupBy("id").agg(*(F.sum(F.col("w") * F.coalesce(c, F.lit(0))).alias(c) for c in ("r", "g", "b")))


def _share(fraction: Column, side: int) -> Column:
    return fraction if side else F.lit(1.0) - fraction
