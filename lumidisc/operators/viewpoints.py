"""Viewpoints that are composed each from its own candidates, while frames are read once, where they lie.

A task streams its frames and keeps, for the viewpoints that they serve, the ``blend_k`` best observations of each pixel, by tiles of
a viewpoint's disc. The best of two sets of frames are the best of each set's best, so tiles merge: they are shuffled by viewpoint and
tile, and no image is. A frame meets all its viewpoints in one row, so its bytes are handed to a worker once.

A task holds ``held`` bytes of tiles; beyond that the tile that was used longest ago is sent on as it is, and begun anew when it is
needed again. What is shuffled is thus at most one tile for each frame and viewpoint, without what other frames of the task surpass.

Defined cases: the smaller rank wins a tie; a viewpoint none of whose frames shows anything has empty tiles; a viewpoint
without frames, and a frame without viewpoints, have no rows; repeated frames change nothing but the blend's weights.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.operators import composite
from lumidisc.raster import kernels as K
from lumidisc.session import ship
from lumidisc.sources import images as I

#: Pixels of a tile; places in it are 16-bit numbers.
TILE = 1 << 16
#: Bytes of tiles that a task holds.
HELD = 256 << 20
STATES = "vp int, tile int, place binary, who binary, score binary, rgb binary"


@lru_cache(maxsize=4)
def disc(radius: int, margin: float) -> tuple[int, np.ndarray]:
    """Half the side of a viewpoint's image, and the positions of its disc's pixels in row order."""
    half = round(radius * margin)
    row, col = np.divmod(np.arange(4 * half * half), 2 * half)
    return half, np.flatnonzero(np.hypot((col - half) / radius, (half - row) / radius) <= 1)


def asked(views: DataFrame, frame: str = "image") -> DataFrame:
    """From (vp, vp_lon, rank, frame) to a row for each frame, with the viewpoints that it serves; as many as there are viewpoints at most."""
    return views.groupBy(frame).agg(F.collect_list(F.struct("vp", "vp_lon", "rank")).alias("serves"))


class Tile:
    """The best observations of a run of a disc's pixels."""

    def __init__(self, s, lon0: float, number: int):
        half, places = disc(s.radius, s.margin)
        row, col = np.divmod(places[number * TILE : (number + 1) * TILE], 2 * half)
        self.lat, self.lon, _ = composite.dense_unproject(col.astype(float), row.astype(float), s.lat0, lon0, half, half, s.radius)
        self.kept = composite.Best(s.blend_k, len(row))

    def bytes(self) -> int:
        return len(self.lat) * (16 + 40 * self.kept.k)

    def see(self, frame: dict, image: np.ndarray, rank: int, s) -> None:
        x, y, cos_c = composite.dense_project(self.lat, self.lon, *(frame[c] for c in ("lat", "lon", "cx", "cy", "radius")))
        there = np.flatnonzero((cos_c >= s.min_cos) & (x >= 0) & (x <= frame["width"] - 1) & (y >= 0) & (y <= frame["height"] - 1))
        # scorers give no less than 0, so the penalty alone rules places out
        there = there[s.obliqueness_penalty * (1 - cos_c[there]) <= self.kept.score[-1, there] + 1e-8]
        bright, rgb, score = composite.sampled(image, y[there], x[there], cos_c[there], s.scorer, s.luminance_floor, s.obliqueness_penalty)
        self.kept.insert(there[bright], rank, score, rgb)

    def rows(self, vp: int, number: int, kind: str) -> Iterator[dict]:
        """One for each level of the best that holds something; the first always."""
        for level in range(self.kept.k):
            at = np.flatnonzero(self.kept.who[level] >= 0)
            if len(at) or not level:
                rgb = self.kept.color[level, at]
                yield {
                    "vp": vp, "tile": number, "place": at.astype("<u2").tobytes(), "who": self.kept.who[level, at].astype("<i4").tobytes(), "score": self.kept.score[level, at].astype("<f8").tobytes(),
                    "rgb": (K.to_uint8(rgb) if kind == "u1" else rgb.astype(kind)).tobytes(),
                }


_SCHEMA = pa.schema([("vp", pa.int32()), ("tile", pa.int32()), *((c, pa.binary()) for c in ("place", "who", "score", "rgb"))])


def states(frames: DataFrame, s, *, whole: bool = False, held: int = HELD) -> DataFrame:
    """Tiles as the tasks saw them. frames: serves, lat, lon, cx, cy, radius, height, width, channels, data. whole: colours as whole levels, for one best observation without a blend."""
    composite.check(s.scorer, s.blend_k)
    if whole and s.blend_k > 1:
        raise ValueError("a blend needs exact colours")
    kind = "u1" if whole else "<f8"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: OrderedDict[tuple[int, int], Tile] = OrderedDict()
        room, n = held, -(-len(disc(s.radius, s.margin)[1]) // TILE)
        send = lambda key: pa.RecordBatch.from_pylist(list(tiles.pop(key).rows(*key, kind)), _SCHEMA)
        for batch in (b.slice(i, 4) for b in batches for i in range(0, b.num_rows, 4)):
            for frame in batch.to_pylist():
                image = I.array_of(frame)[..., :3]
                for v in frame["serves"]:
                    for key in ((v["vp"], i) for i in range(n)):
                        if key not in tiles:
                            tiles[key] = Tile(s, v["vp_lon"], key[1])
                            room -= tiles[key].bytes()
                        tiles.move_to_end(key)
                        tiles[key].see(frame, image, v["rank"], s)
                        while room < 0 and len(tiles) > 1:
                            oldest = next(iter(tiles))
                            room += tiles[oldest].bytes()
                            yield send(oldest)
        while tiles:
            yield send(next(iter(tiles)))

    ship(frames.sparkSession)
    columns = ("serves", "lat", "lon", "cx", "cy", "radius", "height", "width", "channels", "data")
    return frames.select(*columns).mapInArrow(each, STATES)


def merged(seen: DataFrame, s, finish: Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], dict], schema: str, *, whole: bool = False) -> DataFrame:
    """Tiles as all frames give them. finish: from viewpoint, tile, positions in the image, colours and ranks of the best (-1: none) to columns. A task streams a tile's states."""
    kind = "u1" if whole else "<f8"

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vp, number = (k.as_py() for k in key)
        places = disc(s.radius, s.margin)[1][number * TILE : (number + 1) * TILE]
        kept = composite.Best(s.blend_k, len(places))
        for batch in (b.slice(i, 4) for b in batches for i in range(0, b.num_rows, 4)):
            for r in batch.to_pylist():
                read = lambda c, dtype: np.frombuffer(r[c], dtype)  # noqa: E731, B023
                kept.insert(read("place", "<u2").astype(np.int64), read("who", "<i4").astype(np.int64), read("score", "<f8").copy(), read("rgb", kind).reshape(-1, 3).astype(float))
        yield pa.RecordBatch.from_pydict(finish(vp, number, places, *kept.blended(s.blend_margin)))

    return seen.groupBy("vp", "tile").applyInArrow(each, schema)


def pixels(seen: DataFrame, s) -> DataFrame:
    """vp, row, col, contributor (rank), r, g, b of the pixels that some frame shows, with exact colours."""
    side = 2 * disc(s.radius, s.margin)[0]

    def finish(vp: int, number: int, places: np.ndarray, colors: np.ndarray, who: np.ndarray) -> dict:
        at = np.flatnonzero(who >= 0)
        row, col = np.divmod(places[at].astype(np.int32), np.int32(side))
        return {"vp": pa.array([vp] * len(at), pa.int32()), "row": row, "col": col, "contributor": who[at].astype(np.int32), **{c: np.ascontiguousarray(colors[at, i]) for i, c in enumerate("rgb")}}

    return merged(seen, s, finish, "vp int, row int, col int, contributor int, r double, g double, b double")


def images(seen: DataFrame, s, *, whole: bool = False) -> DataFrame:
    """vp, rgba, contributor (16-bit ranks, -1 for none) and suspect_fraction, the share of the disc that nothing shows. Tiles are laid into an image at 6 bytes a pixel."""

    def finish(vp: int, number: int, places: np.ndarray, colors: np.ndarray, who: np.ndarray) -> dict:
        rgba = np.column_stack((K.to_uint8(colors), np.where(who >= 0, 255, 0).astype(np.uint8)))
        rgba[who < 0] = 0
        return {"vp": pa.array([vp], pa.int32()), "tile": pa.array([number], pa.int32()), "rgba": [rgba.tobytes()], "contributor": [who.astype("<i2").tobytes()]}

    def lay(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, places = disc(s.radius, s.margin)
        rgba, who = np.zeros((4 * half * half, 4), np.uint8), np.full(4 * half * half, -1, "<i2")
        for batch in batches:
            for r in batch.to_pylist():
                at = places[r["tile"] * TILE : (r["tile"] + 1) * TILE]
                rgba[at], who[at] = np.frombuffer(r["rgba"], np.uint8).reshape(-1, 4), np.frombuffer(r["contributor"], "<i2")
        suspect = float((who[places] < 0).sum() / max(1, len(places)))
        yield pa.RecordBatch.from_pydict({"vp": pa.array([key[0].as_py()], pa.int32()), "rgba": [rgba.tobytes()], "contributor": [who.tobytes()], "suspect_fraction": [suspect]})

    tiles = merged(seen, s, finish, "vp int, tile int, rgba binary, contributor binary", whole=whole)
    return tiles.groupBy("vp").applyInArrow(lay, "vp int, rgba binary, contributor binary, suspect_fraction double")
