"""Rotation frames to pixel art: graded once, made small, with one palette for all frames of a size."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.functions import text as T
from lumidisc.raster import kernels as K
from lumidisc.sinks import gif, png
from lumidisc.sinks.files import land, link_latest, manifest
from lumidisc.sinks.landing import land_files
from lumidisc.sinks.sheets import contact_sheet
from lumidisc.sources import images as I


@dataclass(frozen=True)
class SpriteSettings:
    sizes: tuple[int, ...] = (32, 64, 128)
    stylize: float = 1.0
    saturation_boost: float = 1.8
    gamma: float = 2.4
    contrast: float = 0.35
    black_point: float = 0.05
    land_green: float = 1.0
    colors: int = 32
    dither: bool = False
    downsample: str = "nearest"
    supersample: int = 1
    display_scale: int | None = None
    shared_palette: bool = True


def display_scale(size: int, target: int = 512) -> int:
    return max(1, round(target / size))


def parse_sizes(text: str) -> tuple[int, ...]:
    sizes = tuple(int(x) for x in text.split(",") if x.strip())
    if not sizes or min(sizes) < 1:
        raise ValueError(f"no sizes: {text!r}")
    return sizes


def dense_grade(rgb: np.ndarray, s: SpriteSettings) -> np.ndarray:
    """The grade of functions.color on arrays."""
    if s.stylize <= 0:
        return rgb
    x = rgb.astype(float) / 255
    v = x.max(-1)
    d = v - x.min(-1)
    sat = np.divide(d, v, out=np.zeros_like(v), where=v > 0)
    safe = np.where(d == 0, 1, d)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.where(d == 0, 0, np.where(v == r, np.mod((g - b) / safe, 6), np.where(v == g, (b - r) / safe + 2, (r - g) / safe + 4))) / 6
    away = np.abs(np.mod(hue - 35 / 360 + 0.5, 1) - 0.5)
    weight = np.clip(1 - away / (35 / 360), 0, 1) * np.clip((sat - 0.12) / 0.15, 0, 1) * np.clip((0.55 - v) / (0.55 - 0.28), 0, 1) * s.land_green
    hue = np.mod(hue + weight * 0.25, 1)
    sat = np.clip(1 - (1 - sat) ** (1 + s.saturation_boost), 0, 1)
    v = np.clip((v - s.black_point) / max(1e-6, 1 - s.black_point), 0, 1) ** (1 / max(1e-6, s.gamma))
    v = np.clip(0.5 + (v - 0.5) * (1 + s.contrast), 0, 1)

    def channel(n: float) -> np.ndarray:
        k = np.mod(n + hue * 6, 6)
        return (v - v * sat * np.clip(np.minimum(k, 4 - k), 0, 1)) * 255

    graded = np.stack([channel(n) for n in (5, 3, 1)], -1)
    return K.to_uint8(rgb * (1 - s.stylize) + graded * s.stylize)


def frames_folder(path: str) -> str:
    inner = os.path.join(path, "turntable", "frames")
    return inner if os.path.isdir(inner) else path


def small_frames(spark: SparkSession, folder: str, s: SpriteSettings) -> DataFrame:
    """name, size and the small RGBA of each frame and size; each frame is decoded and graded once. Frames that can't be decoded go."""
    images = I.read_images(spark, [os.path.join(folder, f) for f in sorted(os.listdir(folder)) if f.endswith(".png")], alpha=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["height"] < 0:
                    continue
                rgba = I.array_of(r)
                rgba = np.dstack((dense_grade(rgba[..., :3], s), rgba[..., 3]))
                small = [K.downsample(rgba, size, s.downsample, s.supersample).tobytes() for size in s.sizes]
                yield pa.RecordBatch.from_pydict({"name": [os.path.basename(r["path"])] * len(small), "size": pa.array(s.sizes, pa.int32()), "data": small})

    return images.mapInArrow(each, "name string, size int, data binary")


def palettes(small: DataFrame, s: SpriteSettings) -> dict[int, np.ndarray]:
    """A palette for each size from the colours of all its frames, counted by tasks and then together. Transparent pixels count, as they do for single frames."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, data in zip(batch.column("size").to_pylist(), batch.column("data").to_pylist(), strict=True):
                colors, n = np.unique(np.frombuffer(data, np.uint8).reshape(-1, 4)[:, :3].astype(np.int32) @ (65536, 256, 1), return_counts=True)
                yield pa.RecordBatch.from_pydict({"size": pa.array([size] * len(n), pa.int32()), "color": pa.array(colors, pa.int32()), "n": n})

    counted = small.mapInArrow(each, "size int, color int, n bigint").groupBy("size", "color").agg(F.sum("n").alias("n"))
    box = counted.withColumn("box", F.expr("(color div 524288) * 1024 + (color div 2048 % 32) * 32 + color div 8 % 32"))  # at most 32768 a size reach the driver
    rows = box.groupBy("size", "box").agg(F.sum("n").alias("n"), *((F.sum(F.expr(e) * F.col("n")) / F.sum("n")).alias(c) for c, e in (("r", "color div 65536"), ("g", "color div 256 % 256"), ("b", "color % 256")))).orderBy("size", "box").collect()
    out = {}
    for size in s.sizes:
        own = [r for r in rows if r["size"] == size]
        out[size] = K.median_cut(np.array([[r["r"], r["g"], r["b"]] for r in own]).reshape(-1, 3), np.array([r["n"] for r in own]), s.colors)
    return out


def finish(rgba: np.ndarray, s: SpriteSettings, size: int, palette: np.ndarray | None) -> np.ndarray:
    if palette is None:
        colors, n = np.unique(rgba[..., :3].reshape(-1, 3), axis=0, return_counts=True)
        palette = K.median_cut(colors, n, s.colors)
    rgb = K.quantize(rgba[..., :3], palette, s.dither)
    return K.upscale(np.dstack((rgb, rgba[..., 3])), s.display_scale or display_scale(size))


def render_all(spark: SparkSession, source: str, out_root: str, s: SpriteSettings = SpriteSettings(), *, write_gif: bool = True, write_sheet: bool = True, on_progress: Callable[[int, None, str], None] | None = None) -> tuple[str, DataFrame]:
    """The run's folder, and a row for each size. on_progress: called with frames done, no total, and a name."""
    if s.downsample not in ("nearest", "box"):
        raise ValueError(f"unknown method {s.downsample!r}")
    folder = frames_folder(os.path.abspath(source))
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    if not any(f.endswith(".png") for f in os.listdir(folder)):
        raise FileNotFoundError(f"no frames in {folder}")
    run = os.path.join(os.path.abspath(out_root), T.run_id(source=folder, settings=asdict(s)))
    I.small_batches(spark)
    small_frames(spark, folder, s).write.mode("overwrite").parquet(os.path.join(run, "small"))
    small = spark.read.parquet(os.path.join(run, "small"))
    shared = palettes(small, s) if s.shared_palette else {}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = r["size"]
                out = finish(np.frombuffer(r["data"], np.uint8).reshape(size, size, 4), s, size, shared.get(size))
                yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "name": [r["name"]], "output_size": pa.array([out.shape[0]], pa.int32()), "content": [png.encode(out)]})

    # finished once, as a table; its frames then land as files, written by tasks
    table = os.path.join(run, "finished")
    small.mapInArrow(each, "size int, name string, output_size int, content binary").write.mode("overwrite").parquet(table)
    finished = spark.read.parquet(table)
    land_files(finished.select(F.concat_ws("/", F.col("size").cast("string"), "name").alias("path"), "content"), run)
    done = [tuple(r) for r in finished.select("size", "name", "output_size").collect()]  # names of the frames
    for i, (_, name, _) in enumerate(done if on_progress else (), 1):
        on_progress(i, None, name)
    report = spark.createDataFrame(done, "size int, name string, output_size int").groupBy("size").agg(F.count("*").alias("frames"), F.max("output_size").alias("output_size")).orderBy("size")
    for size in s.sizes:
        names = sorted(name for own, name, _ in done if own == size)
        images = lambda size=size, names=names: (png.decode(open(os.path.join(run, str(size), n), "rb").read()) for n in names)
        if write_sheet and names:
            land(os.path.join(run, f"sheet_{size}.png"), png.encode(contact_sheet(images(), len(names))))
        if write_gif and names:
            land(os.path.join(run, f"rotation_{size}.gif"), gif.encode(images))
    manifest(os.path.join(run, "manifest.json"), run_id=os.path.basename(run), created=dt.datetime.now(dt.UTC).isoformat(), source=folder, settings=asdict(s), sizes=[r.asDict() for r in report.collect()])
    link_latest(run)
    return run, report
