"""A mirror to a turning globe: candidates, geometry, one reference grid, and a frame for each viewpoint.

Frames stream through the compositor one at a time: a task keeps the best observation (or
the ``blend_k`` best) of each cell over all frames it reads and sends those cells on, once. So
memory is the grid's, not the frames', and what is shuffled is at most a grid a task.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.functions import geo as G
from lumidisc.functions import text as T
from lumidisc.functions.color import SCORERS
from lumidisc.operators import candidates, composite, viewpoints
from lumidisc.operators.composite import dense_project, dense_score, dense_unproject  # noqa: F401  of the plan too
from lumidisc.plans import geometry
from lumidisc.plans.segment_batch import Settings
from lumidisc.raster import kernels as K
from lumidisc.session import checkpointed
from lumidisc.sinks import gif, png
from lumidisc.sinks.files import land, link_latest, manifest
from lumidisc.sinks.landing import land_files
from lumidisc.sinks.sheets import contact_sheet
from lumidisc.sources import images as I
from lumidisc.sources import metadata

#: Cells of a grid that may be sent to all workers.
MOST_CELLS = 16_000_000
#: Files with their places, and pairs of a frame and a viewpoint, that are sent to all workers (tens of MB); more are joined by key.
MOST_FILES, MOST_PAIRS = 100_000, 1_000_000


@dataclass(frozen=True)
class TurntableSettings:
    lat0: float = 0.0
    frames: int = 72
    radius: int = 800
    margin: float = 1.08
    min_cos: float = G.MIN_COS
    luminance_floor: float = 30
    obliqueness_penalty: float = 0.5
    blend_k: int = 1
    blend_margin: float = 1.5
    max_candidates: int = 48
    reference_scale: float = 4
    scorer: str = "rgb"
    collection: str = "natural"
    form: str = "png"
    segmentation: Settings = field(default_factory=Settings)

    def grid(self) -> tuple[int, int]:
        """Height and width of the reference grid."""
        width = max(2, round(self.radius * self.reference_scale))
        return width // 2, width


def gather(spark: SparkSession, root: str, s: TurntableSettings) -> DataFrame:
    """Frames that some viewpoint can use, each once, with idx in the order that viewpoints first meet them, and where their files are."""
    frames = metadata.frame_index(spark, root, s.collection).withColumn("event_id", F.xxhash64("image"))
    near = candidates.nearest_frames(frames, candidates.viewpoints(spark, s.frames, s.lat0), s.max_candidates, 2 * G.cap_radius(s.min_cos))
    once = candidates.union_frames(near).selectExpr("image", "row_number() OVER (ORDER BY vp, rank) - 1 AS idx")  # at most frames * max_candidates rows
    return metadata.located(frames.dropDuplicates(["image"]).join(once, "image"), root, s.form).select("idx", "collection", "image", "lat", "lon", "path")


def views(spark: SparkSession, root: str, s: TurntableSettings) -> DataFrame:
    """(vp, vp_lon, rank, image): the candidates of each viewpoint, nearest first."""
    frames = metadata.frame_index(spark, root, s.collection).withColumn("event_id", F.xxhash64("image"))
    around = candidates.viewpoints(spark, s.frames, s.lat0)
    near = candidates.nearest_frames(frames, around, s.max_candidates, 2 * G.cap_radius(s.min_cos))
    return near.join(F.broadcast(around), "vp").select("vp", "vp_lon", "rank", "image")


def discs(spark: SparkSession, root: str, s: TurntableSettings, wanted: DataFrame) -> tuple[DataFrame, int, int]:
    """wanted with the discs' places and the images' bytes; how many files there are, and how many were segmented now. Only files with a proper disc are read."""
    files = metadata.inventory(spark, f"{root}/{s.collection}").select("path")
    there = checkpointed(wanted.where(F.col("path").isNotNull()).join(files, "path"))  # at most frames * max_candidates names
    n = there.count()
    if not n:
        return there.selectExpr("*", "0D AS cx", "0D AS cy", "0D AS radius", "0 AS height", "0 AS width", "0 AS channels", "X'' AS data").limit(0), 0, 0
    found, new = geometry.located(spark, root, there, s.segmentation)
    found = checkpointed(found)
    paths = [r["path"] for r in found.select("path").distinct().collect()]
    if not paths:
        return there.selectExpr("*", "0D AS cx", "0D AS cy", "0D AS radius", "0 AS height", "0 AS width", "0 AS channels", "X'' AS data").limit(0), n, new
    return I.read_images(spark, paths).join(F.broadcast(found) if n <= MOST_FILES else found, "path").where("height > 0"), n, new


def reference_grid(discs: DataFrame, height: int, width: int, s: TurntableSettings) -> DataFrame:
    """cell, idx, r, g, b: decided once for all viewpoints."""
    seen = composite.observed(discs, height, width, blend_k=s.blend_k, scorer=s.scorer, min_cos=s.min_cos, floor=s.luminance_floor, penalty=s.obliqueness_penalty)
    best = composite.winners(seen) if s.blend_k == 1 else composite.blend(seen, s.blend_k, s.blend_margin)
    cell = (F.col("cell_row") * width + F.col("cell_col")).alias("cell")
    return best.select(cell, "idx", *(F.least(F.greatest(F.rint(c), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in "rgb"))


def render(grid: np.ndarray, covered: np.ndarray, lon0: float, s: TurntableSettings) -> tuple[np.ndarray, float]:
    """RGBA of a viewpoint, and the share of its disc that nothing covers."""
    half, col, row = canvas(s)
    lat, lon, on = dense_unproject(col, row, s.lat0, lon0, half, half, s.radius)
    height, width = covered.shape
    fr, fc = (90 - lat) / 180 * height - 0.5, np.mod((lon + 180) / 360 * width - 0.5, width)
    rgb = K.to_uint8(K.bilinear(grid, fr, fc, wrap=True))
    there = covered[np.clip(np.rint(fr), 0, height - 1).astype(int), np.rint(fc).astype(int) % width] & on
    rgba = np.dstack((rgb, np.where(there, 255, 0).astype(np.uint8)))
    rgba[~there] = 0
    return rgba, float((on & ~there).sum() / max(1, on.sum()))


def canvas(s: TurntableSettings) -> tuple[int, np.ndarray, np.ndarray]:
    """Half the side of a viewpoint's image, and the columns and rows of its pixels."""
    half = round(s.radius * s.margin)
    row, col = np.mgrid[0 : 2 * half, 0 : 2 * half].astype(float)
    return half, col, row


def render_views(seen: DataFrame, s: TurntableSettings) -> DataFrame:
    """vp, rgba, contributor (16-bit ranks, -1 for none) and suspect_fraction of each viewpoint. seen: vp, vp_lon, rank and a disc in each row."""
    return render_frames(seen.withColumn("serves", F.array(F.struct("vp", "vp_lon", "rank"))), s)


def render_frames(frames: DataFrame, s: TurntableSettings) -> DataFrame:
    """The same from rows of a frame each, with the viewpoints that it serves."""
    whole = s.blend_k == 1
    return viewpoints.images(viewpoints.states(frames, s, whole=whole), s, whole=whole)


def render_independent(spark: SparkSession, root: str, s: TurntableSettings = TurntableSettings()) -> DataFrame:
    """Viewpoints composed one by one, without a reference grid: sharper choices for a single view; neighbours in a rotation may differ. A frame is read once, whatever the number of viewpoints that use it."""
    I.small_batches(spark)
    root = os.path.abspath(root)
    found, _, _ = discs(spark, root, s, gather(spark, root, s))
    serves = viewpoints.asked(views(spark, root, s))
    if s.frames * s.max_candidates <= MOST_PAIRS:
        serves = F.broadcast(serves)
    return render_frames(found.drop("idx").join(serves, "image"), s)


def render_all(spark: SparkSession, root: str, out_root: str, s: TurntableSettings = TurntableSettings(), *, write_gif: bool = True, write_sheet: bool = True, on_progress: Callable[[int, int, str], None] | None = None) -> tuple[str, DataFrame]:
    """The run's folder, and suspect shares by frame. on_progress: called with frames done, all frames and a name, as tasks end."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    if s.scorer not in SCORERS:
        raise KeyError(s.scorer)
    I.small_batches(spark)
    root, (height, width) = os.path.abspath(root), s.grid()
    if height * width > MOST_CELLS:
        raise ValueError(f"a grid of {height} x {width} cells is too large to send to workers")
    run = os.path.join(os.path.abspath(out_root), T.run_id(root=root, settings=asdict(s)))
    grid_path = os.path.join(run, "grid")
    found, files, segmented = discs(spark, root, s, gather(spark, root, s))
    reference_grid(found, height, width, s).write.mode("overwrite").parquet(grid_path)
    cells = spark.read.parquet(grid_path).toPandas()  # bounded by MOST_CELLS
    grid, covered = np.zeros((height * width, 3), np.uint8), np.zeros(height * width, bool)
    grid[cells["cell"]], covered[cells["cell"]] = cells[["r", "g", "b"]].to_numpy(), True
    sent = spark.sparkContext.broadcast((grid.reshape(height, width, 3), covered.reshape(height, width)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rgba, suspect = render(*sent.value, r["vp_lon"], s)
                yield pa.RecordBatch.from_pydict({"frame": pa.array([r["vp"]], pa.int32()), "name": [f"frame_{r['vp']:03d}.png"], "suspect_fraction": [suspect], "content": [png.encode(rgba)]})

    # rendered once, as a table; its frames then land as files, written by tasks
    table = os.path.join(run, "rendered")
    candidates.viewpoints(spark, s.frames, s.lat0).repartition(s.frames, "vp").mapInArrow(each, "frame int, name string, suspect_fraction double, content binary").write.mode("overwrite").parquet(table)
    rendered = spark.read.parquet(table)
    land_files(rendered.select(F.concat(F.lit("frames/"), "name").alias("path"), "content"), run)
    rows = [r.asDict() for r in rendered.select("frame", "name", "suspect_fraction").collect()]  # numbers of a rotation's frames
    for i, r in enumerate(rows if on_progress else (), 1):
        on_progress(i, s.frames, r["name"])
    rows.sort(key=lambda r: r["frame"])
    report = spark.createDataFrame([tuple(r.values()) for r in rows], "frame int, name string, suspect_fraction double").orderBy("frame")
    images = lambda: (png.decode(open(os.path.join(run, "frames", r["name"]), "rb").read()) for r in rows)
    if write_sheet and rows:
        land(os.path.join(run, "sheet.png"), png.encode(contact_sheet(images(), len(rows))))
    if write_gif and rows:
        land(os.path.join(run, "rotation.gif"), gif.encode(images))
    manifest(
        os.path.join(run, "manifest.json"), run_id=os.path.basename(run), created=dt.datetime.now(dt.UTC).isoformat(), mirror_root=root, settings=asdict(s), candidates=files, segmented=segmented,
        reference_coverage=float(covered.mean()), mean_suspect_fraction=float(np.mean([r["suspect_fraction"] for r in rows])) if rows else 0.0, frames=rows,
    )
    link_latest(run)
    return run, report
