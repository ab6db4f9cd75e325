"""A folder of images to cutouts, overlays, an outcome table and a manifest; a finished image is never done again."""

from __future__ import annotations

import datetime as dt
import itertools
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidisc.functions import text as T
from lumidisc.operators.segmentation import status_counts
from lumidisc.raster import kernels as K
from lumidisc.session import checkpointed
from lumidisc.sinks import png
from lumidisc.sinks.files import link_latest, manifest
from lumidisc.sinks.landing import land_files
from lumidisc.sources import images as I

SCHEMA = "input string, status string, output string, threshold int, left int, top int, right int, bottom int, coverage double, fill double, aspect double, needs_review boolean, error string"
_ARROW = pa.schema([("input", pa.string()), ("status", pa.string()), ("output", pa.string()), ("threshold", pa.int32()), *((c, pa.int32()) for c in ("left", "top", "right", "bottom")), *((c, pa.float64()) for c in ("coverage", "fill", "aspect")), ("needs_review", pa.bool_()), ("error", pa.string())])

_MADE = pa.schema([*_ARROW, ("cutout", pa.binary()), ("overlay", pa.binary())])


@dataclass(frozen=True)
class Settings:
    threshold: int | None = None
    sigma: float = 1.0
    edge: int = 0
    holes: bool = True
    one: bool = True
    pad: int = 0
    min_area: float = 0.001


def outcomes(images: DataFrame, settings: Settings, overlays: bool = True, dry_run: bool = False) -> DataFrame:
    """A row for each decoded image (path, relative, ...), with the bytes of its cutout and overlay."""
    keywords = asdict(settings)

    def one(r: dict) -> dict:
        out = dict.fromkeys(_MADE.names) | {"input": r["relative"], "needs_review": True}
        if r["height"] < 0:
            return out | {"status": "failed", "error": "cannot be decoded"}
        image = I.array_of(r)
        s = K.segment(image, **keywords)
        out |= {"threshold": s.threshold, "coverage": s.coverage, "fill": s.fill, "aspect": s.aspect, "needs_review": not s.is_disc}
        if s.box is None:
            return out | {"status": "empty"}
        out |= dict(zip(("left", "top", "right", "bottom"), s.box, strict=True)) | {"output": f"cutouts/{r['relative']}.png"}
        if dry_run:
            return out | {"status": "dry-run"}
        return out | {"status": "ok", "cutout": png.encode(K.cutout(image, s)), "overlay": png.encode(K.overlay(image, s)) if overlays else None}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.to_pylist()], _MADE)

    return images.mapInArrow(each, f"{SCHEMA}, cutout binary, overlay binary")


#: Files of one micro-batch: their names are all that the driver ever holds.
FILES_PER_BATCH = 1000


class Outcomes:
    """The outcome table of a run: a folder for each batch, which a batch that is made again replaces."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run, self.path = spark, run, os.path.join(run, "outcomes")

    def read(self) -> DataFrame:
        schema = SCHEMA + ", batch int"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        """Images are segmented once, into a table with the files' bytes; the files land, then the outcomes are told."""
        made, place = os.path.join(self.run, "made"), os.path.join(self.path, f"batch={batch}")
        rows.write.mode("overwrite").parquet(made)
        rows = self.spark.read.schema(f"{SCHEMA}, cutout binary, overlay binary").parquet(made)
        files = F.array(F.struct(F.col("output").alias("path"), F.col("cutout").alias("content")), F.struct(F.concat(F.lit("overlays/"), "input", F.lit(".png")).alias("path"), F.col("overlay").alias("content")))
        land_files(rows.select(F.inline(files)).where("content IS NOT NULL"), self.run)
        rows.select(*_ARROW.names).write.mode("overwrite").parquet(place)
        rows.limit(0).write.mode("overwrite").parquet(made)  # the bytes are in the files now
        return self.spark.read.schema(SCHEMA).parquet(place)


def process(
    spark: SparkSession, source: str, out_root: str, settings: Settings = Settings(), *, recursive: bool = False, overlays: bool = True, force: bool = False, dry_run: bool = False,
    on_progress: Callable[[int, int, str], None] | None = None, files_per_batch: int = FILES_PER_BATCH,
) -> tuple[str, DataFrame]:
    """The run's folder and its outcomes, of this and of earlier calls.

    New files come as a stream that ends when all are done. Its checkpoint, in the run's folder, knows which files were taken, and a micro-batch's outcomes are one folder of the
    table, named by the batch; so a call that breaks off is taken up by the next one where it stopped, the batch that was under way is made again in its place, and
    no image has two outcomes of a call. Images without an ok outcome are tried again by each call, all images if ``force``.
    Cutouts and overlays land by ``sinks.landing``. on_progress: called with images done now, all of them, and a name.
    """
    if not os.path.isdir(source):
        raise NotADirectoryError(source)
    I.small_batches(spark)
    source = os.path.abspath(source)
    ident = T.run_id(source=source, settings=asdict(settings), recursive=recursive)
    run = os.path.join(os.path.abspath(out_root), ident)
    listed = I.find_images(spark, source, recursive)
    table = Outcomes(spark, run)
    before = checkpointed(table.read())  # as it was: the table grows below
    ok = before.where("status = 'ok'").select(F.col("input").alias("relative"))
    todo = listed if force else listed.join(ok, "relative", "left_anti")
    if dry_run:
        images = I.read_images(spark, source, recursive).join(todo.select("path", "relative"), "path")
        return run, outcomes(images, settings, overlays, True).select(*_ARROW.names).unionByName(skipped(before, listed, todo))
    total, mine, state = (todo.count() if on_progress else 0), [], {"done": 0}

    def make(files: list[tuple[str, str]], batch: int) -> None:
        """files: path and relative of up to ``files_per_batch`` images."""
        names = spark.createDataFrame(files, "path string, relative string")
        images = I.read_images(spark, [path for path, _ in files]).join(F.broadcast(names), "path")
        rows = table.write(outcomes(images, settings, overlays), batch)
        mine.append(batch)
        for r in rows.select("input").toLocalIterator() if on_progress else ():
            state["done"] += 1
            on_progress(state["done"], total, r["input"])

    def arrived(files: DataFrame, batch: int) -> None:
        # a batch that is made again has outcomes already, which don't count; other batches' do
        known = before.where(f"status = 'ok' AND batch <> {batch}").select(F.col("input").alias("relative"))
        rows = files if force else files.join(known, "relative", "left_anti")
        if found := [tuple(r) for r in rows.select("path", "relative").collect()]:
            make(found, batch)

    stream = I.new_images(spark, source, recursive, files_per_batch)
    stream.writeStream.foreachBatch(arrived).option("checkpointLocation", os.path.join(run, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    now = table.read().where(F.col("batch").isin(mine))
    rest = todo.join(now.select(F.col("input").alias("relative")), "relative", "left_anti").select("path", "relative")
    least = min(0, before.agg(F.min("batch")).first()[0] or 0)
    for part in chunks(rest.toLocalIterator(), files_per_batch):
        least -= 1  # batches below 0 are of second tries
        make([tuple(r) for r in part], least)
    found = table.read().where(F.col("batch").isin(mine)).drop("batch").unionByName(skipped(before.where(~F.col("batch").isin(mine)), listed, todo))
    counts = status_counts(found).first().asDict()
    rows = [r.asDict() for r in found.orderBy("input").toLocalIterator()]
    manifest(os.path.join(run, "manifest.json"), run_id=ident, created=dt.datetime.now(dt.UTC).isoformat(), source=source, settings=asdict(settings), disc_fill_ratio=T.DISC_FILL, counts=counts, images=rows)
    link_latest(run)
    return run, found


def chunks(rows: Iterator, n: int) -> Iterator[list]:
    while part := list(itertools.islice(rows, n)):
        yield part


def skipped(before: DataFrame, listed: DataFrame, todo: DataFrame) -> DataFrame:
    """Earlier outcomes of images that need no work, with their numbers."""
    rest = listed.join(todo.select("path"), "path", "left_anti").select(F.col("relative").alias("input"))
    return before.where("status = 'ok'").dropDuplicates(["input"]).join(rest, "input", "left_semi").withColumn("status", F.lit("skipped")).select(*_ARROW.names)


def review(found: DataFrame) -> DataFrame:
    """input and reason of what needs a look."""
    reason = T.review_reason(F.col("error"), F.col("left").isNull() | (F.col("status") == "empty"), F.col("fill"), F.col("aspect"))
    return found.where("needs_review").select("input", reason.alias("reason"))


def report(image, settings: Settings = Settings(min_area=0.0)) -> str:
    """What an interactive view says about one image (an array)."""
    s = K.segment(image, **asdict(settings))
    if s.box is None:
        return f"threshold {s.threshold}: no object found"
    left, top, right, bottom = s.box
    verdict = "looks like a full disc" if s.is_disc else "does not look like a full disc"
    return f"threshold {s.threshold}; box ({left}, {top}) to ({right}, {bottom}), {right - left} x {bottom - top}; coverage {s.coverage:.4f}; fill ratio {s.fill:.4f}; aspect ratio {s.aspect:.4f}; {verdict}"
