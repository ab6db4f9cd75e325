"""What the corpus operators share: sessions, tables, folds, samples, batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lumidisc.llm import kernels as k
from lumidisc.session import ship

#: Features of a sample that the driver learns from.
SAMPLE_BYTES = 64 << 20
#: Rows of one Arrow batch: with texts of a few KB some MB in a Python worker, and bounded with texts of 100 KB too.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with bounded Arrow batches, whose workers have this package."""
    spark = ship(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set as checkpoint folder. Only a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local") and "cluster" not in context.master:
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """A reliable checkpoint in the shared folder. rows: of a table of narrow rows, how many a later task should read at least, so that small tables don't cost as many shuffle files as large ones."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out.coalesce(max(1, -(-out.count() // rows))) if rows else out


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns are never read."""
    return docs.select("doc_id", "text")


def in_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns; nothing is yielded for no rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch))

    session(df)
    return df.mapInArrow(each, schema)


def sent_if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """The frame, written, for a join: broadcast if it has up to so many (narrow) rows, else left to a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def first_by_hash(df: DataFrame, by: str, n: int) -> DataFrame:
    """A bounded sample: for each value of ``by`` the n rows whose ids have the smallest hashes, the same in every run; with their rank.

    Only rows whose hash lies among about the first 1.25 n of their value's are ranked (n = 1200: fewer than n of them are
    found less than once in 10**30 cases), so no task sorts more than that, however many rows or tasks there are.
    """
    sizes = sent_if_small(df.groupBy(by).agg(F.count("*").alias("_size")))
    hashed = df.withColumn("_hash", F.xxhash64("doc_id"))
    share = (F.lit(1.25 * n + 6 * n**0.5 + 20)) / F.col("_size")
    low = hashed.join(sizes, by).where((F.col("_hash").cast("double") / 2.0**64 + 0.5) <= share)
    order = Window.partitionBy(by).orderBy("_hash", "doc_id")
    return low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("_hash", "_size")


def learned(found: DataFrame, most_bytes: int) -> list[Row]:
    """The rows of a sample, by rank, as far as their features have up to ``most_bytes``; those of rank 1 always. found: doc_id, rank, features and more."""
    found = cut(found)
    sizes = sorted((r["rank"], r["bytes"]) for r in found.groupBy("rank").agg(F.sum(F.octet_length("features")).alias("bytes")).collect())
    last, total = 1, 0
    for rank, size in sizes:
        total += size
        if total <= most_bytes:
            last = rank
    rows = found.where(F.col("rank") <= last).collect()
    return sorted(rows, key=lambda r: (k.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], bytes(r["features"])))
