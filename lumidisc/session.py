"""Session settings that the library expects; nothing here is needed on a session that has them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str = "local[*]", app: str = "lumidisc", **more: str) -> SparkSession:
    return SparkSession.builder.master(master).appName(app).config(map=SETTINGS | more).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir. Only a local session that names none gets a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local") and "cluster" not in context.master:
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers, once for each context, so that they needn't have it on their path. Spark serves the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_lumidisc_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="lumidisc-")) / "lumidisc.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
    context._lumidisc_shipped = True
    return spark
