"""A table beside the data that several runs add to at once: folders of Parquet and a log of which of them count.

A run writes its rows into a folder of its own and then adds a log entry that names it; until then nobody sees them. A merge
writes one folder from many and adds an entry that names it and the folders that it stands for. Entries have names of their own and are never
changed, and what counts is all that entries add without all that entries remove. So writers never wait for each other and lose nothing:
a run that adds rows during a merge is not part of it, and two merges at once leave rows twice, which ``newest`` undoes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    """schema: of the rows; key: columns of which ``newest`` keeps one row, that with the largest ``order``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order

    def folders(self) -> list[str]:
        """What counts now: as many names as runs since the last merge."""
        try:
            log = self.spark.read.schema("add array<string>, remove array<string>").json(f"{self.path}/log").collect()
        except AnalysisException:  # nothing was added yet
            return []
        gone = {name for entry in log for name in entry["remove"]}
        return sorted({name for entry in log for name in entry["add"]} - gone)

    def read(self, folders: list[str] | None = None) -> DataFrame:
        folders = self.folders() if folders is None else folders
        paths = [f"{self.path}/data/{name}" for name in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def newest(self, rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc(self.order)))
        return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

    def add(self, rows: DataFrame, instead: list[str] | None = None) -> str:
        """instead: folders that the rows stand for."""
        return self._add(rows, instead or [])

    def merge(self, files: int = 1) -> str | None:
        """Many small folders become one, each key once."""
        folders = self.folders()
        return self._add(self.newest(self.read(folders)).coalesce(files), folders) if len(folders) > 1 else None

    def _add(self, rows: DataFrame, remove: list[str]) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        self._log({"add": [name], "remove": remove}, name)
        return name

    def _log(self, entry: dict, name: str) -> None:
        """By Hadoop, as the folder needn't be a local one: written beside under a name that scans skip, then renamed."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        part, place = hadoop.Path(f"{self.path}/log/_{name}"), hadoop.Path(f"{self.path}/log/{name}.json")
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = system.create(part)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not system.rename(part, place):
            raise OSError(f"{place} can't be made")
