"""A reference grid that is kept between runs: new frames alone are read, and the grid is what all frames together would give.

The state is, for each cell, its ``blend_k`` best observations, and the ids of all frames that were counted; both lie in one
table of ``sinks.versions``. The best of two sets of frames are the best of each set's best, so states merge: an update adds the new frames' best to those
kept, keeps ``blend_k``, and replaces the folders that it read. Two updates at once each replace what they read and keep their own, and the next reader merges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidisc.operators import composite
from lumidisc.session import checkpointed
from lumidisc.sinks.versions import Versions


class GridState:
    """height and width: of the grid; settings: of ``composite.observed``. They belong to the state: another grid is another path."""

    def __init__(self, spark: SparkSession, path: str, height: int, width: int, *, blend_k: int = 1, **settings):
        self.spark, self.height, self.width, self.k, self.settings = spark, height, width, blend_k, settings
        self.table = Versions(spark, path, composite.SEEN, ("cell_row", "cell_col", "idx"), "score")

    def _best(self, rows: DataFrame) -> DataFrame:
        """Each cell's best observations, the smaller idx on a tie; an observation that two folders have counts once."""
        once = rows.where("cell_row >= 0").dropDuplicates(["cell_row", "cell_col", "idx"])
        rank = F.row_number().over(Window.partitionBy("cell_row", "cell_col").orderBy("score", "idx"))
        return once.withColumn("_rank", rank).where(F.col("_rank") <= self.k).drop("_rank")

    def frames(self, folders: list[str] | None = None) -> DataFrame:
        """idx of every frame that was counted; told by rows without a cell."""
        return self.table.read(folders).where("cell_row < 0").select("idx").distinct()

    def update(self, discs: DataFrame) -> int:
        """Counts the frames that are new (by idx, which has to stay a frame's own from run to run). discs: as of ``composite.observed``. How many were new."""
        folders = self.table.folders()
        new = discs.join(self.frames(folders), "idx", "left_anti")
        ids = checkpointed(new.select("idx").distinct())
        if not (n := ids.count()):
            return 0
        seen = composite.observed(new, self.height, self.width, blend_k=self.k, **self.settings)
        told = ids.unionByName(self.frames(folders)).select(F.lit(-1).alias("cell_row"), F.lit(-1).alias("cell_col"), "idx", *(F.lit(0.0).alias(c) for c in ("score", "r", "g", "b")))
        best = self._best(self.table.read(folders).unionByName(seen))
        self.table.add(best.unionByName(told), folders)
        return n

    def grid(self, margin: float = 1.5) -> DataFrame:
        """cell_row, cell_col, idx, r, g, b and more: the winners, or the blend of the best."""
        best = self._best(self.table.read())
        return composite.winners(best) if self.k == 1 else composite.blend(best, self.k, margin)
