"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidisc.llm.common import cut

#: Edges that one task contracts (16 MB); more are contracted by rounds of joins.
ONE_TASK = 500_000
_ROWS = 200_000


def roots(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges, and the smallest id that each is connected with."""
    ids, flat = np.unique(np.concatenate((low, high)), return_inverse=True)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(flat[: len(low)].tolist(), flat[len(low) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return ids, ids[np.array([root(x) for x in range(len(ids))], np.int64)]


def components(edges: DataFrame, one_task: int = ONE_TASK, most_rounds: int = 100) -> DataFrame:
    """(id, component) for each id in (a, b): the smallest id that links lead to.

    Up to ``one_task`` edges are contracted by one task. More go through large-star and small-star
    steps (Kiveris et al. 2014) in turn, until a round changes nothing; each round is cut
    off from its lineage, and joins meet hot ids by AQE's splitting.
    """
    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), _ROWS)
    if now.count() <= one_task:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ = list(batches)
            pair = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in all_] or [np.zeros(0, np.int64)]) for c in ("low", "high")]
            if len(pair[0]):
                ids, least = roots(*pair)
                yield pa.RecordBatch.from_pydict({"id": ids, "component": least})

        return cut(now.coalesce(1).mapInArrow(each, "id bigint, component bigint"), _ROWS)
    before = None
    for _ in range(most_rounds):
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        ends = F.array(F.struct(F.col("m").alias("low"), F.col("high").alias("high")), F.struct(F.col("m").alias("low"), F.col("low").alias("high")))
        now = cut(large.join(least, "high").select(F.explode(ends).alias("e")).select("e.*").where("low <> high").distinct(), _ROWS)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("high").alias("id"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())
