"""Picking days from those that an archive has."""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumidisc.session import ship


def pick_explicit(available: DataFrame, wanted: DataFrame) -> DataFrame:
    """requested, resolved, snap_days (below 0 if the day lies before the wish): the nearest day, the earlier on a tie.

    A union sorted by day and two running windows instead of a join of all pairs; both sides are distinct
    calendar days there, so they stay small however many frames or wishes there are. Repeated wishes get their row each.
    """
    days = available.distinct().select("d", F.lit(None).cast("date").alias("requested")).unionByName(wanted.select(F.col("requested").alias("d"), "requested").distinct())
    order = W.orderBy("d", F.col("requested").isNotNull())
    real = F.when(F.col("requested").isNull(), F.col("d"))
    back = F.last(real, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(real, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    found = days.select("requested", back.alias("a"), ahead.alias("b")).where("requested IS NOT NULL")
    use_b = F.col("a").isNull() | (F.datediff("b", "requested") < F.datediff("requested", "a"))
    out = found.select("requested", F.when(use_b, F.coalesce("b", "a")).otherwise(F.col("a")).alias("resolved")).where("resolved IS NOT NULL")
    return wanted.select("requested").join(out, "requested").withColumn("snap_days", F.datediff("resolved", "requested"))


def pick_last(available: DataFrame, n: int) -> DataFrame:
    return available.orderBy(F.desc("d")).limit(n)


def pick_range(available: DataFrame, start: str, end: str) -> DataFrame:
    return available.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


class Free:
    """Which of n places are still free: two forests over the places, one whose roots are the next free place upwards (n: none), one downwards (-1: none).

    Taking a place hangs it under its neighbour; looking one up shortens the path. So ``m`` picks cost about m steps, whatever the pool's size.
    """

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 1)), list(range(n + 1))  # down[i] is about place i - 1

    @staticmethod
    def _root(forest: list[int], i: int) -> int:
        while forest[i] != i:
            forest[i] = forest[forest[i]]
            i = forest[i]
        return i

    def around(self, i: int) -> tuple[int, int]:
        """The free places next to the gap before place i: below (-1: none) and from i on (n: none)."""
        return self._root(self.down, i) - 1, self._root(self.up, i)

    def take(self, i: int) -> None:
        self.up[i], self.down[i + 1] = i + 1, i


def targets(start: int, end: int, count: int) -> list[int]:
    """``count`` days evenly from the first to the last; the middle, rounded down, for one."""
    return [start + (end - start) // 2] if count == 1 else [start + round((end - start) * i / (count - 1)) for i in range(count)]


def fold(pool: list[int], wanted: list[int]) -> list[tuple[int, int]]:
    """Each wanted day, in turn, with the nearest day of the sorted pool that is still free, the earlier on a tie."""
    free, out = Free(len(pool)), []
    for day in wanted:
        low, high = free.around(bisect.bisect_left(pool, day))
        pick = high if low < 0 or (high < len(pool) and pool[high] - day < day - pool[low]) else low
        free.take(pick)
        out.append((day, pool[pick]))
    return out


def spread(days: list[dt.date], start: dt.date, end: dt.date, count: int) -> list[tuple[dt.date, dt.date]]:
    """(requested, resolved), by resolved day; all days of the range if there are no more than ``count``."""
    pool = sorted({d.toordinal() for d in days if start <= d <= end})
    picks = [(d, d) for d in pool] if count >= len(pool) else fold(pool, targets(start.toordinal(), end.toordinal(), count) if count > 0 else [])
    return [(dt.date.fromordinal(a), dt.date.fromordinal(b)) for a, b in sorted(picks, key=lambda pick: pick[1])] if count > 0 else []


def pick_spread(available: DataFrame, start: str, end: str, count: int) -> DataFrame:
    """requested, resolved, snap_days. Greedy without reuse is one ordered fold: a task runs it over the distinct calendar days of the range."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for days in batch.column("days").to_pylist():
                found = spread(days, first, last, count)
                yield pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in found], pa.date32()) for i in (0, 1)], ["requested", "resolved"])

    ship(available.sparkSession)
    days = pick_range(available, start, end).select("d").distinct().agg(F.collect_list("d").alias("days"))
    return days.mapInArrow(each, "requested date, resolved date").withColumn("snap_days", F.datediff("resolved", "requested"))


def every_nth(frames: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """Of each day's frames, in the order of capture, every nth from the first on with its number k; ``most``: so many of them at most."""
    k = F.row_number().over(W.partitionBy("day").orderBy("captured", "event_id")) - 1
    out = frames.withColumn("k", k).where(F.col("k") % n == 0)
    return out if most is None else out.where(F.col("k") < n * most)
