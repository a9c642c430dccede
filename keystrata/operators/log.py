"""Views of a change log: rows (key, ordering column, deleted, values), of which the newest for each key counts.

A filter on the key commutes with these views, and Catalyst pushes it to the scan, because the window is
partitioned by the very attribute that users filter on. A filter on another column doesn't: it could uncover
a stale version; so it is applied after the view.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK = "__rank"


def newest(log: DataFrame, key: str | list[str], order: str | list[Column]) -> DataFrame:
    """One row for each key: the one that is last by ``order`` (a name, or expressions to sort by). Tombstones stay.

    Spark prunes to one row a key before the shuffle (WindowGroupLimit), so a hot key sends one row a task.
    """
    by = [F.col(order).desc()] if isinstance(order, str) else order
    return log.withColumn(RANK, F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col(RANK) == 1).drop(RANK)


def newest_for(log: DataFrame, key: str, order: str, starts: list[int], by: list[Column] | None = None) -> DataFrame:
    """All that readers at any of ``starts``, or at the end, can see: of each key the newest row up to each of them. Tombstones stay.

    The starts cut a key's history into spans, and the last row of a span is exactly what the reader at its end sees (or,
    if the span is empty, the one before it). So this is one pass with the pruning of ``newest``, whatever the number of readers.
    """
    ends = F.array(*[F.lit(s) for s in sorted(set(starts))]).cast("array<bigint>")
    span = F.get(F.filter(ends, lambda s: s >= F.col(order)), F.lit(0))
    return newest(log.withColumn("__span", span), [key, "__span"], by or order).drop("__span")


def live(log: DataFrame, key: str, order: str, deleted: str = "deleted") -> DataFrame:
    """The current view: newest for each key, tombstones hidden."""
    return newest(log, key, order).where(~F.col(deleted))


def as_of(log: DataFrame, key: str, order: str, version: int, deleted: str = "deleted") -> DataFrame:
    """The view that a reader at ``version`` has."""
    return live(log.where(F.col(order) <= version), key, order, deleted)


def get(log: DataFrame, key: str, order: str, value: int, deleted: str = "deleted") -> DataFrame:
    return live(log.where(F.col(key) == value), key, order, deleted)


def scan(log: DataFrame, key: str, order: str, start: int | None = None, deleted: str = "deleted") -> DataFrame:
    """Ascending from the first key at or after ``start``."""
    rows = log if start is None else log.where(F.col(key) >= start)
    return live(rows, key, order, deleted).orderBy(key)


def merge(sources: list[DataFrame], key: str) -> DataFrame:
    """K-way merge: one row for each key, of the first source that has it; tombstones stay."""
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    return newest(reduce(DataFrame.unionByName, ranked), key, [F.col("__source")]).drop("__source")


def compact(log: DataFrame, key: str, order: str, bottommost: bool, deleted: str = "deleted") -> DataFrame:
    """One run out of many. Tombstones may go only if nothing older lies below this run."""
    return live(log, key, order, deleted) if bottommost else newest(log, key, order)


def split_exists(log: DataFrame, keys: DataFrame, key: str, order: str, deleted: str = "deleted") -> DataFrame:
    """Which of ``keys`` are alive: what deleting them would report."""
    return keys.join(live(log, key, order, deleted).select(key, F.lit(True).alias("existed")), key, "left").select(key, F.coalesce("existed", F.lit(False)).alias("existed"))
