"""Multi-version reads, conflict checks and garbage collection over a version table.

Versions have key, txn, seq (order of writing), commit_ts (null while pending), deleted and values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.operators.log import newest, newest_for

READ_UNCOMMITTED, READ_COMMITTED, SNAPSHOT, SERIALIZABLE = "READ_UNCOMMITTED", "READ_COMMITTED", "SNAPSHOT", "SERIALIZABLE_SNAPSHOT"
LEVELS = (READ_UNCOMMITTED, READ_COMMITTED, SNAPSHOT, SERIALIZABLE)


def read(versions: DataFrame, level: str, key: str = "k", start_ts: int | None = None, txn=None) -> DataFrame:
    """What a transaction sees: its own pending versions first, then, by level, the last one written, the last one committed, or the last one
    committed by ``start_ts``; tombstones hidden."""
    if level not in LEVELS:
        raise ValueError(f"unknown isolation level {level}")
    own = F.coalesce(F.col("txn") == F.lit(txn), F.lit(False)) & F.col("commit_ts").isNull() if txn is not None else F.lit(False)
    if level == READ_UNCOMMITTED:
        rows, order = versions, F.col("seq")
    else:
        seen = F.col("commit_ts").isNotNull()
        if level in (SNAPSHOT, SERIALIZABLE):
            seen &= F.col("commit_ts") <= F.lit(start_ts)
        rows, order = versions.where(own | seen), F.col("commit_ts")
    rows = rows.withColumn("__own", own)
    return newest(rows, key, [F.col("__own").desc(), order.desc_nulls_last(), F.col("seq").desc()]).drop("__own").where(~F.col("deleted"))


def conflicts(touched: DataFrame, versions: DataFrame, key: str = "k") -> DataFrame:
    """Rows of ``touched`` (txn, key, start_ts) for which another transaction committed a version of the key after start_ts.

    For write-write conflicts ``touched`` holds the writes; at SERIALIZABLE_SNAPSHOT the reads as well. Of a key only the last two
    transactions to commit matter, since one of them is another's: so each key brings one row to the join, however many versions it has.
    """
    last = versions.where("commit_ts is not null").groupBy(key, "txn").agg(F.max("commit_ts").alias("commit_ts"))
    two = last.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("commit_ts"), "txn"))).where("__rank <= 2")
    first, second = F.col("__rank") == 1, F.col("__rank") == 2
    by_key = two.groupBy(F.col(key).alias("__key")).agg(
        F.max(F.when(first, F.col("txn"))).alias("__txn"), F.max(F.when(first, F.col("commit_ts"))).alias("__ts"), F.max(F.when(second, F.col("commit_ts"))).alias("__other")
    )
    t = touched.alias("t")
    late = ((F.col("t.txn") != F.col("__txn")) & (F.col("__ts") > F.col("t.start_ts"))) | (F.col("__other") > F.col("t.start_ts"))
    return t.join(by_key, (F.col(f"t.{key}") == F.col("__key")) & late, "left_semi")


def survivors(versions: DataFrame, snapshots: DataFrame, key: str = "k") -> DataFrame:
    """Committed versions that a reader can reach: of each key the newest, and the newest up to the start_ts of each active snapshot.

    ``snapshots`` has a row for each running transaction; their distinct numbers go to the driver.
    """
    starts = [r[0] for r in snapshots.select("start_ts").distinct().collect()]
    return newest_for(versions.where("commit_ts is not null"), key, "commit_ts", starts, [F.desc("commit_ts"), F.desc("seq")])


def collectable(versions: DataFrame, snapshots: DataFrame, key: str = "k") -> DataFrame:
    """The other committed versions. The join is on (key, seq), which is unique, so a hot key is spread."""
    kept = survivors(versions, snapshots, key).select(key, "seq")
    return versions.where("commit_ts is not null").join(kept, [key, "seq"], "left_anti").select(*versions.columns)


def version_count(versions: DataFrame, key: str = "k") -> DataFrame:
    return versions.groupBy(key).agg(F.count("*").alias("n_versions"))
