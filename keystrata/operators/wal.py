"""A write-ahead log (lsn, txn, type, key, deleted, values) as a dataset, and recovery as queries over it.

type is BEGIN, UPDATE, COMMIT or ABORT. Only what a COMMIT covers is visible, so undo is a filter and redo a fold. This equals
physical undo if transactions are serial or touch different keys; undoing a loser between others' commits
could otherwise restore an older value, as ``recover_physically`` does.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keystrata.operators.log import live, newest


def losers(log: DataFrame) -> DataFrame:
    """Transactions with records but no COMMIT."""
    committed = log.where("type = 'COMMIT'").select("txn").distinct()
    return log.select("txn").distinct().join(committed, "txn", "left_anti")


def committed_updates(log: DataFrame) -> DataFrame:
    committed = log.where("type = 'COMMIT'").select("txn").distinct()
    return log.where("type = 'UPDATE'").join(committed, "txn", "left_semi")


def recover(log: DataFrame, key: str = "k", base: DataFrame | None = None, base_lsn: int | None = None) -> DataFrame:
    """The state after recovery: of each key the last committed update, tombstones hidden.

    With ``base``, a state that holds all committed updates up to ``base_lsn``, only the rest of the log is folded.
    """
    updates = committed_updates(log)
    if base is not None:
        tail = updates.where(F.col("lsn") > base_lsn).select(*base.columns)
        return live(base.unionByName(tail), key, "lsn")
    return live(updates, key, "lsn")


def checkpoint(log: DataFrame, lsn: int, key: str = "k") -> DataFrame:
    """The base at ``lsn``: newest committed update of each key, tombstones kept, for ``recover`` to start from."""
    return newest(committed_updates(log).where(F.col("lsn") <= lsn), key, "lsn")


def recover_physically(log: DataFrame, key: str = "k", old: tuple[str, str] = ("old_deleted", "old_value"), new: tuple[str, str] = ("deleted", "value")) -> DataFrame:
    """The state after redo of all updates in order and undo of the losers' from the last to the first, each restoring its old value.

    The loser's update that is undone last, the first of a key, decides the key; without one the last update does. So both are one
    aggregation: no log is walked. Keys whose state is deleted are hidden.
    """
    lost = losers(log).select("txn", F.lit(True).alias("lost"))
    updates = log.where("type = 'UPDATE'").join(lost, "txn", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    before = F.min_by(F.struct(F.col(old[0]).alias("gone"), F.col(old[1]).alias("v")), F.when(F.col("lost"), F.col("lsn")))
    after = F.max_by(F.struct(F.col(new[0]).alias("gone"), F.col(new[1]).alias("v")), F.col("lsn"))
    state = updates.groupBy(key).agg(before.alias("undone"), after.alias("done"), F.max("lost").alias("any_lost"))
    state = state.select(key, F.when(F.col("any_lost"), F.col("undone")).otherwise(F.col("done")).alias("s"))
    return state.where(~F.col("s.gone")).select(key, F.col("s.v").alias(new[1]))


class LogFile:
    """A log on disk: ``append`` numbers records, ``flush`` makes them durable as one segment, ``read_from`` opens the segments it needs.

    A segment's name tells its first LSN. One process appends; any may read.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = StructType([StructField("lsn", LongType()), *schema.fields])
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(self.root))
        self._lock, self._pending = threading.Lock(), []
        segments = self.segments()
        last = self.spark.read.schema(self.schema).parquet(f"{self.root}/{segments[-1]:020d}").agg(F.max("lsn")).first()[0] if segments else -1
        self.next_lsn, self.flushed_lsn = last + 1, last

    def segments(self) -> list[int]:
        """First LSNs of the segments; one without a _SUCCESS was never flushed."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def append(self, *record) -> int:
        """The record's LSN. It is lost with the process until a flush."""
        with self._lock:
            self._pending.append((self.next_lsn, *record))
            self.next_lsn += 1
            return self.next_lsn - 1

    def flush(self) -> int:
        """The last durable LSN."""
        with self._lock:
            if self._pending:
                rows = self.spark.createDataFrame(self._pending, self.schema).coalesce(1).sortWithinPartitions("lsn")
                rows.write.mode("overwrite").parquet(f"{self.root}/{self._pending[0][0]:020d}")
                self.flushed_lsn, self._pending = self._pending[-1][0], []
            return self.flushed_lsn

    def append_all(self, rows: DataFrame, order: list[str]) -> int:
        """Records in bulk, numbered in ``order``, as one durable segment; the last LSN."""
        self.flush()
        with self._lock:
            first = self.next_lsn
            ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
            at = f"{self.root}/.bulk-{first}"
            ordered.write.mode("overwrite").parquet(at)  # counted and numbered as it was written
            held = self.spark.read.parquet(at)
            before, starts = first, []
            for part, n in sorted(map(tuple, held.groupBy("__part").count().collect())):
                starts.append((part, before))
                before += n
            if not starts:
                return self.flushed_lsn
            numbered = held.join(F.broadcast(self.spark.createDataFrame(starts, "__part int, __first long")), "__part").withColumn("lsn", F.col("__first") + F.col("__at"))
            numbered.select(*self.schema.names).sortWithinPartitions("lsn").write.mode("overwrite").parquet(f"{self.root}/{first:020d}")
            self._fs.delete(self._path(at), True)
            self.next_lsn, self.flushed_lsn = before, before - 1
            return self.flushed_lsn

    def read_from(self, lsn: int = 0) -> DataFrame:
        """Durable records from ``lsn`` on, ascending."""
        segments = self.segments()
        needed = [a for a, b in zip(segments, [*segments[1:], self.next_lsn], strict=False) if b > lsn]
        if not needed:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{a:020d}" for a in needed]).where(F.col("lsn") >= lsn).orderBy("lsn")
