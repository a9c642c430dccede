"""The engine: strict SQL and a Python API over keyed tables.

Every write is one run of the change log and one manifest, so a statement of many rows is atomic. Reads are lazy DataFrames.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable
from copy import deepcopy
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType
from pyspark.sql.utils import AnalysisException

from keystrata.errors import ConflictError, SqlError, TransactionError
from keystrata.functions.keys import payload_bytes
from keystrata.operators import log
from keystrata.plans.access import FULL, POINT, AccessPath, access_path
from keystrata.sources.store import DELETED, FILE_BYTES, FILE_ROWS, SEQ, Manifest, Store, TableState
from keystrata.sql import binder
from keystrata.sql.parser import Comparison, CreateTable, Delete, Insert, Select, parse
from keystrata.txn import SNAPSHOT, Transaction
from keystrata.types import MAX_KEY, TableSchema

SORTED, LOG = "sorted", "log"


@dataclass
class Result:
    """What a statement gave. SELECT holds a lazy DataFrame; its message and rows_affected count only when asked."""

    kind: str
    frame: DataFrame | None = None
    affected: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.frame.columns if self.frame is not None else []

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []

    @property
    def rows_affected(self) -> int:
        if self.affected is None:
            self.affected = self.frame.count() if self.frame is not None else 0
        return self.affected

    @property
    def message(self) -> str:
        return self.kind if self.kind == "CREATE TABLE" else f"{self.kind} {self.rows_affected}"


class Engine:
    """``layout`` sorted keeps each table as one sorted run, merged at every write; log appends runs to tiers, and a tier of ``compact_at``
    runs becomes one run of the next, so that a row is rewritten once a tier.

    Several engines, also of several processes, may work on one root. Transactions hold leases there; one that is older than ``lease_s`` counts as
    dead: its versions may go, and it can't read or commit any more. Compacted runs have files of about ``file_bytes``, or of ``file_rows`` if they take less.
    """

    def __init__(self, spark: SparkSession, root: str, layout: str = LOG, compact_at: int = 4, max_row_bytes: int | None = 64, lease_s: float = 3600, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS):
        if layout not in (SORTED, LOG):
            raise ValueError(f"unknown layout {layout}")
        self.spark, self.layout, self.compact_at, self.max_row_bytes = spark, layout, max(2, compact_at), max_row_bytes
        self.lease_s, self.file_bytes, self.file_rows = lease_s, file_bytes, file_rows
        self.store = Store(spark, root)
        self.lock = threading.RLock()
        self.active: dict[int, Transaction] = {}
        self.counters = {"reads": 0, "writes": 0, "commits": 0, "compactions": 0}

    # -- SQL

    def execute(self, sql: str) -> Result:
        try:
            statement = parse(sql)
            if isinstance(statement, CreateTable):
                self.create_table(TableSchema(statement.table, statement.columns, self.max_row_bytes))
                return Result("CREATE TABLE", affected=0)
            if isinstance(statement, Insert):
                return Result("INSERT", affected=self.insert(statement.table, [statement.values]))
            if isinstance(statement, Select):
                return Result("SELECT", self.select(statement.table, statement.columns, statement.where))
            return Result("DELETE", affected=self.delete(statement.table, statement.where))
        except (AnalysisException, ConflictError) as e:
            raise SqlError(str(e)) from e

    def explain(self, sql: str) -> AccessPath:
        """The access path of a SELECT or DELETE."""
        statement = parse(sql)
        if not isinstance(statement, Select | Delete):
            raise SqlError("only SELECT and DELETE have an access path")
        return access_path(statement.where, self.table(statement.table).schema)

    # -- catalog

    def manifest(self) -> Manifest:
        return self.store.load()

    def has_table(self, name: str) -> bool:
        return name in self.manifest().tables

    def table(self, name: str, manifest: Manifest | None = None) -> TableState:
        tables = (manifest or self.manifest()).tables
        if name not in tables:
            raise SqlError(f"no table {name}")
        return tables[name]

    def create_table(self, schema: TableSchema) -> None:
        with self.lock:
            now = self.manifest()
            if schema.name in now.tables:
                raise SqlError(f"table {schema.name} exists")
            now.tables[schema.name] = TableState(schema)
            now.version += 1
            self.store.publish(now)

    # -- reads

    def changes(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """The table's whole change log."""
        t = self.table(name, manifest)
        return self.store.read(t, t.runs)

    def view(self, name: str, as_of: int | None = None, where: tuple[Comparison, ...] = (), manifest: Manifest | None = None) -> DataFrame:
        """The rows now, or at clock ``as_of``. One clean run is the view: no window, all filters pushed."""
        self.counters["reads"] += 1
        t = self.table(name, manifest)
        key = t.schema.key
        if as_of is not None and not t.whole_at(as_of):
            raise TransactionError(f"versions of table {name} at clock {as_of} were collected")
        condition = binder.condition(where)
        path = access_path(where, t.schema)
        low, high = (path.key, path.key) if path.kind == POINT else (path.low, path.high) if path.kind != FULL else (None, None)
        rows = self.store.read(t, t.runs, low, high)
        if as_of is None and t.clean:
            rows = rows.where(condition) if condition is not None else rows
        else:
            on_key = binder.condition(tuple(c for c in where if c.column == key))
            rows = rows.where(on_key) if on_key is not None else rows
            rows = log.live(rows, key, SEQ, DELETED) if as_of is None else log.as_of(rows, key, SEQ, as_of, DELETED)
            rows = rows.where(condition) if condition is not None else rows
        return rows.select(*t.schema.names)

    def select(self, name: str, columns: tuple[str, ...] | None = None, where: tuple[Comparison, ...] = (), as_of: int | None = None) -> DataFrame:
        now = self.manifest()
        schema = self.table(name, now).schema
        for c in columns or ():
            schema.column(c)
        rows = self.view(name, as_of, where, now)
        return rows if columns is None else rows.select(*columns)

    def get(self, name: str, key: int) -> tuple | None:
        schema = self.table(name).schema
        rows = self.view(name, where=(Comparison(schema.key, "=", key),)).take(1)
        return tuple(rows[0]) if rows else None

    def scan(self, name: str, start: int | None = None) -> DataFrame:
        schema = self.table(name).schema
        where = () if start is None else (Comparison(schema.key, ">=", start),)
        return self.view(name, where=where).orderBy(schema.key)

    # -- writes

    def insert(self, name: str, rows: Iterable[tuple]) -> int:
        """Upsert literal rows; of rows with one key the last counts."""
        schema = self.table(name).schema
        rows = [tuple(r) for r in rows]
        for r in rows:
            schema.check_row(r)
        last = {r[0]: r for r in rows}
        if last:
            self._append({name: [(r, False) for r in last.values()]})
        return len(rows)

    def upsert(self, name: str, rows: DataFrame, unique: bool = False) -> None:
        """Upsert a DataFrame with the table's columns, types (any integers for INTEGER) and unique keys, as ``upsert_all`` does."""
        self.upsert_all({name: rows}, {name} if unique else set())

    def upsert_all(self, frames: dict[str, DataFrame], unique: set[str] = frozenset()) -> int:
        """Upsert DataFrames into their tables in one commit; its clock.

        Each frame is evaluated once: it is written, what was written is checked (nulls, key range, row size and repeated keys, in one aggregation), and
        only then published. ``unique`` names tables whose frames' keys are known to be unique, which spares the grouping by key.
        """
        ready = {}
        for name, rows in frames.items():
            schema = self.table(name).schema
            for c in schema.columns:
                found = rows.schema[c.name].dataType
                if not isinstance(found, IntegralType if c.type == "INTEGER" else StringType):
                    raise SqlError(f"column {c.name} is {c.type}, the frame has {found.simpleString()}")
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct()])
            ready[name] = rows.withColumn(DELETED, F.lit(False))
        return self.commit(ready, check=lambda name, rows: self._check_rows(name, rows, name in unique))

    def _check_rows(self, name: str, rows: DataFrame, unique: bool) -> None:
        schema = self.table(name).schema
        bad = F.lit(False)
        for c in schema.names:
            bad |= F.col(c).isNull()
        key = F.col(schema.key)
        large = F.lit(False) if schema.max_row_bytes is None else payload_bytes(schema.struct(), schema.key) > schema.max_row_bytes
        counts = [F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(a) for a, c in (("nulls", bad), ("range", (key < 0) | (key > MAX_KEY)), ("large", large)))]
        grouped = rows.agg(*counts).withColumn("n", F.lit(1)) if unique else rows.groupBy(schema.key).agg(*counts)
        found = grouped.agg(F.sum("nulls"), F.sum("range"), F.sum("large"), F.count(F.when(F.col("n") > 1, 1))).first()
        if any(found):
            nulls, out, large, twice = (x or 0 for x in found)
            raise SqlError(f"{nulls} rows with nulls, {out} keys out of range, {large} rows over {schema.max_row_bytes} bytes, {twice} keys more than once")

    def delete(self, name: str, where: tuple[Comparison, ...] = ()) -> int:
        """Tombstones for all matching rows; their number. What matches is judged on the very version that the commit follows."""
        access_path(where, self.table(name).schema)
        deleted = {"n": 0}

        def hit(now: Manifest) -> dict[str, DataFrame]:
            return {name: self.view(name, where=where, manifest=now).withColumn(DELETED, F.lit(True))}

        def check(_, rows: DataFrame) -> None:
            deleted["n"] = rows.count()

        self.commit(hit, check=check, empty=False)
        return deleted["n"]

    def _append(self, changes: dict[str, list[tuple[tuple, bool]]], validate=None) -> int:
        frames = {}
        for name, rows in changes.items():
            schema = self.table(name).schema
            blank = lambda key, s=schema: tuple(key if c.name == s.key else 0 if c.type == "INTEGER" else "" for c in s.columns)
            data = [(*(r if not gone else blank(r[0])), gone) for r, gone in rows]
            frames[name] = self.spark.createDataFrame(data, schema.struct().add(DELETED, "boolean", False)).coalesce(1)
        return self.commit(frames, validate)

    def commit(self, frames, validate=None, check=None, empty: bool = True) -> int:
        """Write one run for each table and publish them together; the commit's clock.

        ``frames`` is a DataFrame for each table, or a function of the manifest that the commit follows, asked again if another writer was first.
        ``validate(manifest)`` and ``check(table, written rows)`` may refuse. Without ``empty`` a commit of no rows isn't published.
        """
        with self.lock:
            written: dict[str, str] = {}
            while True:
                now = self.manifest()
                if validate:
                    validate(now)
                after = deepcopy(now)
                after.clock, after.version = now.clock + 1, now.version + 1
                made, total = [], 0
                try:
                    for name, rows in (frames(now) if callable(frames) else frames).items():
                        t = self.table(name, after)
                        if name in written and not callable(frames):  # a frame is evaluated once; its run only gets another clock
                            rows = self.spark.read.schema(t.log_struct()).parquet(written[name])
                        stamped = rows.withColumn(SEQ, F.lit(after.clock).cast("long")).select(*[f.name for f in t.log_struct()])
                        written[name] = self.store.write_run(stamped, t.schema)
                        made.append(written[name])
                        if check:
                            check(name, self.spark.read.schema(t.log_struct()).parquet(written[name]))
                        run = self.store.run(t, written[name])
                        total += run.rows
                        t.tiers = t.tiers or [[]]
                        t.tiers[0].append(run)
                    if total or empty:
                        self.store.publish(after)
                        break
                except ConflictError:
                    continue  # runs that nothing names go with the next vacuum
                except Exception:
                    for path in made:
                        self.store.remove(path)
                    raise
                for path in made:
                    self.store.remove(path)
                return now.clock
            self.counters["writes"] += len(made)
            self.counters["commits"] += 1
            for name in written:
                try:
                    if self.layout == SORTED:
                        self.compact(name)
                    else:
                        self._merge_tiers(name)
                except ConflictError:  # another writer was first; the commit itself stands, and a later one compacts
                    pass
            return after.clock

    def _merge_tiers(self, name: str) -> None:
        """Size-tiered compaction: while a tier has ``compact_at`` runs, they become one of the next."""
        while True:
            full = [k for k, tier in enumerate(self.table(name).tiers) if len(tier) >= self.compact_at]
            if not full:
                return
            self.compact(name, tier=full[0])

    def compact(self, name: str, n_files: int | None = None, tier: int | None = None) -> None:
        """Merge the runs of a tier into one of the next, or all runs into one.

        Versions that a transaction of any process can still read stay, and so do their tombstones; others go if no deeper
        tier has runs. What is bottommost is dealt by key range, before the merge, so that rows are sent and sorted once; bounds on a
        file's rows and bytes bound what a task sorts, since a run has few versions of a key.
        """
        with self.lock:
            now = self.manifest()
            t = self.table(name, now)
            last = len(t.tiers) - 1
            taken = t.runs if tier is None else t.tiers[tier]
            if not taken or (tier is None and t.clean):
                return
            starts = self.store.leased(self.lease_s)
            rows, bottommost = self.store.read(t, taken), tier is None or not any(t.tiers[tier + 1 :])
            clean = bottommost and not starts
            if starts and len(taken) < 2:
                return
            n_rows = sum(r.rows for r in taken)
            files = n_files or max(1, -(-sum(r.bytes for r in taken) // self.file_bytes), -(-n_rows // self.file_rows))
            ranged = bottommost or files > 1
            if ranged:
                rows = rows.repartitionByRange(files, t.schema.key)
            if starts:
                rows = log.newest_for(rows, t.schema.key, SEQ, starts)
            else:
                rows = log.compact(rows, t.schema.key, SEQ, bottommost=bottommost, deleted=DELETED)
            path = self.store.write_run(rows, t.schema, files if ranged else None, n_rows)
            run = self.store.run(t, path, clean, ranged)
            if tier is None:
                t.tiers = [*([] for _ in range(last)), [run]]
            else:
                t.tiers = [*t.tiers, []] if tier == last else t.tiers
                t.tiers[tier] = []
                t.tiers[tier + 1].append(run)
            t.floor, t.kept = now.clock, starts
            now.version += 1
            self.store.publish(now)
            self.counters["compactions"] += 1

    def vacuum(self, min_age_s: float = 0) -> list[str]:
        """Delete unnamed runs. Where other processes read or write, give an age beyond their longest statement."""
        with self.lock:
            return self.store.vacuum(self.manifest(), min_age_s=min_age_s)

    # -- transactions

    def begin(self, level: str = SNAPSHOT) -> Transaction:
        """The lease is there before the clock counts: had a compaction meanwhile dropped what it shows, it is taken anew."""
        with self.lock:
            while True:
                now = self.manifest()
                txn = Transaction(self, level, now.clock)
                self.store.lease(txn.lease, txn.start_ts)
                if all(t.whole_at(txn.start_ts) for t in self.manifest().tables.values()):
                    break
                self.store.release(txn.lease, txn.start_ts)
            self.active[txn.id] = txn
            return txn

    def end(self, txn: Transaction) -> None:
        if self.active.pop(txn.id, None):
            self.store.release(txn.lease, txn.start_ts)

    def stats(self) -> dict:
        """Counters, and facts of the manifest."""
        now = self.manifest()
        tables = {
            n: {"base_runs": int(t.clean and bool(t.runs)), "delta_runs": 0 if t.clean else len(t.runs), "tiers": [len(x) for x in t.tiers], "rows": sum(r.rows for r in t.runs), "bytes": sum(r.bytes for r in t.runs)}
            for n, t in now.tables.items()
        }
        return self.counters | {"version": now.version, "clock": now.clock, "active": len(self.active), "tables": tables}


__all__ = ["LOG", "SORTED", "Engine", "Result"]
