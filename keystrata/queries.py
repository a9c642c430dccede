"""The engine's driver queries over the test tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.engine import LOG, SORTED, Engine
from keystrata.errors import ConflictError
from keystrata.functions.keys import pack_key, payload_bytes, unpack_key, unpack_table
from keystrata.operators import cache, log, mvcc, wal
from keystrata.sql import binder
from keystrata.sources.store import DELETED
from keystrata.sql.parser import parse
from keystrata.txn import READ_COMMITTED, READ_UNCOMMITTED, SERIALIZABLE, SNAPSHOT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """Where queries that write keep their tables: the cluster's shared folder, or on a local master a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _scratch.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="keystrata-"))
    return at


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _dialect(name: str, sql: str) -> None:
    """A statement of the strict dialect over a read-only table, parsed and bound by the engine's own front end."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        statement = parse(sql)
        rows = _table(spark, sf, statement.table)
        condition = binder.condition(statement.where)
        rows = rows if condition is None else rows.where(condition)
        return rows if statement.columns is None else rows.select(*statement.columns)

    QUERIES[name], SQL[name] = run, sql


_dialect("full_scan_star", "SELECT * FROM nation")
_dialect("project_columns", "SELECT p_name, p_retailprice FROM part")
_dialect("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
_dialect("point_lookup_residual", "SELECT * FROM orders WHERE o_orderkey = 77 AND o_totalprice > 1000")
_dialect("range_closed", "SELECT * FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 25")
_dialect("range_open_high", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 14000")
_dialect("range_open_low", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50")
_dialect("range_empty", "SELECT o_orderkey FROM orders WHERE o_orderkey > 9 AND o_orderkey < 3")
_dialect("filter_unindexed", "SELECT * FROM orders WHERE o_custkey = 899")
_dialect("range_unindexed", "SELECT * FROM orders WHERE o_custkey > 10 AND o_custkey <= 25")
_dialect("filter_text_equal", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
_dialect("filter_text_range", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'HOUSEHOLD' AND c_mktsegment < 'MACHINERY'")
_dialect("filter_conjunction", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_returnflag = 'R' AND l_linenumber <= 4")


def _shipdate(name: str, day: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.expr(f"timestamp_ntz'{day}'")).select("l_extendedprice")

    QUERIES[name], SQL[name] = run, f"SELECT l_extendedprice FROM lineitem WHERE l_shipdate <= timestamp '{day}'"


_shipdate("shipdate_filter_10", "1995-09-04 00:00:00")
_shipdate("shipdate_filter_50", "1998-05-24 00:00:00")
_shipdate("shipdate_filter_90", "2001-02-24 00:00:00")

#: events as a change log: user_id is the key, event_id the order, 'error' a tombstone
_LOG = "SELECT user_id, event_id, event_type = 'error' AS deleted, value FROM events"
_NEWEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM log"


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("deleted"), "value")


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, deleted, value FROM n WHERE rn = 1")
def upsert_latest(spark, sf):
    return log.newest(_changes(spark, sf), "user_id", "event_id")


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT deleted")
def scan_hides_tombstones(spark, sf):
    return log.live(_changes(spark, sf), "user_id", "event_id").drop("deleted")


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT deleted AND user_id >= 40")
def kv_scan_from_key(spark, sf):
    return log.scan(_changes(spark, sf), "user_id", "event_id", 40).drop("deleted")


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, value FROM n WHERE rn = 1 AND NOT deleted AND user_id = 7")
def kv_get(spark, sf):
    return log.get(_changes(spark, sf), "user_id", "event_id", 7).drop("deleted")


@query(f"""WITH log AS ({_LOG}), n AS ({_NEWEST}), k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT k.user_id, coalesce(NOT deleted, false) AS existed FROM k LEFT JOIN n ON k.user_id = n.user_id AND rn = 1""")
def kv_delete_existed(spark, sf):
    keys = _table(spark, sf, "events").where("event_type = 'signup'").select("user_id").distinct()
    return log.split_exists(_changes(spark, sf), keys, "user_id", "event_id")


@query("SELECT * FROM orders WHERE NOT (o_custkey >= 500 AND o_totalprice > 1000)")
def delete_where(spark, sf):
    return _table(spark, sf, "orders").where(~((F.col("o_custkey") >= 500) & (F.col("o_totalprice") > 1000)))


@query("SELECT count(*)::BIGINT AS n_deleted FROM orders WHERE o_custkey >= 500 AND o_totalprice > 1000")
def delete_count(spark, sf):
    return _table(spark, sf, "orders").where("o_custkey >= 500 and o_totalprice > 1000").agg(F.count("*").alias("n_deleted"))


@query("""WITH s AS (SELECT user_id, event_id, value, 0 AS p FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, value, 2 FROM events WHERE event_type = 'view'),
l AS (SELECT user_id, p, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM s GROUP BY user_id, p),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS rn FROM l)
SELECT user_id, event_id, value FROM n WHERE rn = 1""")
def merge_newest_wins(spark, sf):
    events = _table(spark, sf, "events").select("user_id", "event_id", "value", "event_type")
    run = lambda kind: log.newest(events.where(F.col("event_type") == kind).drop("event_type"), "user_id", "event_id")
    return log.merge([run("purchase"), run("click"), run("view")], "user_id")


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, deleted, value FROM n WHERE rn = 1")
def compaction_keep_tombstones(spark, sf):
    return log.compact(_changes(spark, sf), "user_id", "event_id", bottommost=False)


@query(f"WITH log AS ({_LOG}), n AS ({_NEWEST}) SELECT user_id, event_id, deleted, value FROM n WHERE rn = 1 AND NOT deleted")
def compaction_bottommost(spark, sf):
    return log.compact(_changes(spark, sf), "user_id", "event_id", bottommost=True)


#: five events are a transaction; those with a 'signup' never commit; a commit's time is its last event
_VERSIONS = """x AS (SELECT event_id // 5 AS txn, max(event_id) AS last, bool_or(event_type = 'signup') AS open FROM events GROUP BY 1),
v AS (SELECT user_id AS k, e.event_id // 5 AS txn, event_id AS seq, CASE WHEN NOT open THEN last END AS commit_ts,
  event_type = 'error' AS deleted, value FROM events e JOIN x ON e.event_id // 5 = x.txn)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events").withColumn("txn", F.expr("event_id div 5"))
    txns = events.groupBy("txn").agg(F.max("event_id").alias("last"), F.bool_or(F.col("event_type") == "signup").alias("open"))
    return events.join(txns, "txn").select(
        F.col("user_id").alias("k"), "txn", F.col("event_id").alias("seq"), F.when(~F.col("open"), F.col("last")).alias("commit_ts"), (F.col("event_type") == "error").alias("deleted"), "value"
    )


def _sees(where: str, order: str) -> str:
    return f"""WITH {_VERSIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS rn FROM v WHERE {where})
SELECT k, txn, seq, commit_ts, deleted, value FROM n WHERE rn = 1 AND NOT deleted"""


@query(_sees("commit_ts <= 5000", "commit_ts DESC, seq DESC"))
def mvcc_snapshot_read(spark, sf):
    return mvcc.read(_versions(spark, sf), mvcc.SNAPSHOT, start_ts=5000)


@query(_sees("commit_ts IS NOT NULL", "commit_ts DESC, seq DESC"))
def mvcc_read_committed(spark, sf):
    return mvcc.read(_versions(spark, sf), mvcc.READ_COMMITTED)


@query(_sees("true", "seq DESC"))
def mvcc_read_uncommitted(spark, sf):
    return mvcc.read(_versions(spark, sf), mvcc.READ_UNCOMMITTED)


@query(_sees("commit_ts <= 5000 OR (txn = 1200 AND commit_ts IS NULL)", "coalesce(txn = 1200 AND commit_ts IS NULL, false) DESC, commit_ts DESC, seq DESC"))
def mvcc_own_writes_first(spark, sf):
    return mvcc.read(_versions(spark, sf), mvcc.SERIALIZABLE, start_ts=5000, txn=1200)


#: a transaction starts 40 events before its first write
_TOUCHED = "w AS (SELECT DISTINCT txn, k, txn * 5 - 40 AS start_ts FROM v)"


#: Rows that one task tells apart: Spark joins partitions by their compressed bytes, and pairs of numbers take a fiftieth of what their hash table does.
_TASK_ROWS = 1 << 20


def _touched(spark: SparkSession, sf: str, versions: DataFrame, *keys: Column) -> DataFrame:
    """What each transaction touches: the ``keys`` of its versions, dealt so that a task has some ``_TASK_ROWS`` of them however many events there are."""
    tasks = -(-_table(spark, sf, "events").count() * len(keys) // _TASK_ROWS) or 1
    pairs = versions.select("txn", F.explode(F.array(*keys)).alias("k")).repartition(tasks, "txn", "k").distinct()
    return pairs.select("txn", "k", (F.col("txn") * 5 - 40).alias("start_ts"))


def _late(touched: str) -> str:
    return f"SELECT txn, k, start_ts FROM {touched} t WHERE EXISTS (SELECT 1 FROM v WHERE v.k = t.k AND v.txn <> t.txn AND v.commit_ts > t.start_ts)"


@query(f"WITH {_VERSIONS}, {_TOUCHED} {_late('w')}")
def mvcc_write_conflicts(spark, sf):
    versions = _versions(spark, sf)
    return mvcc.conflicts(_touched(spark, sf, versions, F.col("k")), versions)


@query(f"WITH {_VERSIONS}, {_TOUCHED}, r AS (SELECT txn, k, start_ts FROM w UNION SELECT txn, (k + 1) % 150, start_ts FROM w) {_late('r')}")
def mvcc_serializable_conflicts(spark, sf):
    versions = _versions(spark, sf)
    return mvcc.conflicts(_touched(spark, sf, versions, F.col("k"), (F.col("k") + 1) % 150), versions)


@query(f"""WITH {_VERSIONS}, c AS (SELECT *, lead(commit_ts) OVER (PARTITION BY k ORDER BY commit_ts, seq) AS nxt FROM v WHERE commit_ts IS NOT NULL)
SELECT k, txn, seq, commit_ts, deleted, value FROM c WHERE nxt IS NULL OR (2000 >= commit_ts AND 2000 < nxt) OR (5000 >= commit_ts AND 5000 < nxt)""")
def mvcc_gc_survivors(spark, sf):
    return mvcc.survivors(_versions(spark, sf), spark.createDataFrame([(2000,), (5000,)], "start_ts long"))


@query("SELECT user_id AS k, count(*)::BIGINT AS n_versions FROM events GROUP BY user_id")
def mvcc_version_count(spark, sf):
    return mvcc.version_count(_versions(spark, sf))


#: the log of those transactions: an UPDATE for each event and, unless open, a COMMIT
_WAL = f"WITH {_VERSIONS}, "


def _wal_log(spark: SparkSession, sf: str) -> DataFrame:
    v = _versions(spark, sf)
    updates = v.select((F.col("seq") * 2).alias("lsn"), "txn", F.lit("UPDATE").alias("type"), "k", "deleted", "value")
    commits = v.where("commit_ts is not null").groupBy("txn").agg((F.max("commit_ts") * 2 + 1).alias("lsn"))
    none = lambda kind: F.lit(None).cast(kind)
    return updates.unionByName(commits.select("lsn", "txn", F.lit("COMMIT").alias("type"), none("long").alias("k"), none("boolean").alias("deleted"), none("double").alias("value")))


@query(_WAL + "y AS (SELECT 1) SELECT DISTINCT txn FROM v WHERE commit_ts IS NULL")
def wal_losers(spark, sf):
    return wal.losers(_wal_log(spark, sf))


_RECOVERED = _WAL + """n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM v WHERE commit_ts IS NOT NULL)
SELECT k, seq * 2 AS lsn, value FROM n WHERE rn = 1 AND NOT deleted"""


@query(_RECOVERED)
def wal_recovered_state(spark, sf):
    return wal.recover(_wal_log(spark, sf)).select("k", "lsn", "value")


_stored: dict[tuple[str, str], str] = {}


def _checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The checkpoint at LSN 10,000 as a table, made once for each application and input, as a running system would have it."""
    at = _stored.get((spark.sparkContext.applicationId, sf))
    if at is None:
        at = f"{scratch(spark)}/checkpoint-{uuid.uuid4().hex}"
        wal.checkpoint(_wal_log(spark, sf), 10_000).select("k", "lsn", "deleted", "value").write.parquet(at)
        _stored[spark.sparkContext.applicationId, sf] = at
    return spark.read.parquet(at)


@query(_RECOVERED)
def wal_recovered_from_checkpoint(spark, sf):
    return wal.recover(_wal_log(spark, sf), base=_checkpoint(spark, sf), base_lsn=10_000).select("k", "lsn", "value")


@query(f"""WITH {_VERSIONS}, o AS (SELECT *, lag(value) OVER w AS old_value, coalesce(lag(deleted) OVER w, true) AS old_deleted FROM v WINDOW w AS (PARTITION BY k ORDER BY seq)),
s AS (SELECT k, min(CASE WHEN commit_ts IS NULL THEN seq END) AS first_lost, max(seq) AS last FROM o GROUP BY k)
SELECT o.k, CASE WHEN first_lost IS NULL THEN value ELSE old_value END AS value FROM o JOIN s ON o.k = s.k AND o.seq = coalesce(first_lost, last)
WHERE NOT CASE WHEN first_lost IS NULL THEN deleted ELSE old_deleted END""")
def wal_physical_undo(spark, sf):
    """Undo of losers that interleave with commits: an update's old value is what the key had before it."""
    records = _wal_log(spark, sf)
    before = W.partitionBy("k").orderBy("lsn")
    updates = records.where("type = 'UPDATE'").withColumn("old_value", F.lag("value").over(before)).withColumn("old_deleted", F.coalesce(F.lag("deleted").over(before), F.lit(True)))
    return wal.recover_physically(updates.unionByName(records.where("type <> 'UPDATE'"), allowMissingColumns=True))


@query(f"""{_WAL}c AS (SELECT txn, max(commit_ts) AS last FROM v WHERE commit_ts IS NOT NULL GROUP BY txn),
r AS (SELECT seq * 2 AS p, txn, 'UPDATE' AS type, k FROM v UNION ALL SELECT last * 2 + 1, txn, 'COMMIT', NULL FROM c),
n AS (SELECT row_number() OVER (ORDER BY p) - 1 AS lsn, txn, type, k FROM r)
SELECT * FROM (SELECT * FROM n UNION ALL SELECT count(*), -1, 'BEGIN', 7 FROM n UNION ALL SELECT count(*) + 1, -1, 'UPDATE', 7 FROM n) WHERE lsn >= 1000""")
def wal_append_and_read_from(spark, sf):
    """A bulk segment, two records that are appended and flushed, and one that isn't."""
    schema = StructType.fromDDL("txn long, type string, k long")
    file = wal.LogFile(spark, f"{scratch(spark)}/log-{uuid.uuid4().hex}", schema)
    file.append_all(_wal_log(spark, sf).select("lsn", "txn", "type", "k").withColumnRenamed("lsn", "at"), ["at"])
    file.append(-1, "BEGIN", 7)
    file.append(-1, "UPDATE", 7)
    file.flush()
    file.append(-1, "COMMIT", None)  # lost
    return wal.LogFile(spark, file.root, schema).read_from(1000)


@query("SELECT o_orderkey, (7::BIGINT << 48) | (o_orderkey & 281474976710655) AS packed, 7::BIGINT AS table_id, o_orderkey & 281474976710655 AS unpacked FROM orders")
def key_pack(spark, sf):
    packed = pack_key(F.lit(7), F.col("o_orderkey"))
    return _table(spark, sf, "orders").select("o_orderkey", packed.alias("packed"), unpack_table(packed).alias("table_id"), unpack_key(packed).alias("unpacked"))


@query("""SELECT p_partkey, n_bytes FROM (SELECT p_partkey, (2 + strlen(p_name) + 2 + strlen(p_brand) + 2 + strlen(p_type) + 16)::BIGINT AS n_bytes FROM part) WHERE n_bytes > 48""")
def oversize_rows(spark, sf):
    part = _table(spark, sf, "part")
    return part.select("p_partkey", payload_bytes(part.schema, "p_partkey").alias("n_bytes")).where("n_bytes > 48")


@query("SELECT l_partkey, (5000 - sum(l_quantity))::BIGINT AS stock, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY l_partkey")
def new_order_stock(spark, sf):
    return _table(spark, sf, "lineitem").groupBy("l_partkey").agg((5000 - F.sum("l_quantity")).cast("long").alias("stock"), F.count("*").alias("n_lines"))


#: each event type is a trace of accesses to users, in the order of event_id
_FRAMES = [8, 32, 128]


def _accesses(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "events").select(F.col("event_type").alias("trace"), F.col("event_id").alias("pos"), F.col("user_id").alias("page"))


@query("""WITH a AS (SELECT event_type AS trace, event_id AS pos, user_id AS page, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events),
d AS (SELECT a.trace, a.pos, a.prev, count(DISTINCT b.page) AS distance FROM a LEFT JOIN a b ON b.trace = a.trace AND b.pos > a.prev AND b.pos < a.pos GROUP BY ALL)
SELECT trace, 1::BIGINT AS k, frames::BIGINT AS frames, count(*)::BIGINT AS accesses, (count(*) FILTER (prev IS NOT NULL AND distance < frames))::BIGINT AS hits
FROM d, (VALUES (8), (32), (128)) f(frames) GROUP BY trace, frames""")
def cache_lru_hits(spark, sf):
    return cache.replay(_accesses(spark, sf), _FRAMES, [1])


def cache_lru_k_hits(spark, sf):
    """Which page LRU-K evicts depends on its past evictions, so there is no SQL for it; tests replay it by brute force."""
    return cache.replay(_accesses(spark, sf), _FRAMES, [2, 3])


QUERIES["cache_lru_k_hits"] = cache_lru_k_hits


# -- through the engine: tables are loaded, written and read by its own statements, in both layouts

_ORDERS = "SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders"


def _engine(spark: SparkSession, layout: str = LOG, **options) -> Engine:
    return Engine(spark, f"{scratch(spark)}/engine-{uuid.uuid4().hex}", layout, **options)


def _loaded(spark: SparkSession, sf: str, layout: str) -> Engine:
    """The table orders: all rows, then an upsert of those of every seventh customer."""
    engine = _engine(spark, layout)
    engine.execute("CREATE TABLE orders (id INTEGER, cust INTEGER, status TEXT, priority TEXT)")
    rows = _table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS cust", "o_orderstatus AS status", "o_orderpriority AS priority")
    engine.upsert("orders", rows)
    engine.upsert("orders", rows.where("cust % 7 = 0").withColumn("status", F.lit("X")))
    return engine


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])


def _engine_queries(layout: str) -> None:
    def add(name: str, sql: str, run) -> None:
        QUERIES[f"engine_{name}_{layout}"], SQL[f"engine_{name}_{layout}"] = run, f"WITH v AS ({_ORDERS}) {sql}"

    def select(name: str, where: str, columns: str = "*") -> None:
        add(name, f"SELECT {columns} FROM v {where}", lambda spark, sf: _loaded(spark, sf, layout).execute(f"SELECT {columns} FROM orders {where}").frame)

    select("point", "WHERE id = 77")
    select("point_residual", "WHERE id = 77 AND cust > 100000")
    select("range", "WHERE id > 100 AND id <= 1250 AND status = 'X'")
    select("full", "", "status, id")
    select("unindexed", "WHERE cust >= 140 AND cust < 150 AND priority < '3'")
    gone = "cust >= 500 AND status = 'X'"

    def delete(spark, sf):
        engine = _loaded(spark, sf, layout)
        engine.execute(f"DELETE FROM orders WHERE {gone}")
        return engine.execute("SELECT * FROM orders").frame

    def delete_counts(spark, sf):
        engine = _loaded(spark, sf, layout)
        first, again, rest = (engine.execute(x).rows_affected for x in (f"DELETE FROM orders WHERE {gone}", f"DELETE FROM orders WHERE {gone}", "DELETE FROM orders"))
        return _one(spark, first=first, again=again, rest=rest, left_over=engine.execute("SELECT * FROM orders").rows_affected)

    def inserts(spark, sf):
        engine = _engine(spark, layout)
        engine.execute("CREATE TABLE t (id INTEGER, name TEXT, region INTEGER)")
        nations = [tuple(r) for r in _table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint)", "n_name", "cast(n_regionkey as bigint)").collect()]
        engine.insert("t", nations)
        for i, _, region in sorted(nations)[:3]:
            engine.execute(f"INSERT INTO t VALUES ({i}, 'renamed', {region})")
        engine.execute("INSERT INTO t VALUES (1000, 'new', -1);")
        return engine.execute("SELECT * FROM t").frame

    add("delete", f"SELECT * FROM v WHERE NOT ({gone})", delete)
    add("delete_counts", f"SELECT (count(*) FILTER ({gone}))::BIGINT AS first, 0::BIGINT AS again, (count(*) FILTER (NOT ({gone})))::BIGINT AS rest, 0::BIGINT AS left_over FROM v", delete_counts)
    add("scan_from", "SELECT * FROM v WHERE id >= 750", lambda spark, sf: _loaded(spark, sf, layout).scan("orders", 750))
    add("inserts", """, o AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i, n_name, n_regionkey FROM nation)
SELECT n_nationkey::BIGINT AS id, CASE WHEN i <= 3 THEN 'renamed' ELSE n_name END AS name, n_regionkey::BIGINT AS region FROM o UNION ALL SELECT 1000, 'new', -1""", inserts)


_engine_queries(LOG)
_engine_queries(SORTED)


def _batches(layout: str, n: int, compact_at: int) -> None:
    def run(spark, sf):
        """events in n commits of a change log with tombstones; tiers merge as they fill."""
        engine = _engine(spark, layout, compact_at=compact_at)
        engine.execute("CREATE TABLE e (user_id INTEGER, event_id INTEGER, event_type TEXT)")
        events = _table(spark, sf, "events").select("user_id", "event_id", "event_type")
        total = events.count()
        for i in range(n):
            part = events.where((F.col("event_id") * n >= i * total) & (F.col("event_id") * n < (i + 1) * total))
            engine.commit({"e": log.newest(part, "user_id", "event_id").withColumn(DELETED, F.col("event_type") == "error")})
        return engine.execute("SELECT * FROM e").frame

    name = f"engine_compaction_{layout}"
    QUERIES[name], SQL[name] = run, "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM n WHERE rn = 1 AND event_type <> 'error'"


_batches(LOG, 7, 2)
_batches(SORTED, 3, 4)


@query(f"""WITH v AS ({_ORDERS}) SELECT id, cust, CASE WHEN id = 5 THEN 'T' ELSE status END AS status, priority FROM v WHERE id <> 6
UNION ALL SELECT 200000000000, 1, 'N', 'new'""")
def engine_transactions(spark, sf):
    """One commits an upsert, a tombstone and a new key, one is aborted, and one loses to the first."""
    engine = _loaded(spark, sf, LOG)
    first, aborted, late = engine.begin(), engine.begin(), engine.begin()
    _, cust, _, priority = first.get("orders", 5)
    first.put("orders", (5, cust, "T", priority))
    first.put("orders", (200_000_000_000, 1, "N", "new"))
    if not first.delete("orders", 6) or first.delete("orders", 200_000_000_001):
        raise AssertionError("a tombstone reports whether its key was there")
    aborted.put("orders", (8, 1, "A", "aborted"))
    late.put("orders", (5, 1, "L", "late"))
    first.commit()
    aborted.abort()
    aborted.abort()
    try:
        late.commit()
    except ConflictError:
        return engine.execute("SELECT * FROM orders").frame
    raise AssertionError("the later committer has to lose")


@query(f"""WITH v AS ({_ORDERS}), k AS (SELECT status FROM v WHERE id = 7)
SELECT 'READ_UNCOMMITTED' AS level, 'C' AS pending, 'C' AS committed FROM k UNION ALL SELECT 'READ_COMMITTED', status, 'C' FROM k
UNION ALL SELECT 'SNAPSHOT', status, status FROM k UNION ALL SELECT 'SERIALIZABLE_SNAPSHOT', status, status FROM k""")
def engine_isolation(spark, sf):
    """What each level reads of a key while another transaction's write is pending, and after its commit and a compaction."""
    engine = _loaded(spark, sf, LOG)
    writer, readers = engine.begin(), {level: engine.begin(level) for level in (READ_UNCOMMITTED, READ_COMMITTED, SNAPSHOT, SERIALIZABLE)}
    _, cust, _, priority = writer.get("orders", 7)
    writer.put("orders", (7, cust, "C", priority))
    pending = {level: r.get("orders", 7)[2] for level, r in readers.items()}
    writer.commit()
    engine.compact("orders")
    rows = [(level, pending[level], r.get("orders", 7)[2]) for level, r in readers.items()]
    for r in readers.values():
        r.abort()
    return spark.createDataFrame(rows, "level string, pending string, committed string")


_LINES = "SELECT l_orderkey * 1000000 + l_partkey AS ol_id, l_orderkey AS o_id, l_partkey AS item, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_orderkey, l_partkey"


@query(f"""WITH l AS ({_LINES}), u AS (SELECT item, sum(quantity)::BIGINT AS used FROM l GROUP BY item)
SELECT 'stock' AS kind, p_partkey AS id, 5000 - coalesce(used, 0) AS a, 0::BIGINT AS b FROM part LEFT JOIN u ON item = p_partkey
UNION ALL SELECT 'line', ol_id, item, quantity FROM l
UNION ALL SELECT 'order', o_orderkey, o_custkey, o_orderkey % 4 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT o_id FROM l)""")
def engine_new_order(spark, sf):
    """New-Order as a batch: customers and stock are read, and stock, order lines and orders upserted in one commit."""
    engine = _engine(spark, max_row_bytes=None)
    for sql in ("customer (c_id INTEGER, c_name TEXT)", "stock (s_id INTEGER, s_quantity INTEGER)", "order_line (ol_id INTEGER, ol_o_id INTEGER, ol_item_id INTEGER, ol_quantity INTEGER)", "orders (o_id INTEGER, o_c_id INTEGER, o_w_id INTEGER)"):
        engine.execute(f"CREATE TABLE {sql}")
    engine.upsert_all({
        "customer": _table(spark, sf, "customer").selectExpr("c_custkey AS c_id", "c_name"),
        "stock": _table(spark, sf, "part").selectExpr("p_partkey AS s_id", "5000L AS s_quantity"),
    }, unique={"customer", "stock"})
    placed = _table(spark, sf, "orders").selectExpr("o_orderkey AS o_id", "o_custkey AS o_c_id", "o_orderkey % 4 AS o_w_id").join(engine.view("customer").selectExpr("c_id AS o_c_id"), "o_c_id", "left_semi")
    lines = _table(spark, sf, "lineitem").join(placed, F.col("l_orderkey") == F.col("o_id"), "left_semi").groupBy(F.col("l_orderkey").alias("ol_o_id"), F.col("l_partkey").alias("ol_item_id")).agg(F.sum("l_quantity").cast("long").alias("ol_quantity"))
    # a line's key is its order and its number there, dense and so within 48 bits; order * 10^6 + item, which the result shows, is shared by lines once items reach 10^6
    width = _table(spark, sf, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").count().agg(F.max("count")).first()[0] or 1
    number = F.row_number().over(W.partitionBy("ol_o_id").orderBy("ol_item_id"))
    lines = lines.withColumn("ol_id", F.col("ol_o_id") * width + number - 1)
    used = lines.groupBy(F.col("ol_item_id").alias("s_id")).agg(F.sum("ol_quantity").alias("used"))
    stock = engine.view("stock").join(used, "s_id").select("s_id", (F.col("s_quantity") - F.col("used")).alias("s_quantity"))
    orders = placed.join(lines.select(F.col("ol_o_id").alias("o_id")), "o_id", "left_semi")
    engine.upsert_all({"stock": stock, "order_line": lines, "orders": orders}, unique={"stock", "order_line", "orders"})
    return (
        engine.view("stock").selectExpr("'stock' AS kind", "s_id AS id", "s_quantity AS a", "0L AS b")
        .unionByName(engine.view("order_line").selectExpr("'line' AS kind", "ol_o_id * 1000000 + ol_item_id AS id", "ol_item_id AS a", "ol_quantity AS b"))
        .unionByName(engine.view("orders").selectExpr("'order' AS kind", "o_id AS id", "o_c_id AS a", "o_w_id AS b"))
    )


@query("""WITH e AS (SELECT user_id, event_id, event_id * 4 // (SELECT count(*) FROM events) AS i FROM events),
n AS (SELECT r.i AS batch, user_id, max(event_id) AS event_id FROM e, range(4) r(i) WHERE e.i <= r.i GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY user_id) AS pos FROM n WHERE user_id >= batch * 10)
SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM k WHERE pos <= 100 GROUP BY batch""")
def engine_write_mix(spark, sf):
    """Upserts in micro-batches, and a scan of 100 keys after each; keys are as skewed as the users of events are."""
    engine = _engine(spark, compact_at=3)
    engine.execute("CREATE TABLE e (user_id INTEGER, event_id INTEGER)")
    events = _table(spark, sf, "events").select("user_id", "event_id")
    total, scans = events.count(), []
    for i in range(4):
        part = events.where((F.col("event_id") * 4 >= i * total) & (F.col("event_id") * 4 < (i + 1) * total))
        engine.upsert("e", part.groupBy("user_id").agg(F.max("event_id").alias("event_id")), unique=True)
        scans.append(engine.scan("e", i * 10).limit(100).agg(F.lit(i).cast("long").alias("batch"), F.count("*").alias("n"), F.sum("event_id").alias("total")).where("n > 0"))
    return scans[0].unionByName(scans[1]).unionByName(scans[2]).unionByName(scans[3])
