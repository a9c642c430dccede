import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata import queries
from keystrata.operators import cache, log, mvcc, wal

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("nation", "part", "orders", "customer", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_new_order_with_a_million_parts(spark, tmp_path):
    """Lines of neighbouring orders whose order * 10^6 + item is the same number."""
    db = duckdb.connect()
    db.sql("CREATE TABLE customer AS SELECT i AS c_custkey, 'c' || i AS c_name FROM range(3) t(i)")
    db.sql("CREATE TABLE part AS SELECT unnest([4, 9, 1000004, 1000009, 2000004]) AS p_partkey")
    db.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, i % 4 AS o_custkey FROM range(7) t(i)")
    db.sql("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, p_partkey AS l_partkey, (1 + r)::DOUBLE AS l_quantity FROM orders, part, range(2) t(r) WHERE o_orderkey <> 2")
    for t in ("customer", "part", "orders", "lineitem"):
        db.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    found = queries.QUERIES["engine_new_order"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("kind", "id", "a", "b").collect())) == sorted(db.sql(queries.SQL["engine_new_order"]).fetchall())


def test_merge_cases(spark):
    run = lambda *r: spark.createDataFrame(list(r), "k long, v string, deleted boolean")
    new, mid, old = run((1, "a", False), (3, None, True)), run((1, "b", False), (2, "c", False)), run((2, "d", False), (3, "e", False))
    assert sorted(map(tuple, log.merge([new, mid, old], "k").collect())) == [(1, "a", False), (2, "c", False), (3, None, True)]
    assert log.merge([run()], "k").count() == 0


def test_gc_and_count(spark):
    v = spark.createDataFrame([(1, t, t, t, False) for t in range(1, 6)], "k long, txn long, seq long, commit_ts long, deleted boolean")
    none = spark.createDataFrame([], "start_ts long")
    assert [r["seq"] for r in mvcc.survivors(v, none).collect()] == [5]
    held = spark.createDataFrame([(1,)], "start_ts long")
    assert sorted(r["seq"] for r in mvcc.survivors(v, held).collect()) == [1, 5]
    assert mvcc.collectable(v, held).count() == 3
    assert mvcc.version_count(v).first()["n_versions"] == 5


def test_recovery(spark):
    records = spark.createDataFrame([(1, 1, "UPDATE", 1, False, "a"), (2, 1, "COMMIT", None, None, None), (3, 2, "UPDATE", 1, False, "lost"), (4, 2, "UPDATE", 2, False, "lost")], "lsn long, txn long, type string, k long, deleted boolean, v string")
    assert [tuple(r) for r in wal.recover(records).select("k", "v").collect()] == [(1, "a")]
    assert [r["txn"] for r in wal.losers(records).collect()] == [2]


def test_physical_undo_against_a_replay(spark):
    rng, state, records = random.Random(11), {}, []
    txns = {t: rng.random() < 0.6 for t in range(12)}  # committed or not
    for lsn in range(80):
        k, t = rng.randrange(9), rng.randrange(12)
        new = (rng.random() < 0.2, f"v{lsn}")
        records.append((lsn, t, "UPDATE", k, *new, *state.get(k, (True, None))))
        state[k] = new
    records += [(100 + t, t, "COMMIT", None, None, None, None, None) for t, done in txns.items() if done]
    for r in sorted((r for r in records if r[2] == "UPDATE" and not txns[r[1]]), reverse=True):
        state[r[3]] = r[6:8]
    df = spark.createDataFrame(records, "lsn long, txn long, type string, k long, deleted boolean, value string, old_deleted boolean, old_value string")
    assert {r["k"]: r["value"] for r in wal.recover_physically(df).collect()} == {k: v for k, (gone, v) in state.items() if not gone}


def test_log_file(spark, tmp_path):
    schema = StructType.fromDDL("txn long, type string")
    file = wal.LogFile(spark, str(tmp_path / "log"), schema)
    assert file.flush() == -1 and file.read_from().count() == 0
    assert [file.append(1, "BEGIN"), file.append(1, "COMMIT")] == [0, 1] and file.flushed_lsn == -1 and file.flush() == 1
    assert file.append_all(spark.range(7).selectExpr("id AS txn", "'UPDATE' AS type"), ["txn"]) == 8
    file.append(9, "BEGIN")
    again = wal.LogFile(spark, str(tmp_path / "log"), schema)
    assert [r["lsn"] for r in again.read_from(3).collect()] == [3, 4, 5, 6, 7, 8] and [r["txn"] for r in again.read_from(2).collect()] == list(range(7))
    assert again.next_lsn == 9 and len(again.read_from(5).inputFiles()) < len(again.read_from(0).inputFiles())


def test_conflicts_and_spans_against_brute_force(spark):
    rng = random.Random(5)
    commit = {t: t * 3 + 2 for t in range(20) if t % 4}
    v = [(rng.randrange(4), t, s, commit.get(t), rng.random() < 0.2) for s, t in enumerate(sorted(rng.randrange(20) for _ in range(90)))]
    touched = [(rng.randrange(20), rng.randrange(5), rng.randrange(70)) for _ in range(60)]
    versions = spark.createDataFrame(v, "k long, txn long, seq long, commit_ts long, deleted boolean")
    got = mvcc.conflicts(spark.createDataFrame(touched, "txn long, k long, start_ts long"), versions)
    assert sorted(map(tuple, got.collect())) == sorted(x for x in touched if any(r[0] == x[1] and r[1] != x[0] and r[3] and r[3] > x[2] for r in v))
    starts = [1, 14, 14, 30, 99]
    seen = {max((r for r in v if r[0] == k and r[3] and r[3] <= s), key=lambda r: (r[3], r[2]), default=None) for k in range(4) for s in [*starts, 10**9]} - {None}
    snapshots = spark.createDataFrame([(s,) for s in starts], "start_ts long")
    assert {tuple(r) for r in mvcc.survivors(versions, snapshots).select("k", "txn", "seq", "commit_ts", "deleted").collect()} == seen
    rest = mvcc.collectable(versions, snapshots).select("k", "txn", "seq", "commit_ts", "deleted").collect()
    assert sorted(map(tuple, rest)) == sorted(r for r in v if r[3] and r not in seen)


def test_what_transactions_touch_is_dealt_by_rows(spark, monkeypatch):
    """Each pair once, and few of them in a task, whatever they take when compressed."""
    monkeypatch.setattr(queries, "_TASK_ROWS", 100)
    versions = queries._versions(spark, SF)
    n, k = spark.read.parquet(f"{SF}/events.parquet").count(), F.col("k")
    got = queries._touched(spark, SF, versions, k, (k + 1) % 150)
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 200 < n
    pairs = [tuple(r) for r in versions.select("txn", "k").collect()]
    assert sorted(map(tuple, got.collect())) == sorted({(t, x, t * 5 - 40) for t, u in pairs for x in (u, (u + 1) % 150)})


def hits_by_scan(pages, frames, k):
    """A cache that looks at every page it holds before each eviction."""
    held, hits = {}, 0
    for now, page in enumerate(pages):
        hits += page in held
        if page not in held and len(held) == frames:
            del held[min(held, key=lambda p: (len(held[p]) >= k, held[p][0]))]
        held[page] = [*held.get(page, []), now][-k:]
    return hits


def test_cache_replay(spark):
    rng = random.Random(3)
    rows = [(f"t{t}" if t else None, pos, None if page == 5 else page) for t in range(3) for pos, page in enumerate(int(rng.paretovariate(0.6)) % 60 for _ in range(700))]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "trace string, pos long, page long, k string")
    got = {(r["trace"], r["k"], r["frames"]): (r["accesses"], r["hits"]) for r in cache.replay(frame, [1, 8, 20], [1, 2, 3]).collect()}
    by = {t: [p for u, _, p in sorted((r for r in rows if r[0] == t), key=lambda r: r[1])] for t in (None, "t1", "t2")}
    assert got == {(t, k, f): (700, hits_by_scan(pages, f, k)) for t, pages in by.items() for k in (1, 2, 3) for f in (1, 8, 20)}
    assert cache.replay(frame.limit(0), [8], [2]).count() == 0
    with pytest.raises(ValueError):
        cache.LruK(0, 2)


def test_registered_cache_replay_against_brute_force(spark):
    events = [tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type", "event_id", "user_id").collect()]
    got = {(r["trace"], r["k"], r["frames"]): r["hits"] for r in queries.QUERIES["cache_lru_k_hits"](spark, SF).collect()}
    pages = {t: [p for u, _, p in sorted(events, key=lambda r: r[1]) if u == t] for t in {r[0] for r in events}}
    assert got == {(t, k, f): hits_by_scan(p, f, k) for t, p in pages.items() for k in (2, 3) for f in (8, 32, 128)}


@pytest.mark.parametrize(("frames", "k", "percent"), [(8, 1, 10.4), (8, 2, 24.0), (256, 1, 49.0), (256, 2, 58.5), (2048, 1, 75.9), (2048, 2, 79.6)])
def test_published_hit_rates(frames, k, percent):
    """200,000 accesses to 10,000 pages, Zipf with skew 0.99; our own random numbers, so to a point."""
    weight = 1 / np.arange(1, 10_001) ** 0.99
    pages = np.random.default_rng(42).choice(10_000, 200_000, p=weight / weight.sum()).tolist()
    lru = cache.LruK(frames, k)
    assert abs(100 * sum(map(lru.access, pages)) / len(pages) - percent) < 1


def test_published_scan_counts(spark):
    facts = spark.range(300_000).selectExpr("1000 + id % 100000 AS l_extendedprice", "20200101 + (id * 7919) % 1000 AS l_shipdate")
    assert [facts.where(f"l_shipdate <= {20200101 + 10 * p}").count() for p in (10, 50, 90)] == [30_300, 150_300, 270_300]
