import json
import random
import subprocess
import sys
import urllib.error
import urllib.parse
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keystrata.engine import LOG, SORTED, Engine
from keystrata.errors import ConflictError, SqlError, TransactionError
from keystrata.frontend import Server, run_seed, shell, to_json, to_text
from keystrata.streaming.ingest import upsert_stream
from keystrata.txn import READ_COMMITTED, READ_UNCOMMITTED, SERIALIZABLE, SNAPSHOT


@pytest.fixture(params=[LOG, SORTED])
def engine(spark, tmp_path, request):
    return Engine(spark, str(tmp_path / "db"), request.param)


def rows(engine, sql):
    return sorted(engine.execute(sql).rows())


def test_round_trip(engine):
    """Stale versions stay hidden behind later upserts, columns may repeat, and keys beyond the range match nothing."""
    assert engine.execute("CREATE TABLE parts (no INTEGER, bin TEXT, stock INTEGER)").message == "CREATE TABLE"
    engine.insert("parts", [(40, "c9", 7), (7, "a1", 90), (281474976710655, "z", 12), (7, "a2", 91)])
    assert rows(engine, "SELECT * FROM parts WHERE stock >= 12") == [(7, "a2", 91), (281474976710655, "z", 12)]
    assert engine.execute("INSERT INTO parts VALUES (7, 'moved', 3)").message == "INSERT 1"
    assert rows(engine, "SELECT bin, no, bin FROM parts WHERE no = 7") == [("moved", 7, "moved")]
    assert rows(engine, "SELECT no FROM parts WHERE stock >= 91") == []  # only a hidden version of 7 had as many
    assert engine.execute("DELETE FROM parts WHERE bin >= 'm'").message == "DELETE 2"
    assert rows(engine, "SELECT * FROM parts") == [(40, "c9", 7)]
    assert engine.execute("SELECT * FROM parts WHERE no = 281474976710696").rows() == []  # 2 ** 48 + 40
    assert engine.get("parts", 40) == (40, "c9", 7) and engine.get("parts", 7) is None
    assert engine.execute("DELETE FROM parts").rows_affected == 1
    for bad in ("SELECT * FROM nope", "CREATE TABLE parts (no INTEGER)", "INSERT INTO parts VALUES (1)", "SELECT bogus FROM parts", "SELECT * FROM parts WHERE no = 'x'"):
        with pytest.raises(SqlError):
            engine.execute(bad)


def test_random_operations_against_a_dict(spark, tmp_path):
    engine, want, rng = Engine(spark, str(tmp_path / "db")), {}, random.Random(777)
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    for _ in range(12):
        batch = [(rng.randrange(60), f"v{rng.randrange(9)}") for _ in range(20)]
        engine.insert("t", batch)
        want |= dict(batch)
        low = rng.randrange(60)
        gone = [k for k in want if low <= k < low + 6]
        assert engine.execute(f"DELETE FROM t WHERE id >= {low} AND id < {low + 6}").rows_affected == len(gone)
        for k in gone:
            del want[k]
    assert dict(engine.scan("t").collect()) == want
    engine.compact("t")
    assert [tuple(r) for r in engine.scan("t", 30).collect()] == sorted((k, v) for k, v in want.items() if k >= 30)
    assert engine.vacuum() and dict(engine.scan("t").collect()) == want
    again = Engine(spark, str(tmp_path / "db"))  # the catalog is part of the manifest
    assert dict(again.scan("t").collect()) == want and again.stats()["tables"]["t"]["delta_runs"] == 0


def test_key_filter_is_pushed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), compact_at=9)
    engine.execute("CREATE TABLE t (id INTEGER, v INTEGER)")
    engine.insert("t", [(i, i) for i in range(9)])
    plan = engine.execute("SELECT v FROM t WHERE id > 3 AND v = 5").frame._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan and "EqualTo(v,5)" not in plan
    engine.compact("t")
    plan = engine.execute("SELECT v FROM t WHERE id > 3 AND v = 5").frame._jdf.queryExecution().toString()
    assert "EqualTo(v,5)" in plan and "Window" not in plan


def start(engine):
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    engine.insert("t", [(1, "on"), (2, "on")])


def test_isolation_levels(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    start(engine)
    writer = engine.begin()
    readers = {level: engine.begin(level) for level in (READ_UNCOMMITTED, READ_COMMITTED, SNAPSHOT, SERIALIZABLE)}
    writer.put("t", (1, "new"))
    assert {level: r.get("t", 1)[1] for level, r in readers.items()} == {READ_UNCOMMITTED: "new", READ_COMMITTED: "on", SNAPSHOT: "on", SERIALIZABLE: "on"}
    writer.commit()
    engine.compact("t")  # what snapshots still read stays
    assert {level: r.get("t", 1)[1] for level, r in readers.items()} == {READ_UNCOMMITTED: "new", READ_COMMITTED: "new", SNAPSHOT: "on", SERIALIZABLE: "on"}
    late = readers[READ_COMMITTED]
    late.put("t", (1, "lost"))
    with pytest.raises(ConflictError):
        late.commit()
    with pytest.raises(TransactionError):
        late.get("t", 1)
    assert engine.get("t", 1) == (1, "new")


@pytest.mark.parametrize("level", [SNAPSHOT, SERIALIZABLE])
def test_write_skew(spark, tmp_path, level):
    engine = Engine(spark, str(tmp_path / "db"))
    start(engine)
    a, b = engine.begin(level), engine.begin(level)
    for t in (a, b):
        assert t.get("t", 1) and t.get("t", 2)
    a.put("t", (1, "off"))
    b.put("t", (2, "off"))
    a.commit()
    if level == SERIALIZABLE:
        with pytest.raises(ConflictError):
            b.commit()
    else:
        b.commit()
    c = engine.begin()
    assert c.delete("t", 1) and not c.delete("t", 9)
    assert c.get("t", 1) is None
    c.abort()
    assert engine.get("t", 1) == (1, "off")


def test_uncommitted_runs_are_not_seen(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    start(engine)
    t = engine.table("t")
    lost = spark.createDataFrame([(5, "lost", 9, False)], t.log_struct())
    engine.store.write_run(lost, t.schema)  # a writer that died before it published
    assert engine.get("t", 5) is None
    assert len(engine.vacuum()) == 1
    stale = engine.manifest()
    with pytest.raises(ConflictError):
        engine.store.publish(stale)


def test_upsert_frame_and_stream(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("CREATE TABLE t (id INTEGER, v INTEGER)")
    engine.upsert("t", spark.range(100).select("id", (F.col("id") * 2).alias("v")))
    with pytest.raises(SqlError):
        engine.upsert("t", spark.sql("SELECT 1L AS id, CAST(NULL AS BIGINT) AS v"))
    for bad in ("1L AS id, 'x' AS v", "-1L AS id, 1L AS v", "1L AS id, 1.5D AS v", "id % 2 AS id, id AS v"):
        with pytest.raises(SqlError):
            engine.upsert("t", spark.sql(f"SELECT {bad} FROM range(3)"))
    spark.sql("SELECT id, id + 1000 AS v, n FROM range(3) CROSS JOIN (SELECT 1 AS n)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long, n int").parquet(str(tmp_path / "in"))
    upsert_stream(engine, "t", stream, str(tmp_path / "cp"), "n").awaitTermination()
    assert engine.view("t").count() == 100 and engine.get("t", 2) == (2, 1002)


def test_front_ends(spark, tmp_path):
    engine, said = Engine(spark, str(tmp_path / "db")), []
    assert run_seed(engine, "-- users\n\nCREATE TABLE u (id INTEGER, name TEXT)\nINSERT INTO u VALUES (1, 'é\"')\n") == 2
    with pytest.raises(SqlError, match="line 2"):
        run_seed(engine, "\nBAD\n")
    assert json.loads(to_json(engine.execute("SELECT * FROM u"))) == {"columns": ["id", "name"], "rows": [[1, 'é"']], "rows_affected": 1, "message": "SELECT 1"}
    assert to_text(engine.execute("SELECT id FROM u")) == "id\n1\nSELECT 1"
    shell(engine, ["help", "sql BAD", "what", "SELECT id FROM u", "quit", "help"], said.append)
    assert len(said) == 4 and said[1].startswith("error") and said[2].startswith("unknown")
    server = Server(engine).start()

    def get(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", method=method)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    ask = lambda sql: get("/query?sql=" + urllib.parse.quote(sql))
    assert get("/health") == (200, "ok")
    assert json.loads(ask("SELECT * FROM u")[1])["rows"] == [[1, 'é"']]
    assert [ask("DELETE FROM u")[0], ask("nonsense")[0], get("/query")[0], get("/nope")[0], get("/health", "POST")[0]] == [400, 400, 400, 404, 405]
    server.stop()


def test_upsert_of_large_rows(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    engine.upsert("t", spark.sql("SELECT 1 AS id, repeat('x', 62) AS v"))
    with pytest.raises(SqlError, match="1 rows over 64 bytes"):
        engine.upsert("t", spark.sql("SELECT 2 AS id, repeat('x', 63) AS v"))
    assert engine.view("t").count() == 1


def test_commit_stands_if_compaction_loses(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "db"), SORTED)
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")

    def lose(name):
        raise ConflictError("another writer was first")

    monkeypatch.setattr(engine, "compact", lose)
    assert engine.execute("INSERT INTO t VALUES (1, 'a')").message == "INSERT 1"
    assert engine.get("t", 1) == (1, "a")


def test_vacuum_spares_young_runs(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    start(engine)
    t = engine.table("t")
    engine.store.write_run(spark.createDataFrame([(5, "x", 9, False)], t.log_struct()), t.schema)
    assert engine.vacuum(min_age_s=3600) == [] and len(engine.vacuum()) == 1


def test_versions_of_every_reader_survive_compaction(spark, tmp_path):
    engine, readers = Engine(spark, str(tmp_path / "db"), compact_at=99), []
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    for i in range(4):
        engine.insert("t", [(1, f"v{i}"), (10 + i, "once")])
        readers += [engine.begin(), engine.begin()] if i % 2 else []
    engine.delete("t")
    engine.compact("t")
    assert [r.get("t", 1) for r in readers] == [(1, "v1"), (1, "v1"), (1, "v3"), (1, "v3")]
    assert engine.get("t", 1) is None and engine.changes("t").where("id = 1").count() == 3
    for r in readers:
        r.abort()


CHILD = """
import os, sys
from pyspark.sql import SparkSession
from keystrata.engine import Engine
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
engine = Engine(spark, sys.argv[1])
engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
engine.insert("t", [(i, "kept") for i in range(50)])
engine.store.publish = lambda manifest: os._exit(9)
engine.insert("t", [(i, "lost") for i in range(40, 60)])
"""


def test_a_killed_writer_loses_only_what_it_did_not_publish(spark, tmp_path):
    at = str(tmp_path / "db")
    done = subprocess.run([sys.executable, "-c", CHILD, at], timeout=120, capture_output=True, cwd=Path(__file__).resolve().parents[1])
    assert done.returncode == 9, done.stderr[-2000:]
    engine = Engine(spark, at)
    assert sorted(map(tuple, engine.view("t").collect())) == [(i, "kept") for i in range(50)]
    assert len(engine.vacuum()) == 1 and engine.view("t").count() == 50


def between(engine, method, act):
    """Let ``act`` happen once, right before the store's next call of ``method``."""
    real, done = getattr(engine.store, method), []

    def wrapped(*args, **kwargs):
        if not done:
            done.append(1)
            act()
        return real(*args, **kwargs)

    setattr(engine.store, method, wrapped)


def pair(spark, tmp_path, **options):
    """Two engines on one root, as of two processes, and a table."""
    a, b = (Engine(spark, str(tmp_path / "db"), **options) for _ in range(2))
    start(a)
    return a, b


def test_delete_spares_rows_that_another_writer_has_changed(spark, tmp_path):
    a, b = pair(spark, tmp_path)
    between(a, "publish", lambda: b.insert("t", [(1, "changed")]))
    assert a.execute("DELETE FROM t WHERE v = 'on'").rows_affected == 1
    assert rows(b, "SELECT * FROM t") == [(1, "changed")]
    between(a, "publish", lambda: b.execute("DELETE FROM t"))
    assert a.execute("DELETE FROM t").rows_affected == 0


def test_snapshot_survives_another_engines_compaction(spark, tmp_path):
    a, b = pair(spark, tmp_path, compact_at=2)
    old = a.begin()
    for i in range(3):
        b.insert("t", [(1, f"new{i}"), (3, "late")])
    b.compact("t")
    assert old.get("t", 1) == (1, "on") and old.get("t", 3) is None and b.get("t", 1) == (1, "new2")
    assert b.changes("t").where("id = 1").count() == 2
    old.abort()
    b.compact("t")
    assert b.changes("t").where("id = 1").count() == 1
    expired = a.begin()
    b.lease_s = -1  # as if the lease were too old
    b.insert("t", [(1, "newer")])
    b.compact("t")
    with pytest.raises(TransactionError):
        expired.get("t", 1)


def test_conflict_with_a_tombstone_that_was_compacted_away(spark, tmp_path):
    for lease_s in (3600, -1):
        a, b = pair(spark, tmp_path / str(lease_s), lease_s=lease_s)
        writer = a.begin()
        writer.put("t", (1, "mine"))
        b.execute("DELETE FROM t WHERE id = 1")
        b.compact("t")
        with pytest.raises(ConflictError):
            writer.commit()
        assert b.get("t", 1) is None


def test_a_lease_that_comes_too_late_is_taken_anew(spark, tmp_path):
    a, b = pair(spark, tmp_path)

    def meanwhile():
        b.insert("t", [(1, "new")])
        b.compact("t")

    between(a, "lease", meanwhile)
    assert a.begin().get("t", 1) == (1, "new")


@pytest.mark.parametrize("level", [READ_UNCOMMITTED, READ_COMMITTED, SNAPSHOT, SERIALIZABLE])
def test_isolation_over_two_engines(spark, tmp_path, level):
    a, b = pair(spark, tmp_path)
    reader, writer = b.begin(level), a.begin()
    writer.put("t", (1, "new"))
    assert reader.get("t", 1) == (1, "on")  # pending writes are seen within a process only
    writer.commit()
    b.compact("t")
    assert reader.get("t", 1) == ((1, "new") if level in (READ_UNCOMMITTED, READ_COMMITTED) else (1, "on"))
    reader.put("t", (1, "lost"))
    with pytest.raises(ConflictError):
        reader.commit()


def test_lost_update_over_two_engines(spark, tmp_path):
    engines, done, lost = pair(spark, tmp_path, compact_at=3), 0, 0
    engines[0].insert("t", [(9, "0")])
    for i in range(6):
        first, second = (e.begin() for e in engines)
        for t in (first, second):
            t.put("t", (9, str(int(t.get("t", 9)[1]) + 1)))
        (first if i % 2 else second).commit()
        done += 1
        try:
            (second if i % 2 else first).commit()
        except ConflictError:
            lost += 1
    assert (done, lost) == (6, 6) and engines[1].get("t", 9) == (9, "6")


def test_tiers(spark, tmp_path):
    """A row is rewritten once a tier, and tombstones go where nothing lies below."""
    engine, moved, runs = Engine(spark, str(tmp_path / "db"), compact_at=2), [0], []
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    real = engine.store.write_run

    def counted(frame, schema, n_files=None, expected=0):
        moved[0] += expected
        return real(frame, schema, n_files, expected)

    engine.store.write_run = counted
    for i in range(16):
        engine.insert("t", [(4 * i + k, "x") for k in range(4)])
        runs.append(len(engine.table("t").runs))
    assert runs == [bin(i).count("1") for i in range(1, 17)]  # as in a binary counter
    assert moved[0] == 64 * 4  # every row once in each of four tiers
    assert [len(x) for x in engine.table("t").tiers] == [0, 0, 0, 0, 1] and engine.table("t").clean
    engine.delete("t", ())
    engine.insert("t", [(1, "y")])
    assert len(engine.table("t").tiers[1]) == 1 and engine.changes("t").where("_deleted").count() == 63  # tombstones stay above older runs
    assert engine.scan("t").collect() == [(1, "y")]
    engine.compact("t")
    assert engine.changes("t").count() == 1 and engine.stats()["tables"]["t"]["tiers"][-1] == 1


def test_layout(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), file_bytes=4000)
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    engine.insert("t", [(1, "x")])
    assert engine.stats()["tables"]["t"]["bytes"] < 20_000
    engine.upsert("t", spark.range(4000).select("id", F.lit("x").alias("v")), unique=True)
    engine.compact("t")
    all_files, few, one = (len(engine.execute(f"SELECT * FROM t {w}").frame.inputFiles()) for w in ("", "WHERE id >= 1000 AND id < 1100", "WHERE id = 3999"))
    assert all_files >= 4 and few <= 2 and one == 1
    assert engine.execute("SELECT * FROM t WHERE id >= 1000 AND id < 1100").rows_affected == 100
    assert engine.stats()["tables"]["t"]["bytes"] < 200_000


def test_a_compacting_task_has_bounded_rows(spark, tmp_path):
    """Rows that Parquet packs well: their bytes alone would make one file, sorted in one task."""
    engine = Engine(spark, str(tmp_path / "db"), SORTED, file_rows=500)
    engine.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    engine.upsert("t", spark.range(4000).select("id", F.lit("x").alias("v")))
    rows = lambda: [r["count"] for r in engine.changes("t").groupBy("_metadata.file_name").count().collect()]
    assert len(rows()) >= 8 and max(rows()) < 1000 and engine.table("t").clean
    engine.execute("DELETE FROM t WHERE id >= 1000 AND id < 1500")
    late = engine.begin()
    engine.upsert("t", spark.range(3990, 4010).select("id", F.lit("y").alias("v")))
    assert late.get("t", 3995) == (3995, "x") and max(rows()) < 1000  # compacted, but with what the lease reads
    late.abort()
    engine.compact("t")
    assert engine.table("t").clean and max(rows()) < 1000 and engine.changes("t").where("_deleted").count() == 0
    want = [(i, "y" if i >= 3990 else "x") for i in range(4010) if not 1000 <= i < 1500]
    assert [tuple(r) for r in engine.scan("t").collect()] == want and engine.get("t", 4009) == (4009, "y") and engine.get("t", 1200) is None


def test_manifests_are_hinted_and_expire(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), compact_at=99)
    start(engine)
    for i in range(24):
        engine.insert("t", [(i, "v")])
    listed = []
    real = engine.store._versions
    engine.store._versions = lambda: listed.append(1) or real()
    assert engine.manifest().version == 26 and not listed
    engine.vacuum()
    assert len(real()) == 20
    (tmp_path / "db" / "manifest" / "_last").write_text("1")  # a hint to what is gone
    (tmp_path / "db" / "manifest" / "._last.crc").unlink(missing_ok=True)
    assert engine.manifest().version == 26


def test_upsert_evaluates_its_frame_once(spark, tmp_path):
    a, b = pair(spark, tmp_path)
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for x in it:
            seen.add(x.num_rows)
            yield x

    frame = spark.range(10, 15).selectExpr("id", "cast(rand() as string) AS v").mapInArrow(count, "id long, v string")
    between(a, "publish", lambda: b.insert("t", [(30, "first")]))  # so that it has to try again
    a.upsert("t", frame)
    assert seen.value == 5 and b.view("t").count() == 8
    before = len(list((tmp_path / "db" / "data").iterdir()))
    with pytest.raises(SqlError):
        a.upsert("t", spark.sql("SELECT -1L AS id, 'x' AS v"))
    assert len(list((tmp_path / "db" / "data").iterdir())) == before


def test_front_ends_fetch_a_stated_number_of_rows(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    start(engine)
    told = json.loads(to_json(engine.execute("SELECT * FROM t"), limit=1))
    assert len(told["rows"]) == 1 and told["truncated"] and told["rows_affected"] == 2
    assert to_text(engine.execute("SELECT v FROM t"), limit=1) == "v\non\n...\nSELECT 2"


def test_shell_program(tmp_path):
    seed = tmp_path / "seed.sql"
    seed.write_text("CREATE TABLE t (id INTEGER, v TEXT)\n-- a row\nINSERT INTO t VALUES (1, 'a')\n")
    done = subprocess.run([sys.executable, "-m", "keystrata", str(tmp_path / "db"), "--seed", str(seed)], input="SELECT * FROM t\nexit\n", timeout=180, capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1])
    assert done.returncode == 0 and "1 | a" in done.stdout, done.stderr[-2000:]
