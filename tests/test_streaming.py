"""Streams that stop and go on, tables that are updated in part, and SQLite files as tables."""

import sqlite3
from pathlib import Path

from pyspark.sql import functions as F

from loomspan.sources import sqlite
from loomspan.streaming import jobs

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_polls_go_on_in_the_middle_of_a_streak(spark, tmp_path):
    """The stream is stopped and started again from its checkpoint: the twentieth failure in a row is reported once, each file once."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []

    def step(rows):
        spark.createDataFrame(rows, jobs.POLL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.polled(spark.readStream.schema(jobs.POLL).parquet(f"{tmp_path}/in"))
        q = out.writeStream.foreachBatch(lambda df, _: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        new, got[:] = list(got), []
        return sorted(new, key=repr)

    fail = lambda job, a, b: [(job, s, False, None, 5, None) for s in range(a, b)]
    try:
        seen = [("x", "done"), ("y", "running"), ("z", "error")]
        assert step([("j", 0, True, "running", 5, seen), *fail("j", 1, 12), *fail("k", 0, 19)]) == [("j", 0, "done", "x", None), ("j", 0, "error", "z", None)]
        # k gets an answer and starts anew; j goes on with 11 failures and comes to 19
        assert step([*fail("j", 12, 20), ("k", 19, True, "running", 5, [("x", "done")]), *fail("k", 20, 30)]) == [("k", 19, "done", "x", None)]
        assert step([*fail("j", 20, 30), *fail("k", 30, 39)]) == [("j", 20, "given_up", None, 3)]
        assert step([("j", 31, True, "completed", 5, [("y", "done")]), ("k", 40, True, "completed", 5, [("x", "done"), ("w", "done")])]) == [("k", 40, "completed", None, None), ("k", 40, "done", "w", None)]
        assert step([*fail("k", 41, 70)]) == []
    finally:
        spark.conf.unset(STORE)


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_upserts_write_what_they_touch(spark, tmp_path):
    table = f"{tmp_path}/t"
    write = jobs.latest(spark, table, "k", "at", buckets=32)
    first = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("k"), F.lit(1).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    write(first, 0)
    second = spark.createDataFrame([("key7", 2, "new"), ("key8", 0, "old"), ("other", 5, "added"), ("key7", 1, "less")], "k string, at int, v string")
    write(second, 1)
    want = {r.k: r.v for r in first.collect()} | {"key7": "new", "other": "added"}
    assert {r.k: r.v for r in jobs.current(spark, table).collect()} == want
    assert len(list(Path(table, "v1").glob("bucket=*"))) <= 3 and size(f"{table}/v1") < size(f"{table}/v0") / 8
    before = sorted((p.name, p.read_bytes()) for p in Path(table, "manifest").glob("[0-9]*"))
    write(second, 1)  # run again
    assert {r.k: r.v for r in jobs.current(spark, table).collect()} == want
    assert sorted((p.name, p.read_bytes()) for p in Path(table, "manifest").glob("[0-9]*")) == before
    write(second.where("false"), 2)
    write(spark.createDataFrame([("key7", 9, "last")], "k string, at int, v string"), 3)
    assert {r.k: r.v for r in jobs.current(spark, table).collect()} == want | {"key7": "last"}


def test_sqlite_tables_in_parts(spark, tmp_path):
    path = f"{tmp_path}/cache.db"
    rows = [(i, f"k{i}", i / 7, None if i % 5 == 0 else bytes([i % 256]), '{"a": 1}') for i in range(1, 2001) if i % 9]
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "cache entries" (id INTEGER PRIMARY KEY, "the key" TEXT, score REAL, data BLOB, more JSON)')
        db.executemany('INSERT INTO "cache entries" VALUES (?, ?, ?, ?, ?)', rows)
        db.execute("CREATE TABLE none (a INT)")
        db.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('x', 1), ('y', NULL)")
    spark.dataSource.register(sqlite.SqliteTable)
    load = lambda table, **more: spark.read.format("sqlite_table").options(path=path, table=table, parts=7, **more).load()
    t = load("cache entries")
    assert t.dtypes == [("id", "bigint"), ("the key", "string"), ("score", "double"), ("data", "binary"), ("more", "string")]
    assert t.rdd.getNumPartitions() == 7
    same = lambda got: sorted((r[0], r[1], r[2], None if r[3] is None else bytes(r[3]), r[4]) for r in got.collect())
    assert same(t) == rows
    assert load("none").count() == 0 and sorted(map(tuple, load("keyed").collect())) == [("x", 1), ("y", None)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        t = load("cache entries", pushdown="true")
        kept = t.where((F.col("id") > 100) & F.col("the key").isin("k101", "k500", "k7") & F.col("data").isNotNull())
        assert same(kept) == [r for r in rows if r[0] > 100 and r[1] in ("k101", "k500", "k7") and r[3] is not None]
        assert same(t.where(F.length("the key") == 2)) == [r for r in rows if len(r[1]) == 2]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    # what SQLite is asked for is what is read
    reader = sqlite.FilteringReader(path, "cache entries", [("id", "bigint"), ("the key", "string")], 4)
    left = list(reader.pushFilters([sqlite.GreaterThan(("id",), 1990), sqlite.EqualTo(("unknown",), 1)]))
    assert len(left) == 1
    assert sorted(r for p in reader.partitions() for r in reader.read(p)) == [(r[0], r[1]) for r in rows if r[0] > 1990]
