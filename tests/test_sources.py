"""Sources and streams that need files."""

import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import files, filetree, sqlite
from tallyspark.streaming import queue as stream


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "q.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE messages(seq INTEGER PRIMARY KEY, id TEXT, at REAL, raw BLOB)")
        db.executemany("INSERT INTO messages VALUES(?,?,?,?)", [(k, f"m{k}" if k != 3 else None, k / 2, b"x") for k in range(1, 21)])
        db.execute("CREATE TABLE empty(a INTEGER)")
    return path


def test_sqlite(spark, store):
    df = sqlite.read(spark, store, "messages", 3)
    assert df.schema.simpleString() == "struct<seq:bigint,id:string,at:double,raw:binary>"
    assert df.rdd.getNumPartitions() == 3 and df.count() == 20
    assert [r.id for r in df.where("seq > 2 AND seq <= 5").orderBy("seq").collect()] == [None, "m4", "m5"]
    assert [r.seq for r in df.where("id IS NULL").collect()] == [3]
    assert [r.seq for r in df.where(F.col("id") == "m7").select("seq").collect()] == [7]
    assert sqlite.read(spark, store, "empty").count() == 0


def test_sqlite_answers_comparisons_itself():
    from pyspark.sql.datasource import GreaterThan, StringContains

    reader = sqlite._Reader("x", "t", ["a"], 1)
    kept = list(reader.pushFilters([GreaterThan(("a",), 3), StringContains(("a",), "x")]))
    assert len(kept) == 1 and reader.where == [('"a" > ?', 3)]


def test_tree_written_by_executors(spark, tmp_path):
    rows = [("r/a/x.md", "é\n", None), ("r/.h", None, None), ("r/a/last", None, "x.md")]
    entries = spark.createDataFrame(rows, "path string, content string, target string")
    base = f"file:{tmp_path}/t"
    for _ in range(2):  # a second attempt replaces each entry
        top = filetree.write(entries.repartition(3), base)
    found = {(r.path, r.kind, r.mode if r.kind == "file" else None, r.size if r.kind == "file" else None, r.target) for r in filetree.read(spark, f"{top}/r").collect()}
    assert found == {("a", "dir", None, None, None), ("a/x.md", "file", "0o644", 3, None), (".h", "file", "0o644", 0, None), ("a/last", "symlink", None, None, "x.md")}
    with pytest.raises(ValueError):
        filetree.write(entries, "hdfs://x/t")
    with pytest.raises(Exception, match="leaves its tree"):
        filetree.write(spark.createDataFrame([("../../x", "", None)], entries.schema), base)


def test_whole_files_and_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": 2}')
    (tmp_path / "b.json").write_text('{"b": 3}')
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text('{"b": 3} {')
    paths = [str(tmp_path / f"{x}.json") for x in "abcd"]
    rows = {r.path[-6:]: r.error for r in files.json_objects(spark, *paths).collect()}
    assert rows == {"a.json": None, "b.json": None, "c.json": "not an object", "d.json": "cannot be read"}
    assert files.settings(*paths, str(tmp_path / "none")) == {"a": 1, "b": 3}


def test_jobs_stream(spark, tmp_path):
    schema = "task_id string, seq bigint, state string, images array<string>, error string"
    stream.use_state_store(spark)
    got = []
    for n, rows in enumerate(([("t", 1, "submitted", None, None), ("u", 2, "processing", None, None)], [("t", 3, "completed", ["i"], None), ("t", 4, "failed", None, "late")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stream.jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = run.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        for _ in range(100):  # timers keep such a stream running; it is stopped once the rows have gone through
            time.sleep(0.3)
            if sum(p.numInputRows for p in q.recentProgress) >= len(rows):  # progress is told once a batch is done
                break
        q.stop()
        assert q.exception() is None
        got.append({(r.task_id, r.state) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()})
    assert got == [set(), {("t", "completed")}]


def test_quiet_periods_of_a_stream(spark, tmp_path):
    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:03"), ("a", "2026-01-01 00:01:00"), ("b", "2026-01-01 02:00:00")]
    changes = spark.createDataFrame(rows, "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = stream.quiet_periods(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.n) for r in spark.table("quiet").collect()) == [("a", 1), ("a", 2)]
    assert sorted((r.path, r.n) for r in stream.quiet_periods(changes).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_an_event_log_as_a_stream(spark, tmp_path):
    """Rows that come after a run are all that the next one reads, however the table has been cut into ranges."""
    path, out = str(tmp_path / "log.db"), str(tmp_path / "out")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE events (seq INTEGER PRIMARY KEY AUTOINCREMENT, at REAL, event TEXT)")

    def run(rows):
        db.executemany("INSERT INTO events(at, event) VALUES(?, ?)", rows)
        db.commit()
        q = sqlite.follow(spark, path, "events", after=2, partitions=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.seq, r.event) for r in spark.read.schema("seq bigint, at double, event string").parquet(out).collect())

    assert run([(k / 2, f"e{k}") for k in range(1, 8)]) == [(k, f"e{k}") for k in range(3, 8)]
    assert run([]) == [(k, f"e{k}") for k in range(3, 8)]
    assert run([(9.0, "e8")]) == [(k, f"e{k}") for k in range(3, 9)]
    db.close()
