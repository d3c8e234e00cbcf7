from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sessionloom.operators import eventlog
from sessionloom.streaming import ingest


def run(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_gate_remembers_between_runs(spark, tmp_path):
    schema = "session string, event_id bigint, captured_at double, source_type string, bytes bigint"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [[("a", 1, 1.0, "transcript", 10), ("a", 2, 2.0, eventlog.DONE, 10)], [("a", 4, 4.0, "transcript", 5000), ("a", 3, 3.0, "transcript", 20), ("b", 5, 1.0, "transcript", 1)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run(ingest.growth_gate(spark.readStream.schema(schema).parquet(src)), out, state)
    got = {r.event_id: r.decision for r in spark.read.parquet(out).collect()}
    assert got == {1: "new", 3: "same", 4: "grown", 5: "new"}


def test_idle_sessions_equal_the_batch(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = [(u, t0 + timedelta(minutes=m)) for u in ("a", "b") for m in (0, 3, 9, 30, 31, 100)] + [("end", t0 + timedelta(days=30))]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(src)
    stream = ingest.idle_sessions(spark.readStream.schema("user string, ts timestamp").parquet(src), "user", "ts", late="1 hour")
    run(stream, out, state)
    batch = spark.createDataFrame(rows, "user string, ts timestamp").groupBy("user", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).where("user <> 'end'")
    assert {(r.user, r.started, r.n_events) for r in spark.read.parquet(out).collect()} == {(r.user, r.w.start, r.n) for r in batch.collect()}


def test_episode_table_takes_batches_once(spark, tmp_path):
    schema = "id string, project_id string, kind string, category string, title string, body string, confidence double, updated_at double, raw_payload string, entities array<string>, pinned boolean, access_count bigint"
    make = lambda *rows: spark.createDataFrame([(i, "p", "working", None, t, None, 0.5, u, None, [], False, 0) for i, t, u in rows], schema)
    t = ingest.EpisodeTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.merge(make(("1", "a", 1.0), ("1", "b", 2.0), ("2", "c", 1.0)), 0)
    t.merge(make(("1", "d", 3.0)), 1)
    t.merge(make(("1", "d", 3.0)), 1)  # the batch is repeated
    assert {(r.id, r.title) for r in t.read().collect()} == {("1", "d"), ("2", "c")}
    for n in (2, 3):
        t.merge(make((str(n + 1), "x", 1.0)), n)
    assert t.read().count() == 4 and all(len(v) <= 2 for v in t._versions().values())
    before = t._versions()
    t.merge(make(("1", "e", 9.0)), 4)
    changed = {b for b, v in t._versions().items() if v != before.get(b)}
    assert len(changed) == 1 and {(r.id, r.title) for r in t.read().collect()} == {("1", "e"), ("2", "c"), ("3", "x"), ("4", "x")}
    src = str(tmp_path / "s")
    make(("9", "s", 1.0)).write.parquet(src)
    other = ingest.EpisodeTable(spark, str(tmp_path / "o"))
    other.sink(spark.readStream.schema(schema).parquet(src), str(tmp_path / "c"), once=True).awaitTermination()
    assert [r.id for r in other.read().collect()] == ["9"]


def test_lines_and_commits(spark, tmp_path):
    (tmp_path / "j" / "deep").mkdir(parents=True)
    (tmp_path / "j" / "deep" / "a.jsonl").write_text('{"type":"user","content":"x"}\nbad\n')
    (tmp_path / "j" / "b.txt").write_text("no")
    run(ingest.read_lines(spark, str(tmp_path / "j")), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 2
    rows = [("p", "a" * 40, datetime(2026, 1, 1)), ("p", "a" * 12 + "b" * 28, datetime(2026, 1, 2)), ("q", "a" * 40, datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "project_id string, sha string, committed_at timestamp").coalesce(1).write.parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema("project_id string, sha string, committed_at timestamp").parquet(str(tmp_path / "g"))
    run(ingest.new_commits(stream), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2
