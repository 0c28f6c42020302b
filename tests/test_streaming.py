from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.streaming import events, health


def test_committed_once(spark, sf, tmp_path):
    src = tmp_path / "in"
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(3).write.parquet(str(src))
    run = lambda: events.write_committed(events.read(spark, str(src), source.schema, files_per_trigger=1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    run()
    from tickloom.plans.commit import read_committed

    assert read_committed(spark, str(tmp_path / "out")).count() == source.count()


def test_windows_on_a_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.read(spark, str(tmp_path / "in"), source.schema), "1 hour", "10 minutes")
    stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == source.count()
    unique = events.deduplicated(events.read(spark, str(tmp_path / "in"), source.schema), ["event_id"], "1 hour")
    events.write_append(unique, str(tmp_path / "u"), str(tmp_path / "ucp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "u")).count() == source.select("event_id").distinct().count()


def test_advancing_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "session int, position int, frame int"
    for k, rows in enumerate([[(1, 0, 5), (1, 1, 4)], [(1, 2, 5), (1, 3, 8)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        out = health.advancing(events.read(spark, str(src), spark.createDataFrame([], schema).schema))
        events.write_append(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.frame, r.advance) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(5, 1), (8, 3)]


def test_batch_rules(spark):
    at = datetime(2024, 1, 1)
    beats = spark.createDataFrame([("a", at), ("b", at - timedelta(seconds=100)), ("c", at - timedelta(seconds=300))], "node string, ts timestamp")
    assert {r.node: r.state for r in health.node_states(beats, "2024-01-01 00:00:10").collect()} == {"a": "alive", "b": "unknown", "c": "dead"}
    progress = spark.createDataFrame([(1, at, 700), (1, at + timedelta(seconds=50), 700), (2, at, 10), (3, at + timedelta(seconds=55), 900)], "job int, ts timestamp, frame int")
    assert [r.job for r in health.stalled(progress, "2024-01-01 00:01:00", 60, 600).collect()] == [1]
    failures = spark.createDataFrame([(1, at), (1, at), (2, at)], "job int, ts timestamp")
    got = {r.job: (r.next_attempt_at - at, r.given_up) for r in health.deferred(failures, 30, 2).collect()}
    assert got == {1: (timedelta(seconds=60), True), 2: (timedelta(seconds=30), False)}


def test_count_windows(spark):
    t = spark.createDataFrame([(1, k) for k in (0, 1, 2, 3, 3, 5)], "session int, tick int")
    assert [(r.step, r.ticks, r.missing, r.repeated) for r in events.count_windows(t).orderBy("step").collect()] == [(0, 3, 0, 0), (1, 2, 1, 1)]
