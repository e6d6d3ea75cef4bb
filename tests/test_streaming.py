from lumenspan.plans.jobs import token_bucket
from lumenspan.streaming.queue import admitted, event_stream, expired_leases, user_sessions


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_stream_admits_what_the_batch_admits(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    calls = event_stream(spark, str(tmp_path / "e")).selectExpr("user_id AS bucket", "event_id AS call_id", "ts")
    got = {r.call_id: r.admitted for r in drained(admitted(calls), "admitted").collect()}
    assert got == {r.call_id: r.admitted for r in token_bucket(spark, "/root/testdata/sf0.001").collect()}


def test_leases_end_when_the_watermark_passes(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 5, "2024-01-01 00:00:10"), (3, 0, "2024-01-01 01:00:00")]
    beats = spark.createDataFrame(rows, "job_id long, attempts int, at string").selectExpr("job_id", "attempts", "CAST(at AS TIMESTAMP) AS ts")
    for k, day in enumerate(("first", "second")):
        beats.where(f"job_id {'<' if k == 0 else '='} 3").coalesce(1).write.parquet(str(tmp_path / "b" / day))
    stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "b"))
    got = {r.job_id: r.status for r in drained(expired_leases(stream), "leases").collect()}
    assert got == {1: "QUEUED", 2: "DEAD"}


def test_sessions_in_batch(spark):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 05:59:00", 2.0), (1, "2024-01-01 12:00:00", 3.0)]
    events = spark.createDataFrame(rows, "user_id long, at string, value double").selectExpr("user_id", "CAST(at AS TIMESTAMP) AS ts", "value")
    assert sorted((r.n_events, r.value) for r in user_sessions(events).collect()) == [(1, 3.0), (2, 3.0)]
