"""The keyed state of the queue as Structured Streaming: token buckets, leases, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenspan.plans.buckets import CAPACITY, REFILL, Scale
from lumenspan.plans.jobs import ATTEMPTS
from lumenspan.queries import query
from lumenspan.sources.tables import read

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as files arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(path)


def admitted(calls: DataFrame, capacity: float = CAPACITY, refill_per_s: float = REFILL) -> DataFrame:
    """calls: bucket long, call_id long, ts timestamp, a stream. The balance of a bucket is kept between micro-batches; within one, calls
    take tokens in order of time. Calls that arrive after later ones see no refill."""

    scale = Scale(capacity, refill_per_s)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, last = state.get if state.exists else (scale.full, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        out = []
        for call, ns in zip(rows["call_id"], rows["ts"].astype("datetime64[ns]").astype("int64"), strict=True):
            us = ns // 1000
            balance = scale.grown(balance, us - last) if last is not None else balance
            last, ok = max(us, last or us), balance >= scale.token
            balance -= scale.token * ok
            out.append((key[0], call, ok, balance / scale.token))
        state.update((int(balance), int(last)))
        yield pd.DataFrame(out, columns=["bucket", "call_id", "admitted", "tokens"])

    ns = calls.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return ns.groupBy("bucket").applyInPandasWithState(fold, "bucket long, call_id long, admitted boolean, tokens double", "balance long, last long", "append", GroupStateTimeout.NoTimeout)


def expired_leases(beats: DataFrame, lease_s: int = 90) -> DataFrame:
    """beats: job_id long, attempts int, ts timestamp (event time). A job whose last beat is older than the lease when the watermark
    passes is put out once: dead after the last attempt, queued before."""

    def sweep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (attempts,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "DEAD" if attempts >= ATTEMPTS else "QUEUED", attempts)], columns=["job_id", "status", "attempts"])
            return
        rows = pd.concat(list(frames))
        state.update((int(rows["attempts"].max()),))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + lease_s * 1000)

    late = beats.withWatermark("ts", "0 seconds")
    return late.groupBy("job_id").applyInPandasWithState(sweep, "job_id long, status string, attempts int", "attempts int", "append", GroupStateTimeout.EventTimeTimeout)


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of users, batch or stream: events that are less than the gap apart."""
    out = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("began"), "n_events", F.round("value", 6).alias("value"))


@query("user_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS began, count(*) AS n_events, round(sum(value), 6) AS value FROM s GROUP BY user_id, session""")
def user_sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_sessions(read(spark, sf_dir, "events"))
