"""Sliced token buckets against a loop over all calls."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenspan.plans import buckets
from lumenspan.plans.buckets import Scale, token_bucket_of
from lumenspan.plans.throttle import PER_HOUR, REGISTER_ALL, registration_admission


def loop(rows, capacity, refill, scale=None):
    scale, state, out = scale or Scale(capacity, refill), {}, {}
    for bucket, call, us in sorted(rows, key=lambda r: (r[2], r[1])):
        balance, last = state.get(bucket, (scale.full, us))
        balance = scale.grown(balance, us - last)
        taken = balance >= scale.token
        state[bucket] = (balance - scale.token * taken, us)
        out[call] = (taken, state[bucket][0] / scale.token)
    return out


def test_pieces_say_what_becomes_of_every_balance():
    rng = random.Random(1)
    for _ in range(400):
        scale = Scale(rng.choice([1, 2, 3, 5, 2.5]), rng.choice([1.0, 0.5, 3.0]) * 1e6 / rng.choice([3, 7, 10]))
        gaps = [0] + [rng.choice([0, 1, 2, rng.randrange(30)]) for _ in range(rng.randrange(1, 40))]
        pieces = [(0, scale.full, True, 0)]
        for g in gaps:
            pieces = scale.called(pieces, g)
            assert pieces[0][0] == 0 and pieces[-1][1] == scale.full and all(a[1] + 1 == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        for start in range(scale.full + 1):
            balance = start
            for g in gaps:
                balance = scale.grown(balance, g)
                balance -= scale.token * (balance >= scale.token)
            assert scale.after(pieces, start) == balance


@pytest.mark.parametrize("pace", [0.3, 1.0, 4.0])
def test_a_hot_bucket_equals_the_loop(spark, pace):
    """A bucket with nine tenths of the calls over some hundred slices, calls at one time, idle stretches, and buckets of few calls."""
    rng, us, rows = random.Random(int(pace * 10)), 0, []
    for call in range(12_000):
        us += rng.choice([0, 1, int(rng.expovariate(1) * 1e6 / pace)]) if rng.random() > 0.001 else 20_000_000
        rows.append((1 if rng.random() < 0.9 else rng.randrange(2, 40), call, us))
    frame = spark.createDataFrame(rows, "bucket long, call_id long, us long").select("bucket", "call_id", F.timestamp_micros("us").alias("ts")).repartition(5)
    got = {r.call_id: (r.admitted, r.tokens) for r in token_bucket_of(frame, 3.0, 1.0, slice_calls=100).collect()}
    assert got == loop(rows, 3.0, 1.0)
    shaped = frame.select("bucket", "call_id", F.unix_micros("ts").alias("ts"))
    cut = buckets._cut(shaped, 100).where("slice IS NOT NULL").groupBy("bucket", "slice").count().collect()
    assert {r.bucket for r in cut} >= {1} and max(r["count"] for r in cut) < 600 and len(cut) > 50
    assert token_bucket_of(frame.where("false")).count() == 0


def test_registrations_against_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.call_id: (r.admitted, r.refused_by) for r in registration_admission(spark, sf).collect()}
    calls = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    every, own, state = Scale(REGISTER_ALL, REGISTER_ALL / 3600), Scale(PER_HOUR["register"], PER_HOUR["register"] / 3600), defaultdict(lambda: None)

    def take(key, scale, us):
        balance, last = state[key] or (scale.full, us)
        balance = scale.grown(balance, us - last)
        taken = balance >= scale.token
        state[key] = (balance - scale.token * taken, us)
        return taken

    want = {}
    for call, us, user in sorted((r.event_id, r.us // 100, r.user_id) for r in calls):
        want[call] = (us, user)
    out = {}
    for call, (us, user) in sorted(want.items(), key=lambda x: (x[1][0], x[0])):
        refused = None if take("all", every, us) else "global"
        if refused is None and user % 9 and not take(user % 4, own, us):
            refused = "address"
        out[call] = (refused is None, refused)
    assert got == out and len(set(out.values())) == 3
