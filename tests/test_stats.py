from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenspan.functions.stats import XorShift128Plus, bootstrap, bootstrap_pooled, fnv1a_units, iqr, median, seed_for, stability_v3
from lumenspan.operators.rollup import cluster_summary, intervals, paired_delta_of, paired_interval, query_means, seeded_intervals


def numbers(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_type_7_quantiles(spark):
    q = lambda xs, p: numbers(spark, xs).agg(F.percentile("x", p)).first()[0]
    assert (q([1, 2, 3, 4], 0.25), q([1, 2, 3, 4], 0.75)) == (1.75, 3.25)
    assert [q([15, 20, 35, 40, 50], p) for p in (0.4, 0.0, 1.0)] == [pytest.approx(29), 15, 50]
    row = numbers(spark, [3, 100, 1, 4, 2]).agg(median("x"), F.avg("x"), iqr("x")).first()
    assert tuple(row) == (3, 22, 2)


def test_stability(spark):
    def of(xs):
        x = np.array(xs, float)
        mad, spread = np.median(abs(x - np.median(x))), np.subtract(*np.quantile(x, [0.75, 0.25]))
        return spark.range(1).select(stability_v3(F.lit(float(mad)), F.lit(float(spread)))).first()[0]

    assert of([80, 80, 80]) == of([70]) == 1
    assert of([100, 100, 0]) < 0.5


def panel(spark, copies=1):
    rows = [("q1", "p1", 0.0), ("q1", "p2", 40.0), ("q2", "p1", 100.0), ("q2", "p2", 100.0), ("q3", "p1", 0.0)] + [("q1", "p1", 0.0)] * 99
    return spark.createDataFrame([("r", *r, True) for r in rows] * copies, "run_id string, query_id string, provider string, score double, brand_present boolean")


def test_cluster_summary_weighs_queries_equally(spark):
    s = cluster_summary(panel(spark), ["run_id"]).first()
    assert (s.n, s.raw_n, s.cell_n, s.mean, s.median, s.low_n) == (3, 104, 5, 40, 20, True)
    again = cluster_summary(panel(spark, 20).repartition(7), ["run_id"]).first()
    assert again.raw_n == 2080 and again[2:3] + again[3:] != () and (again.mean, again.median, again.mad, again.stability) == (s.mean, s.median, s.mad, s.stability)
    assert sorted(r.value for r in query_means(panel(spark), ["run_id"]).collect()) == [0, 20, 100]


def test_intervals_depend_on_the_seed_alone(spark):
    one = seeded_intervals(panel(spark), ["run_id"], F.lit("s")).first()
    assert one == seeded_intervals(panel(spark).repartition(9).orderBy(F.rand(3)), ["run_id"], F.lit("s")).first()
    assert one.ci_low <= 20 <= one.ci_high
    single = seeded_intervals(panel(spark).where("query_id = 'q1'"), ["run_id"], F.lit("s")).first()
    assert single.n == 1 and single.ci_low is None


def test_generator_by_hand():
    """The recurrence once more, in exact arithmetic on two words."""
    g = XorShift128Plus("seed")
    a, b = g.a, g.b
    u = g.doubles(1)[0]
    assert u == ((a + b) % 2**64 >> 11) / 2**53
    x = (a ^ a << 23) % 2**64
    assert (g.a, g.b) == (b, x ^ b ^ x >> 18 ^ b >> 5)
    assert bootstrap([1.0], "s") is None and bootstrap_pooled([7.0], "s") == (7.0, 7.0)
    with pytest.raises(ValueError):
        bootstrap([1.0, 2.0], "s", alpha=1.5)
    with pytest.raises(ValueError):
        bootstrap_pooled([], "s")
    assert bootstrap([5.0, 5.0, 5.0], "s", "mean") == (5.0, 5.0)
    assert seed_for(["r", "GROUNDED", "v3"]) == __import__("hashlib").sha256(b"r|GROUNDED|v3").hexdigest()


def plain_doubles(seed, n):
    """The generator one number at a time."""
    w = [fnv1a_units(f"{seed}#{i}") for i in range(4)]
    a, b, full, out = w[0] << 32 | w[1], w[2] << 32 | w[3], (1 << 64) - 1, []
    for _ in range(16 + n):
        out.append(((a + b & full) >> 11) / 2**53)
        x = a ^ (a << 23 & full)
        a, b = b, x ^ b ^ (x >> 18) ^ (b >> 5)
    return out[16:]


@pytest.mark.parametrize("n", [1, 2, 5, 300, 4097, 40_001])
def test_lanes_give_the_same_sequence(n):
    g, want = XorShift128Plus("some seed"), plain_doubles("some seed", n + 3)
    assert g.doubles(n).tolist() + g.doubles(3).tolist() == want
    h = XorShift128Plus("some seed")
    h.skip(n)
    assert h.doubles(3).tolist() == want[n:]


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_intervals_against_plain_loops(spark, statistic):
    rng = np.random.default_rng(1)
    rows = [("r", f"q{i}", float(rng.integers(0, 100))) for i in range(37)] + [("one", "q", 5.0)]
    df = spark.createDataFrame(rows, "run_id string, query_id string, value double").repartition(5)
    got = {r.run_id: r for r in intervals(df, ["run_id"], F.lit("s"), statistic).collect()}
    v = [x for _, q, x in sorted(rows[:-1], key=lambda r: r[1])]
    u = plain_doubles("s", 2000 * 37)
    each = []
    for i in range(2000):
        drawn = sorted(v[int(x * 37)] for x in u[i * 37 : (i + 1) * 37])
        each.append(sum(drawn) / 37 if statistic == "mean" else drawn[18])
    each.sort()
    ends = [each[int(h)] + (h - int(h)) * (each[int(h) + 1] - each[int(h)]) for h in (1999 * 0.025, 1999 * 0.975)]
    assert [got["r"].ci_low, got["r"].ci_high] == pytest.approx(ends, rel=1e-12) and got["r"].n == 37
    assert got["one"].ci_low is None and got["one"].n == 1


def test_paired_interval_holds_its_centre(spark):
    for r in paired_interval(spark, "/root/testdata/sf0.001").collect():
        if r.paired_queries > 1:
            assert r.ci_low <= r["mean"] <= r.ci_high and r.err_low >= 0 and r.err_high >= 0
        else:
            assert r.ci_low is None and r.err_low is None


def test_paired_delta_counts_what_it_leaves_out(spark):
    rows = [("q1", "p1", "PARAMETRIC", 10), ("q1", "p1", "GROUNDED", 30), ("q2", "p1", "PARAMETRIC", 20), ("q2", "p1", "GROUNDED", 10), ("q3", "p1", "GROUNDED", 90), ("q4", "p2", "GROUNDED", 5), ("q5", "p2", "PARAMETRIC", 5), ("q6", "p1", "PARAMETRIC", 1), ("q7", "p1", "GROUNDED", 1)]
    obs = spark.createDataFrame([("r", *x[:3], float(x[3])) for x in rows], "run_id string, query_id string, provider string, mode string, score double")
    able = spark.createDataFrame([("p1", True, True), ("p2", False, True)], "provider string, parametric boolean, grounded boolean")
    d = paired_delta_of(obs, able, ["run_id"]).first()
    assert (d["mean"], d.paired_queries, d.raw_n, d.mode_only_cells, d.unsupported_cells, d.unsupported_providers, d.unknown_providers) == (5, 2, 9, 5, 2, 1, 0)
    assert (d.raw_parametric, d.raw_grounded, d.paired_parametric, d.paired_grounded) == (4, 5, 2, 2)
    alone = paired_delta_of(obs.where("query_id = 'q3'"), able, ["run_id"]).first()
    assert alone["mean"] is None and alone.paired_queries == 0


def test_token_bucket_against_a_loop(spark):
    from lumenspan.plans.jobs import token_bucket

    got = token_bucket(spark, "/root/testdata/sf0.001").toPandas().set_index("call_id")
    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet").sort_values(["ts", "event_id"])
    left: dict = {}
    for r in events.itertuples():
        t = r.ts.value / 1e9
        tokens, last = left.get(r.user_id, (3.0, t))
        tokens = min(3.0, tokens + (t - last) / 20000)
        assert bool(got.admitted[r.event_id]) == (tokens >= 1)
        left[r.user_id] = (tokens - (tokens >= 1), t)


def test_logins_against_a_loop(spark):
    from lumenspan.plans.throttle import LOGIN, admitted_logins, admitted_calls

    rng = np.random.default_rng(4)
    rows = [(i, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=float(t)), f"{rng.integers(6)}@x.org" if rng.random() < 0.8 else "y" * 200, None if rng.random() < 0.3 else f"10.0.0.{rng.integers(3)}") for i, t in enumerate(np.sort(rng.random(400) * 600))]
    got = {r.call_id: r.admitted for r in admitted_logins(spark.createDataFrame(rows, "call_id long, ts timestamp, email string, address string")).collect()}
    left = {}

    def take(key, n, t):
        tokens, last = left.get(key, (float(n), t))
        tokens = min(float(n), tokens + (t - last) * n / LOGIN["window"])
        left[key] = (tokens - (tokens >= 1), t)
        return tokens >= 1

    for i, ts, email, address in rows:
        t = ts.timestamp()
        assert got[i] == ((address is None or take("a" + address, LOGIN["address"], t)) and take("e" + email, LOGIN["account"], t))
    calls = spark.createDataFrame([(i, rows[i][1], k, 1) for i, k in enumerate(["rescores"] * 7 + ["runs"] * 3 + ["other"])], "call_id long, ts timestamp, kind string, who long")
    told = {r.call_id: (r.bucket, r.admitted) for r in admitted_calls(calls).collect()}
    assert [told[i][1] for i in range(11)] == [True] * 5 + [False] * 2 + [True] * 3 + [False] and told[0][0] == "rescores:1"


def test_pooled_intervals_are_those_of_the_samples(spark):
    from lumenspan.functions.stats import bootstrap_pooled, seed_for
    from lumenspan.operators.rollup import pooled_interval
    from lumenspan.sources.tables import completed

    sf, groups = "/root/testdata/sf0.001", {}
    for r in completed(spark, sf).collect():
        groups.setdefault((r.run_id, r["mode"], r.provider), []).append((str(r.sample_id).encode("utf-16-be"), r.score))
    got = {(r.run_id, r["mode"], r.engine): (r.n, r.ci_low, r.ci_high) for r in pooled_interval(spark, sf).collect()}
    assert got == {k: (len(v), *bootstrap_pooled([x for _, x in sorted(v)], seed_for([*k, "v2"]))) for k, v in groups.items()}
    assert 1 in {n for n, _, _ in got.values()}


def test_missing_buckets_fail_closed(spark):
    from lumenspan.plans.buckets import token_bucket_of

    calls = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 2, "2024-01-01")], "bucket long, call_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.bucket: (r.admitted, r.tokens) for r in token_bucket_of(calls, known=calls.where("bucket = 1")).collect()}
    assert got == {1: (True, 2.0), 2: (False, None)}


def test_excerpts_count_utf_16_units(spark):
    from lumenspan.operators.details import excerpt

    df = spark.createDataFrame([("abcd",), ("abcde",), ("abc😀",), ("ab😀x",), ("",)], "t string")
    head, more = excerpt(F.col("t"), 4)
    assert [tuple(r) for r in df.select(head, more).collect()] == [("abcd", False), ("abcd", True), ("abc", True), ("ab😀", True), ("", False)]
