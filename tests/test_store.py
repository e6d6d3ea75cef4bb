"""Kept aggregates: batches that come twice, late samples, compaction, refresh of some runs, and a stream that is started again."""

from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from lumenspan.operators.rollup import cluster_summary
from lumenspan.plans.store import Store, readiness, repaired

TASK = "run_id string, query_id long, provider string, mode string"
SAMPLE = f"version string, sample_id long, {TASK}, score double, brand_present boolean, seen_at long"


def some(first, last, runs=3):
    return [("v3", i, f"r{i % runs}", i % 5, f"p{i % 2}", "GROUNDED" if i % 3 else "PARAMETRIC", i % 101 / 3, i % 4 == 0, i) for i in range(first, last)]


def held(store, version="v3"):
    return sorted(tuple(r) for r in store.tasks(version).collect())


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda rows: spark.createDataFrame(rows, SAMPLE)
    assert store.tasks("v3").count() == store.runs("v3").count() == store.scores("v3").count() == 0
    store.merge(frame(some(0, 200)), 0)
    # 60 samples that batch 0 has, with other scores, some of them twice in the batch, and another version of them
    again = [(*r[:6], 99.0, True, r[8]) for r in some(140, 200)]
    store.merge(frame(some(200, 300) + again + some(250, 260) + [("v4", *r[1:]) for r in again]), 1)
    whole = held(store)
    want = defaultdict(list)
    for r in some(0, 300):
        want[r[2:6]].append(r)
    exact = lambda xs: round(float(sum(Decimal(repr(x)).quantize(Decimal("1e-9")) for x in xs)) / len(xs), 9)
    assert [(r[:4], r[5]) for r in whole] == [(k, len(v)) for k, v in sorted(want.items())]
    assert all(abs(r[4] - exact([x[6] for x in want[r[:4]]])) < 1e-8 and r[7] == sum(x[7] for x in want[r[:4]]) for r in whole)
    assert store.tasks("v4").agg(F.sum("raw_n")).first()[0] == 60
    store.merge(frame(some(200, 300) + again + some(250, 260) + [("v4", *r[1:]) for r in again]), 1)
    store.merge(frame(some(0, 200)), 0)  # an earlier one, after a later one: it sees what it saw then
    assert held(store) == whole
    store.compact(0)
    assert held(store) == whole and store.compacted() == 0
    store.merge(frame(some(500, 600)), 0)  # folded already
    store.merge(frame(some(300, 320)), 2)
    store.compact(2)
    assert sum(r[5] for r in held(store)) == 320
    # of samples that come twice in a batch the first stays
    store.merge(frame([("v3", 900, "rx", 1, "p", "GROUNDED", s, False, at) for s, at in ((5.0, 3), (7.0, 1), (6.0, 2))]), 3)
    assert [r[4] for r in held(store) if r[0] == "rx"] == [7.0]


def test_refresh_replaces_the_runs_named_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    samples = spark.createDataFrame(some(0, 300), SAMPLE)
    store.merge(samples.where("sample_id < 250"), 0)
    store.refresh("v3")
    before = {(r.run_id, r.mode): r for r in store.runs("v3").collect()}
    plain = cluster_summary(samples.where("sample_id < 250"), ["run_id", "mode"]).collect()
    assert {(r.run_id, r.mode, r.n, r.raw_n, r["mean"], r.median, r.stability) for r in plain} == {(*k, r.n, r.raw_n, r["mean"], r.median, r.stability) for k, r in before.items()}
    store.merge(samples, 1)
    store.refresh("v3", spark.createDataFrame([("r1",), ("r1",)], "run_id string"))
    after = {(r.run_id, r.mode): r for r in store.runs("v3").collect()}
    assert after.keys() == before.keys() and all((after[k] == before[k]) == (k[0] != "r1") for k in before)
    done = samples.withColumn("status", F.lit("COMPLETED"))
    assert {r.run_id: r.ready for r in readiness(done, store, "v3").collect()} == {"r0": False, "r1": True, "r2": False}
    store.refresh("v3", spark.createDataFrame([("r2",)], "run_id string"), "pooled")
    assert {r.run_id: r.ready for r in readiness(done, store, "v3").collect()} == {"r0": False, "r1": True, "r2": False}  # covered, by an older method
    assert not any(r.ready for r in readiness(done, store, "v9").collect())
    one_more = done.unionByName(spark.createDataFrame([("v3", 999, "r1", 1, "p0", "GROUNDED", 1.0, True, 1, "COMPLETED")], done.schema))
    assert not any(r.ready for r in readiness(one_more, store, "v3").collect())


def test_a_stream_that_is_started_again(spark, tmp_path):
    store, files = Store(spark, str(tmp_path / "s")), tmp_path / "in"
    files.mkdir()
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(files))
    for k, (a, b) in enumerate(((0, 100), (80, 200), (150, 300))):
        spark.createDataFrame(some(a, b), SAMPLE).coalesce(1).write.parquet(str(files / str(k)))
        q = store.listen(stream, str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
    all_at_once = Store(spark, str(tmp_path / "once"))
    all_at_once.merge(spark.createDataFrame(some(0, 300), SAMPLE), 0)
    assert held(store) == held(all_at_once)


def test_counters_are_repaired_by_task(spark):
    rows = [("a", 1, "p", "G", s) for s in ("COMPLETED", "COMPLETED", "FAILED", "RUNNING")] + [("a", 2, "p", "G", "COMPLETED"), ("a", 3, "p", "G", "CANCELLED"), ("a", 4, "p", "G", "FAILED")]
    rows += [("b", 1, "p", "G", "RUNNING"), ("c", 1, "p", "G", "RUNNING")]
    samples = spark.createDataFrame(rows, f"{TASK}, status string")
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "run_id string")
    got = {(r.run_id, r.query_id): (r.done, r.failed, r.pending, r.status) for r in repaired(samples, names("a", "b"), names("b")).collect()}
    assert got == {("a", 1): (2, 1, 0, "CANCELLED"), ("a", 2): (1, 0, 0, "COMPLETED"), ("a", 3): (0, 0, 0, "CANCELLED"), ("a", 4): (0, 1, 0, "FAILED")}
