"""Choosing a run's engines, verdicts of a judge, and the refresh of aggregates after a change of method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.plans.jobs import JOB_SQL, NOW, jobs, replay_state
from lumenspan.plans.store import Store, readiness, repaired
from lumenspan.queries import query
from lumenspan.sources.stage import new_path, written
from lumenspan.sources.tables import OBS_SQL, RESPONSE_SQL, completed, observations, read, responses

MOCK = "mock"
#: What a judge may say, and how long a context may be.
SENTIMENTS = ["POSITIVE", "NEUTRAL", "NEGATIVE", "MIXED"]
MAX_CONTEXT = 400


def chosen_engines(engines: DataFrame, credentials: DataFrame) -> DataFrame:
    """(user_id, provider): active engines for which a user has a valid credential; the fixture engine, if active, only where there is no
    other, credential or not, as its answers are no evidence. engines: provider, active; credentials: user_id, provider, valid."""
    real = credentials.where("valid").join(engines.where("active"), "provider").where(F.col("provider") != MOCK).select("user_id", "provider").distinct()
    without = credentials.select("user_id").distinct().join(real, "user_id", "left_anti")
    mock = engines.where(F.col("active") & (F.col("provider") == MOCK)).select("provider")  # one row at most
    return real.unionByName(without.crossJoin(F.broadcast(mock)).select("user_id", "provider"))


@query("plan_engines", """WITH c AS (SELECT DISTINCT user_id, CASE WHEN event_id % 3 = 0 THEN 'mock' ELSE event_type END AS provider, user_id % 4 <> 0 AS valid FROM events),
real AS (SELECT DISTINCT user_id, provider FROM c WHERE valid AND provider <> 'mock' AND provider <> 'view')
SELECT * FROM real UNION ALL SELECT DISTINCT user_id, 'mock' FROM c WHERE user_id NOT IN (SELECT user_id FROM real)""")
def plan_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One engine is switched off; a quarter of the users have no valid credential and get the fixture."""
    e = read(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, MOCK).otherwise(F.col("event_type"))
    held = e.select("user_id", name.alias("provider"), (F.col("user_id") % 4 != 0).alias("valid")).distinct()
    engines = spark.createDataFrame([(p, p != "view") for p in ("click", "error", "purchase", "signup", "view", MOCK)], "provider string, active boolean")
    return chosen_engines(engines, held)


VERSION = "v3"
BATCHES = 4
DAY_SQL = "dayofmonth(CAST(run_id AS DATE))"
#: What the store below holds, said in SQL: which samples have come in, and which runs' scores are of the current method.
READY_SQL = f"""WITH {OBS_SQL}, stored AS (SELECT * FROM done WHERE NOT ({DAY_SQL} % 4 = 0 AND sample_id % 5 = 4 AND query_id % 50 = 0)),
tk AS (SELECT run_id, query_id, provider, mode, count(*) AS raw_n FROM stored GROUP BY ALL), rs AS (SELECT run_id, mode, sum(raw_n) AS raw_n FROM tk WHERE {DAY_SQL} % 7 <> 0 GROUP BY ALL),
raw AS (SELECT run_id, query_id, provider, mode, count(*) AS n FROM done GROUP BY ALL), tr AS (
  SELECT run_id, mode, bool_and(n = coalesce(tk.raw_n, -1)) AS ok, sum(n) AS n FROM raw LEFT JOIN tk USING (run_id, query_id, provider, mode) GROUP BY ALL),
ready AS (SELECT run_id, bool_and(ok AND tr.n = coalesce(rs.raw_n, -1)) AS ready FROM tr LEFT JOIN rs USING (run_id, mode) GROUP BY run_id)"""


def kept_aggregates(spark: SparkSession, sf_dir: str) -> Store:
    """A store as runs leave it: samples came in four batches, one of which was run twice; every fourth day lacks some late samples;
    every seventh day has run scores of an older method only."""
    store, day = Store(spark, new_path(spark, "aggregates")), F.dayofmonth(F.to_date("run_id"))
    late = (day % 4 == 0) & (F.col("sample_id") % 5 == 4) & (F.col("query_id") % 50 == 0)
    came = completed(spark, sf_dir).where(~late).withColumns({"version": F.lit(VERSION), "seen_at": F.col("ts")})
    for batch in (0, 1, 1, 2, 3):
        store.merge(came.where(F.col("sample_id") % BATCHES == batch), batch)
    store.compact(1)
    older = came.where(day % 7 == 0).select("run_id").distinct()
    store.refresh(VERSION)
    store.refresh(VERSION, older, "pooled")
    return store


@query("kept_task_scores", READY_SQL + " SELECT run_id, query_id, provider, mode, count(*) AS raw_n, round(sum(score::DECIMAL(18,9))::DOUBLE / count(*), 6) AS mean, round(avg(brand_present::INT), 6) AS presence FROM stored GROUP BY ALL")
def kept_task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task scores added up over the log of batches."""
    return kept_aggregates(spark, sf_dir).tasks(VERSION).select("run_id", "query_id", "provider", "mode", "raw_n", F.round("mean", 6).alias("mean"), F.round("presence", 6).alias("presence"))


@query("version_ready", READY_SQL + " SELECT run_id, ready, CASE WHEN ready THEN 'v3' ELSE 'v2' END AS read_version FROM ready")
def version_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is read under the active version once what is stored covers its samples, else under its own."""
    ready = readiness(observations(spark, sf_dir), kept_aggregates(spark, sf_dir), VERSION)
    return ready.withColumn("read_version", F.when(F.col("ready"), VERSION).otherwise("v2"))


@query("promotion", READY_SQL + f", {JOB_SQL}, open AS (SELECT count_if(target = 'v3' AND status IN ('QUEUED', 'RUNNING')) AS n FROM job) SELECT bool_and(ready) AS all_ready, (SELECT n FROM open)::BIGINT AS unfinished, bool_and(ready) AND (SELECT n FROM open) = 0 AS promote FROM ready")
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ready = version_ready(spark, sf_dir).agg(F.bool_and("ready").alias("all_ready"))
    out = all_ready.crossJoin(replay_state(spark, sf_dir).agg(F.sum("pending").alias("unfinished")))  # one row each
    return out.withColumn("promote", F.col("all_ready") & (F.col("unfinished") == 0))


@query("refreshed_runs", READY_SQL + ", late AS (SELECT DISTINCT run_id FROM ready WHERE NOT ready) SELECT run_id, mode, count(*)::BIGINT AS raw_n, 'query-cluster-v1' AS ci_method FROM done JOIN late USING (run_id) GROUP BY run_id, mode")
def refreshed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late samples come in, and the runs that weren't ready are computed anew; the others stay as they are."""
    store, samples = kept_aggregates(spark, sf_dir), completed(spark, sf_dir)
    late = written(readiness(samples, store, VERSION).where("NOT ready").select("run_id"), "late-runs")
    store.merge(samples.withColumns({"version": F.lit(VERSION), "seen_at": F.col("ts")}), BATCHES)
    store.refresh(VERSION, late)
    return store.runs(VERSION).join(late, "run_id", "left_semi").select("run_id", "mode", "raw_n", "ci_method")


CLOSING_SQL = f"""closing AS (SELECT DISTINCT run_id FROM obs WHERE {DAY_SQL} % 10 = 0 AND run_id NOT IN (SELECT run_id FROM job WHERE status = 'RUNNING' AND lease_expires_at >= TIMESTAMP '{NOW}'))"""


@query("counter_repair", f"WITH {OBS_SQL}, {JOB_SQL}, {CLOSING_SQL}" + """, c AS (SELECT run_id, query_id, provider, mode, count_if(status = 'COMPLETED')::BIGINT AS done, count_if(status = 'FAILED')::BIGINT AS failed,
  count_if(status IN ('PENDING', 'RUNNING')) AS open, count_if(status = 'CANCELLED') AS cancelled FROM obs JOIN closing USING (run_id) GROUP BY ALL)
SELECT run_id, query_id, provider, mode, done, failed, 0::BIGINT AS pending, CASE WHEN open > 0 OR (done = 0 AND failed = 0) THEN 'CANCELLED' WHEN done = 0 THEN 'FAILED' WHEN failed + cancelled > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status FROM c""")
def counter_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth day is being cancelled; it is closed once no lease of its jobs runs on."""
    samples, held = observations(spark, sf_dir), jobs(spark, sf_dir)
    running = held.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") >= F.lit(NOW).cast(held.schema["available_at"].dataType)))
    return repaired(samples, samples.where(F.dayofmonth(F.to_date("run_id")) % 10 == 0), running)


def refresh_decisions(runs: DataFrame, ready: DataFrame, replays: DataFrame, scheduled: DataFrame) -> DataFrame:
    """run_id, decision for each run that has ended and wasn't cancelled.

    runs: run_id, open, cancelled, successful, scored (under the target version); ready: run_id, ready (aggregates cover all successful
    samples); replays: run_id, pending, blocked; scheduled: run_id, status of its refresh job. In this order: a failed replay
    blocks, a pending one counts as scheduled, covered runs need nothing, runs without scores for all samples are incomplete, and a
    refresh that has ended without covering them is for an operator."""
    out = runs.where("NOT open AND NOT cancelled AND successful > 0").join(ready, "run_id", "left").join(replays, "run_id", "left").join(scheduled, "run_id", "left")
    decision = (
        F.when(F.coalesce("blocked", F.lit(0)) > 0, "blocked").when(F.coalesce("pending", F.lit(0)) > 0, "scheduled").when(F.coalesce("ready", F.lit(False)), "ready")
        .when(F.col("successful") != F.col("scored"), "incomplete").when(F.col("status").isin("QUEUED", "RUNNING"), "scheduled").when(F.col("status").isNotNull(), "stuck")
        .otherwise("enqueue")
    )
    return out.select("run_id", decision.alias("decision"))


@query("aggregate_refresh", READY_SQL + f""", {JOB_SQL}, rn AS (
  SELECT run_id, bool_or(status IN ('PENDING', 'RUNNING')) AND dayofmonth(CAST(run_id AS DATE)) % 3 = 0 AS open, dayofmonth(CAST(run_id AS DATE)) % 10 = 0 AS cancelled,
         count_if(status = 'COMPLETED') AS successful, count_if(status = 'COMPLETED' AND NOT (sample_id % 97 = 0 AND dayofmonth(CAST(run_id AS DATE)) % 5 = 1)) AS scored FROM obs GROUP BY run_id),
rp AS (SELECT run_id, count_if(target = 'v3' AND status IN ('QUEUED', 'RUNNING')) AS pending, count_if(target = 'v3' AND status = 'DEAD') AS blocked FROM job GROUP BY run_id),
sc AS (SELECT run_id, CASE WHEN dayofmonth(CAST(run_id AS DATE)) % 8 = 4 THEN 'DONE' ELSE 'QUEUED' END AS status FROM rn WHERE dayofmonth(CAST(run_id AS DATE)) % 8 IN (4, 0))
SELECT run_id, CASE WHEN coalesce(blocked, 0) > 0 THEN 'blocked' WHEN coalesce(pending, 0) > 0 THEN 'scheduled' WHEN coalesce(ready, false) THEN 'ready'
  WHEN successful <> scored THEN 'incomplete' WHEN sc.status = 'QUEUED' THEN 'scheduled' WHEN sc.status IS NOT NULL THEN 'stuck' ELSE 'enqueue' END AS decision
FROM rn LEFT JOIN ready USING (run_id) LEFT JOIN rp ON rp.run_id::VARCHAR = rn.run_id LEFT JOIN sc USING (run_id) WHERE NOT open AND NOT cancelled AND successful > 0""")
def aggregate_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done for each run so that its aggregates are of the current method."""
    day = F.dayofmonth(F.to_date("run_id"))
    done, lost = F.col("status") == "COMPLETED", (F.col("sample_id") % 97 == 0) & (day % 5 == 1)
    runs = observations(spark, sf_dir).groupBy("run_id").agg(
        F.bool_or(F.col("status").isin("PENDING", "RUNNING") & (day % 3 == 0)).alias("open"), F.bool_or(day % 10 == 0).alias("cancelled"),
        F.count_if(done).alias("successful"), F.count_if(done & ~lost).alias("scored"),
    )
    replays = replay_state(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("string"))
    scheduled = runs.where((day % 8).isin(4, 0)).select("run_id", F.when(day % 8 == 4, "DONE").otherwise("QUEUED").alias("status"))
    return refresh_decisions(runs, version_ready(spark, sf_dir).select("run_id", "ready"), replays, scheduled)


def valid_verdicts(replies: DataFrame) -> DataFrame:
    """Replies (cache_key, place, sentiment, score, confidence) that are verdicts: a known sentiment and finite numbers, the score between -1
    and 1, the confidence between 0 and 1, both clamped; of each key the one with the smallest place, of these the smallest."""
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: number(c).isNotNull() & ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))
    said = F.upper(F.trim("sentiment"))
    good = replies.where(said.isin(SENTIMENTS) & finite("score") & finite("confidence"))
    held = lambda c, lo: F.least(F.lit(1.0), F.greatest(F.lit(lo), number(c))).alias(c)
    good = good.select("cache_key", F.struct("place", said.alias("sentiment"), held("score", -1.0), held("confidence", 0.0)).alias("v"))
    return good.groupBy("cache_key").agg(F.min("v").alias("v")).select("cache_key", "v.sentiment", "v.score", "v.confidence")


def judged(items: DataFrame, cache: DataFrame, replies: DataFrame) -> DataFrame:
    """items (cache_key, ...) with the verdict of their context, from the cache or else from valid replies; those without one stay, without."""
    fresh = valid_verdicts(replies).join(cache.select("cache_key"), "cache_key", "left_anti")
    return items.join(cache.select("cache_key", "sentiment", "score", "confidence").unionByName(fresh), "cache_key", "left")


def context_key(entity: Column, context: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("v1"), entity, F.substring(F.btrim(F.regexp_replace(context, r"\s+", " ")), 1, MAX_CONTEXT)), 256)


@query("judge_merge", f"""WITH {RESPONSE_SQL}, it AS (SELECT sample_id, sha256('v1|e|' || substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, {MAX_CONTEXT})) AS cache_key FROM resp),
k AS (SELECT cache_key, min(sample_id) AS s FROM it GROUP BY cache_key), v AS (
  SELECT cache_key, CASE WHEN s % 3 = 0 THEN 'NEUTRAL' ELSE list_extract(['POSITIVE', 'NEGATIVE', 'MIXED', NULL], CAST(s % 4 + 1 AS INT)) END AS sentiment,
         CASE WHEN s % 3 = 0 THEN 0.0 ELSE least(1.0, greatest(-1.0, s % 7 - 3.0)) END AS score, CASE WHEN s % 3 = 0 THEN 0.5 ELSE least(1.0, s % 5 / 2.0) END AS confidence FROM k)
SELECT sample_id, sentiment, CASE WHEN sentiment IS NOT NULL THEN score END AS score, CASE WHEN sentiment IS NOT NULL THEN confidence END AS confidence FROM it JOIN v USING (cache_key)""")
def judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the contexts are in the cache; of the others some replies are out of range, some no verdict at all."""
    items = responses(spark, sf_dir).select("sample_id", context_key(F.lit("e"), F.col("text")).alias("cache_key"))
    s, keys = F.col("s"), items.groupBy("cache_key").agg(F.min("sample_id").alias("s"))
    cache = keys.where(s % 3 == 0).select("cache_key", F.lit("NEUTRAL").alias("sentiment"), F.lit(0.0).alias("score"), F.lit(0.5).alias("confidence"))
    word = F.element_at(F.array(*[F.lit(x) for x in (" positive", "Negative", "MIXED", "great")]), (s % 4 + 1).cast("int"))
    replies = keys.where(s % 3 != 0).select("cache_key", s.alias("place"), word.alias("sentiment"), (s % 7 - 3).cast("string").alias("score"), (s % 5 / 2).cast("string").alias("confidence"))
    return judged(items, cache, replies).select("sample_id", "sentiment", "score", "confidence")
