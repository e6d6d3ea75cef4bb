"""Planning, replay and the job queue, as queries over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.plans.buckets import CAPACITY, token_bucket_of
from lumenspan.queries import query
from lumenspan.sources.tables import OBS_SQL, PROVIDER_SQL, observations, providers, read

REPETITIONS = 3
#: Admission limits, retries in seconds, and the grace of an orphan.
LIMITS = {"samples": 1000, "per_day": 10000, "active_runs": 3, "queries": 1000}
RETRY_BASE, RETRY_CAP, ATTEMPTS, GRACE = 5, 600, 4, 90
JOB_STATUS = ["QUEUED", "RUNNING", "DONE", "DEAD"]


def planned(questions: DataFrame, engines: DataFrame, modes: list[str], repetitions: int) -> DataFrame:
    """query_id, provider, mode, sample_index: every supported cell of every question, repeated."""
    cells = supported(engines, modes).where("supported").select("provider", "mode")
    plan = questions.select("query_id").crossJoin(F.broadcast(cells))  # engines and modes are a handful
    return plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("sample_index"))


def supported(engines: DataFrame, modes: list[str]) -> DataFrame:
    each = engines.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return each.withColumn("supported", F.when(F.col("mode") == "PARAMETRIC", F.col("parametric")).otherwise(F.col("grounded")))


PLAN_SQL = f"""WITH {PROVIDER_SQL}, m(mode) AS (VALUES ('PARAMETRIC'), ('GROUNDED')), c AS (SELECT provider, mode, CASE WHEN mode = 'PARAMETRIC' THEN parametric ELSE grounded END AS supported FROM prov, m WHERE has_credential)"""


@query("plan_expand", PLAN_SQL + ", q AS (SELECT DISTINCT user_id AS query_id FROM events) SELECT query_id, provider, mode, sample_index FROM q, c, (VALUES (0), (1), (2)) r(sample_index) WHERE supported")
def plan_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines without credentials are left out."""
    questions = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id")).distinct()
    return planned(questions, providers(spark).where("has_credential"), ["PARAMETRIC", "GROUNDED"], REPETITIONS).orderBy("query_id", "provider", "mode", "sample_index")


@query("plan_skipped", PLAN_SQL + ", q AS (SELECT DISTINCT user_id AS query_id FROM events), r AS (SELECT provider, mode, 'unsupported-mode' AS reason FROM c WHERE NOT supported UNION ALL SELECT provider, mode, 'no-credential' FROM prov, m WHERE NOT has_credential) SELECT query_id, provider, mode, reason FROM q, r")
def plan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each question that a plan leaves out, and why."""
    all_cells = supported(providers(spark), ["PARAMETRIC", "GROUNDED"])
    reason = F.when(~F.col("has_credential"), "no-credential").when(~F.col("supported"), "unsupported-mode")
    skipped = all_cells.select("provider", "mode", reason.alias("reason")).where("reason IS NOT NULL")
    questions = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id")).distinct()
    return questions.crossJoin(F.broadcast(skipped))  # engines and modes are a handful


@query("plan_volume", PLAN_SQL + f", n AS (SELECT count(DISTINCT user_id) AS queries FROM events) SELECT queries, (SELECT count(*) FROM c WHERE supported) AS cells, queries * (SELECT count(*) FROM c WHERE supported) * 3 AS calls, queries * (SELECT count(*) FROM c WHERE supported) * 3 <= {LIMITS['samples']} AS admitted FROM n")
def plan_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a plan against the limit of an operation."""
    cells = supported(providers(spark).where("has_credential"), ["PARAMETRIC", "GROUNDED"]).agg(F.count_if("supported").alias("cells"))
    n = read(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("queries")).crossJoin(cells)
    calls = F.col("queries") * F.col("cells") * REPETITIONS
    return n.select("queries", "cells", calls.alias("calls"), (calls <= LIMITS["samples"]).alias("admitted"))


@query("daily_reservation", f"WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) * 3 AS samples, count(DISTINCT event_type) AS runs FROM events GROUP BY ALL) SELECT 'reserved-samples:' || user_id || ':' || day AS bucket, samples, samples <= {LIMITS['per_day']} AND runs <= {LIMITS['active_runs']} AS admitted FROM r")
def daily_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume reserved by user and UTC day against the limits."""
    day = F.date_format("ts", "yyyy-MM-dd")
    r = read(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg((F.count(F.lit(1)) * REPETITIONS).alias("samples"), F.count_distinct("event_type").alias("runs"))
    return r.select(F.concat_ws(":", F.lit("reserved-samples"), F.col("user_id").cast("string"), "day").alias("bucket"), "samples", ((F.col("samples") <= LIMITS["per_day"]) & (F.col("runs") <= LIMITS["active_runs"])).alias("admitted"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event: job_id, run_id, sample_id, provider, status, priority, attempts, available_at, lease_expires_at, dedupe_key, payload."""
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in JOB_STATUS]), (e % 4 + 1).cast("int"))
    payload = F.to_json(F.struct(F.when(e % 2 == 0, "v3").otherwise("v2").alias("targetScoringVersion")))
    return read(spark, sf_dir, "events").select(e.alias("job_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (e - e % 2).alias("sample_id"), F.col("event_type").alias("provider"), status.alias("status"), (e % 5).alias("priority"), (e % 6).alias("attempts"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("lease_expires_at"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("dedupe_key"), payload.alias("payload"))


JOB_SQL = f"""job AS (SELECT event_id AS job_id, strftime(ts, '%Y-%m-%d') AS run_id, event_id - event_id % 2 AS sample_id, event_type AS provider, list_extract({JOB_STATUS!r}, CAST(event_id % 4 + 1 AS INT)) AS status,
  event_id % 5 AS priority, event_id % 6 AS attempts, ts AS available_at, ts + INTERVAL 90 SECOND AS lease_expires_at, user_id || ':' || event_type AS dedupe_key, CASE WHEN event_id % 2 = 0 THEN 'v3' ELSE 'v2' END AS target FROM events)"""
NOW = "2024-01-20 00:00:00"


@query("dedupe_latest", f"WITH {JOB_SQL} SELECT dedupe_key, job_id, generation FROM (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY status NOT IN ('QUEUED', 'RUNNING'), available_at, job_id) AS generation FROM job)")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations of a key: active jobs first, then by age."""
    order = Window.partitionBy("dedupe_key").orderBy(~F.col("status").isin("QUEUED", "RUNNING"), "available_at", "job_id")
    return jobs(spark, sf_dir).select("dedupe_key", "job_id", F.row_number().over(order).cast("long").alias("generation"))


@query("claim_topk", f"WITH {JOB_SQL}, cancelled AS (SELECT DISTINCT run_id FROM job WHERE dayofmonth(CAST(run_id AS DATE)) % 7 = 0) SELECT job_id, priority FROM job WHERE status = 'QUEUED' AND available_at <= TIMESTAMP '{NOW}' AND run_id NOT IN (SELECT run_id FROM cancelled) ORDER BY priority DESC, available_at, job_id LIMIT 5")
def claim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five jobs that may be claimed: due, and not of a run that is being cancelled."""
    j = jobs(spark, sf_dir)
    cancelled = j.where(F.dayofmonth(F.to_date("run_id")) % 7 == 0).select("run_id").distinct()
    due = j.where((F.col("status") == "QUEUED") & (F.col("available_at") <= F.lit(NOW).cast(j.schema["available_at"].dataType))).join(cancelled, "run_id", "left_anti")
    return due.orderBy(F.desc("priority"), "available_at", "job_id").limit(5).select("job_id", "priority")


@query("orphan_samples", f"WITH {JOB_SQL}, s AS (SELECT DISTINCT event_id - event_id % 2 AS sample_id, min(ts) OVER (PARTITION BY event_id - event_id % 2) AS since FROM events) SELECT sample_id FROM s WHERE since < TIMESTAMP '{NOW}' - INTERVAL 90 SECOND AND NOT EXISTS (SELECT 1 FROM job WHERE job.sample_id = s.sample_id AND status IN ('QUEUED', 'RUNNING'))")
def orphan_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples older than the grace without an active job."""
    j = jobs(spark, sf_dir)
    since = j.groupBy("sample_id").agg(F.min("available_at").alias("since"))
    old = since.where(F.col("since") < F.lit(NOW).cast(j.schema["available_at"].dataType) - F.expr(f"INTERVAL {GRACE} SECONDS"))
    return old.join(j.where(F.col("status").isin("QUEUED", "RUNNING")).select("sample_id"), "sample_id", "left_anti").select("sample_id")


def backoff(attempt: Column) -> Column:
    """Seconds before another try, without jitter."""
    return F.least(F.lit(float(RETRY_CAP)), RETRY_BASE * F.pow(F.lit(2.0), attempt))


@query("lease_sweep", f"WITH {JOB_SQL} SELECT job_id, CASE WHEN attempts >= {ATTEMPTS} THEN 'DEAD' ELSE 'QUEUED' END AS status, CASE WHEN attempts >= {ATTEMPTS} THEN NULL ELSE least(600.0, 5 * pow(2.0, attempts)) END AS delay FROM job WHERE status = 'RUNNING' AND lease_expires_at < TIMESTAMP '{NOW}'")
def lease_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease is over: dead after the last attempt, otherwise queued again."""
    j = jobs(spark, sf_dir)
    over = j.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") < F.lit(NOW).cast(j.schema["available_at"].dataType)))
    dead = F.col("attempts") >= ATTEMPTS
    return over.select("job_id", F.when(dead, "DEAD").otherwise("QUEUED").alias("status"), F.when(~dead, backoff(F.col("attempts"))).alias("delay"))


@query("backoff_bounds", "SELECT attempts, least(600.0, 5 * pow(2.0, attempts)) * 0.5 AS least_s, least(600.0, 5 * pow(2.0, attempts)) * 1.5 AS most_s, count(*) AS jobs FROM (SELECT event_id % 6 AS attempts FROM events) GROUP BY attempts")
def backoff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attempts")
    return jobs(spark, sf_dir).groupBy("attempts").agg(F.count(F.lit(1)).alias("jobs")).select("attempts", (backoff(a) * 0.5).alias("least_s"), (backoff(a) * 1.5).alias("most_s"), "jobs")


@query("heartbeat_cancelled", f"WITH {JOB_SQL}, r AS (SELECT DISTINCT run_id, dayofmonth(CAST(run_id AS DATE)) % 7 = 0 AS cancelled FROM job WHERE dayofmonth(CAST(run_id AS DATE)) % 2 = 1) SELECT job_id, coalesce(cancelled, false) AS cancelled FROM job LEFT JOIN r USING (run_id) WHERE status = 'RUNNING'")
def heartbeat_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    day = F.dayofmonth(F.to_date("run_id"))
    runs = j.where(day % 2 == 1).select("run_id", (day % 7 == 0).alias("flag")).distinct()
    return j.where("status = 'RUNNING'").join(runs, "run_id", "left").select("job_id", F.coalesce("flag", F.lit(False)).alias("cancelled"))


@query("credential_cascade", f"WITH {JOB_SQL}, a AS (SELECT DISTINCT run_id, provider FROM job WHERE status = 'DEAD' AND job_id % 101 = 3) SELECT job_id, CASE WHEN a.run_id IS NOT NULL AND status = 'QUEUED' THEN 'DEAD' ELSE status END AS status FROM job LEFT JOIN a ON a.run_id = job.run_id AND a.provider = job.provider")
def credential_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refused credential fails every queued job of its run and engine."""
    j = jobs(spark, sf_dir)
    refused = j.where("status = 'DEAD' AND job_id % 101 = 3").select("run_id", "provider", F.lit(True).alias("refused")).distinct()
    return j.join(refused, ["run_id", "provider"], "left").select("job_id", F.when(F.col("refused") & (F.col("status") == "QUEUED"), "DEAD").otherwise(F.col("status")).alias("status"))


@query("replay_eligible", f"WITH {OBS_SQL}, have AS (SELECT sample_id FROM done WHERE sample_id % 5 = 0), r AS (SELECT run_id, bool_or(status IN ('PENDING', 'RUNNING')) AS open FROM obs GROUP BY run_id) SELECT done.sample_id FROM done JOIN r USING (run_id) WHERE sample_id % 13 <> 0 AND (NOT open OR dayofmonth(CAST(run_id AS DATE)) % 2 = 0) AND sample_id NOT IN (SELECT sample_id FROM have)")
def replay_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed, with a stored answer, of a run that has ended, and without a score under the target version."""
    obs = observations(spark, sf_dir)
    ended = obs.groupBy("run_id").agg(F.bool_or(F.col("status").isin("PENDING", "RUNNING")).alias("open")).where(~F.col("open") | (F.dayofmonth(F.to_date("run_id")) % 2 == 0))
    done = obs.where("status = 'COMPLETED'")
    return done.where("sample_id % 13 <> 0").join(ended, "run_id", "left_semi").join(done.where("sample_id % 5 = 0").select("sample_id"), "sample_id", "left_anti").select("sample_id")


@query("replay_state", f"WITH {JOB_SQL} SELECT run_id, count_if(target = 'v3' AND status IN ('QUEUED', 'RUNNING'))::BIGINT AS pending, count_if(target = 'v3' AND status = 'DEAD')::BIGINT AS blocked FROM job GROUP BY run_id")
def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    aimed = F.get_json_object("payload", "$.targetScoringVersion") == "v3"
    return jobs(spark, sf_dir).groupBy("run_id").agg(F.count_if(aimed & F.col("status").isin("QUEUED", "RUNNING")).alias("pending"), F.count_if(aimed & (F.col("status") == "DEAD")).alias("blocked"))


@query("cancelled_samples", f"WITH {OBS_SQL} SELECT run_id, CASE WHEN status = 'RUNNING' THEN 'CANCELLED' ELSE status END AS status, count(*) AS n FROM obs WHERE dayofmonth(CAST(run_id AS DATE)) % 10 = 0 GROUP BY 1, 2")
def cancelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cooperative cancel of every tenth day's run: what has not ended is cancelled, what has stays."""
    cancelling = observations(spark, sf_dir).where(F.dayofmonth(F.to_date("run_id")) % 10 == 0)
    return cancelling.groupBy("run_id", F.when(F.col("status") == "RUNNING", "CANCELLED").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("token_bucket")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls admitted for each user; a fold over time, held against a plain loop in the tests."""
    return token_bucket_of(read(spark, sf_dir, "events").select(F.col("user_id").alias("bucket"), F.col("event_id").alias("call_id"), "ts"))


@query("idle_buckets", f"WITH b AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id) SELECT user_id FROM b WHERE TIMESTAMP '2024-01-30 12:00:00' - last > INTERVAL 6 HOUR AND user_id % 10 <> 0 AND least(3.0, n % 3 + epoch(TIMESTAMP '2024-01-30 12:00:00' - last) / 20000.0) >= 3.0")
def idle_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets that are full again, idle for six hours, and not managed for an engine."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    b = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    idle = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    full = F.least(F.lit(CAPACITY), F.col("n") % 3 + idle / 20000.0) >= CAPACITY
    key = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("provider:"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    return b.where((idle > 6 * 3600) & full & ~key.startswith("provider:")).select("user_id")
