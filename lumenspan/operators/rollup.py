"""Scores rolled up with equal weight: repeats to cells, cells to queries, queries to an estimate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.selection import robust, robust_columns, type_7
from lumenspan.functions.stats import ALPHA, DRAWS, LOW_N_RUN, LOW_N_TASK, PAIRED, QUERY_CLUSTER, clamp, estimates, exact_mean, exact_mean_sql, iqr, median, seed_of, stability_v3
from lumenspan.functions.urls import in_locale
from lumenspan.queries import query
from lumenspan.sources.stage import written
from lumenspan.sources.tables import OBS_SQL, completed, observations, providers


def query_means(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query_id, value, raw_n, cell_n. The repeats of a cell are averaged first, then the cells of a query."""
    cells = obs.groupBy(*keys, "query_id", "provider").agg(exact_mean(F.col("score")).alias("cell"), F.count(F.lit(1)).alias("repeats"), F.sum(F.col("brand_present").cast("int")).alias("present"))
    return cells.groupBy(*keys, "query_id").agg(exact_mean(F.col("cell")).alias("value"), F.sum("repeats").alias("raw_n"), F.count(F.lit(1)).alias("cell_n"), F.sum("present").alias("present"))


def cluster_summary(obs: DataFrame, keys: list[str], low_n: int = LOW_N_RUN, hot: bool = False) -> DataFrame:
    """keys, n (queries), raw_n, cell_n, mean, median, mad, iqr, stability, presence (of samples), low_n."""
    return summarise(query_means(obs, keys), keys, low_n, hot)


def summarise(per_query: DataFrame, keys: list[str], low_n: int = LOW_N_RUN, hot: bool = False) -> DataFrame:
    """The same from query means: keys, query_id, value, raw_n, cell_n, present. hot: groups may have any number of queries; without it they are
    such as admission limits to a thousand, whose values fit a row."""
    ordered, spread = robust_columns("value")
    if hot:
        per_query = written(per_query, "query-means")
    columns = [F.count(F.lit(1)).alias("n"), F.sum("raw_n").alias("raw_n"), F.sum("cell_n").alias("cell_n"), exact_mean(F.col("value")).alias("mean"), F.sum("present").alias("present")]
    out = per_query.groupBy(*keys).agg(*columns, *([] if hot else [ordered]))
    out = out.join(robust(per_query, keys).drop("n"), keys) if hot else out.withColumn("spread", spread).select("*", "spread.*")
    out = out.withColumn("iqr", F.col("q3") - F.col("q1"))
    return out.select(*keys, "n", "raw_n", "cell_n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "mad", "iqr")], F.round(stability_v3(F.col("mad"), F.col("iqr")), 6).alias("stability"), F.round(F.col("present") / F.col("raw_n"), 6).alias("presence"), (F.col("n") < low_n).alias("low_n"))


def summary_sql(keys: str, low_n: int = LOW_N_RUN, source: str = "done", with_sql: str = OBS_SQL) -> str:
    return f"""WITH {with_sql}, cell AS (
  SELECT {keys}, query_id, provider AS cell_provider, {exact_mean_sql("score")} AS cell, count(*) AS repeats, sum(brand_present::INT) AS present
  FROM {source} GROUP BY {keys}, query_id, cell_provider), qm AS (
  SELECT {keys}, query_id, {exact_mean_sql("cell")} AS value, sum(repeats) AS raw_n, count(*) AS cell_n, sum(present) AS present FROM cell GROUP BY {keys}, query_id), s AS (
  SELECT {keys}, count(*)::BIGINT AS n, sum(raw_n)::BIGINT AS raw_n, sum(cell_n)::BIGINT AS cell_n, {exact_mean_sql("value")} AS mean, quantile_cont(value, 0.5) AS median,
         mad(value) AS mad, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, sum(present) AS present FROM qm GROUP BY {keys})
SELECT {keys}, n, raw_n, cell_n, round(mean, 6) AS mean, round(median, 6) AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr,
       round(least(1.0, greatest(0.0, 1 - greatest(1.4826 * mad, iqr / 1.349) / 25.0)), 6) AS stability,
       round(present / raw_n, 6) AS presence, n < {low_n} AS low_n FROM s"""


@query("provider_mode_score", summary_sql("provider, mode").replace("query_id, provider AS cell_provider", "query_id, 0 AS cell_provider"))
def provider_mode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_summary(completed(spark, sf_dir).withColumn("engine", F.col("provider")), ["engine", "mode"], hot=True).withColumnRenamed("engine", "provider")


@query("run_mode_score", summary_sql("run_id, mode"))
def run_mode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never pooled across modes."""
    return cluster_summary(completed(spark, sf_dir), ["run_id", "mode"])


TASK = ["run_id", "query_id", "provider", "mode"]


@query("task_score", f"""WITH {OBS_SQL}
SELECT run_id, query_id, provider, mode, 1::BIGINT AS n, count(*) AS raw_n, round({exact_mean_sql("score")}, 6) AS mean, round({exact_mean_sql("score")}, 6) AS median, 0.0::DOUBLE AS mad, 0.0::DOUBLE AS iqr,
       1.0::DOUBLE AS stability, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, true AS low_n, round(avg(brand_present::INT), 6) AS presence
FROM done GROUP BY ALL""")
def task_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task is a cluster of its own: its median is the mean of its repeats, without an interval."""
    out = completed(spark, sf_dir).groupBy(*TASK).agg(F.count(F.lit(1)).alias("raw_n"), F.round(exact_mean(F.col("score")), 6).alias("mean"), F.round(F.avg(F.col("brand_present").cast("int")), 6).alias("presence"))
    none = F.lit(None).cast("double")
    return out.select(*TASK, F.lit(1).cast("long").alias("n"), "raw_n", "mean", F.col("mean").alias("median"), F.lit(0.0).alias("mad"), F.lit(0.0).alias("iqr"), F.lit(1.0).alias("stability"), none.alias("ci_low"), none.alias("ci_high"), (F.lit(1) < LOW_N_TASK).alias("low_n"), "presence")


def counted(*wanted: str) -> Column:
    return F.count_if(F.col("status").isin(*wanted))


def tally(obs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, succeeded, failed, cancelled, pending."""
    return obs.groupBy(*keys).agg(counted("COMPLETED").alias("succeeded"), counted("FAILED").alias("failed"), counted("CANCELLED").alias("cancelled"), counted("PENDING", "RUNNING").alias("pending"))


TALLY_SQL = "count_if(status = 'COMPLETED')::BIGINT AS succeeded, count_if(status = 'FAILED')::BIGINT AS failed, count_if(status = 'CANCELLED')::BIGINT AS cancelled, count_if(status IN ('PENDING', 'RUNNING'))::BIGINT AS pending"


def final_status(missing: Column | int = 0) -> Column:
    """Null while calls are pending; calls that succeeded but lack a score count as failed."""
    failed, good = F.col("failed") + missing, F.col("succeeded") - missing
    return F.when(F.col("pending") > 0, F.lit(None)).when((good == 0) & (failed == 0) & (F.col("cancelled") > 0), "CANCELLED").when(good == 0, "FAILED").when((failed > 0) | (F.col("cancelled") > 0), "PARTIAL").otherwise("COMPLETED")


STATUS_SQL = "CASE WHEN pending > 0 THEN NULL WHEN succeeded - {m} = 0 AND failed + {m} = 0 AND cancelled > 0 THEN 'CANCELLED' WHEN succeeded - {m} = 0 THEN 'FAILED' WHEN failed + {m} > 0 OR cancelled > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status"


@query("status_tally", f"WITH {OBS_SQL} SELECT provider, mode, {TALLY_SQL} FROM obs GROUP BY provider, mode")
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(observations(spark, sf_dir), ["provider", "mode"])


@query("task_status", f"WITH {OBS_SQL}, t AS (SELECT run_id, query_id, provider, mode, {TALLY_SQL} FROM obs GROUP BY ALL) SELECT *, {STATUS_SQL.format(m='0')} FROM t")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(observations(spark, sf_dir), TASK).withColumn("status", final_status())


RUN_SQL = f"""WITH {OBS_SQL}, t AS (SELECT run_id, {TALLY_SQL}, count_if(status = 'COMPLETED' AND sample_id % 97 = 0)::BIGINT AS missing FROM obs GROUP BY run_id)
SELECT run_id, succeeded, failed, cancelled, pending, missing, CASE WHEN dayofmonth(CAST(run_id AS DATE)) % 10 = 0 THEN CASE WHEN pending > 0 THEN 'CANCELLING' ELSE 'CANCELLED' END ELSE """ + STATUS_SQL.format(m="missing").removesuffix(" AS status") + " END AS status FROM t"


@query("run_status", RUN_SQL)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cancelled run stays so; every tenth day stands for one. Every 97th call lacks its analysis."""
    obs = observations(spark, sf_dir)
    out = obs.groupBy("run_id").agg(counted("COMPLETED").alias("succeeded"), counted("FAILED").alias("failed"), counted("CANCELLED").alias("cancelled"), counted("PENDING", "RUNNING").alias("pending"), F.count_if((F.col("status") == "COMPLETED") & (F.col("sample_id") % 97 == 0)).alias("missing"))
    sticky = F.when(F.col("pending") > 0, "CANCELLING").otherwise("CANCELLED")
    return out.withColumn("status", F.when(F.dayofmonth(F.to_date("run_id")) % 10 == 0, sticky).otherwise(final_status(F.col("missing"))))


@query("coverage", f"""WITH {OBS_SQL} SELECT run_id, count(*) AS planned, count_if(status = 'COMPLETED')::BIGINT AS successful, count_if(status = 'COMPLETED' AND sample_id % 97 <> 0)::BIGINT AS scored,
greatest(0, count_if(status = 'COMPLETED') - count_if(status = 'COMPLETED' AND sample_id % 97 <> 0))::BIGINT AS missing FROM obs GROUP BY run_id""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("status") == "COMPLETED"
    out = observations(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("planned"), F.count_if(done).alias("successful"), F.count_if(done & (F.col("sample_id") % 97 != 0)).alias("scored"))
    return out.withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("successful") - F.col("scored")))


STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "SKIPPED"]


@query("run_status_vector", f"WITH {OBS_SQL} SELECT run_id, " + ", ".join(f"count_if(status = '{s}')::BIGINT AS n_{s.lower()}" for s in STATUSES) + " FROM obs GROUP BY run_id")
def run_status_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero-filled count of every status."""
    out = observations(spark, sf_dir).groupBy("run_id").pivot("status", STATUSES).count().fillna(0, STATUSES)
    return out.select("run_id", *[F.col(s).alias(f"n_{s.lower()}") for s in STATUSES])


def paired_cells(obs: DataFrame, capability: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each (query, provider): means and repeats of both modes by conditional aggregation, and whether they can be paired."""
    grounded, parametric = F.col("mode") == "GROUNDED", F.col("mode") == "PARAMETRIC"
    cells = obs.groupBy(*keys, "query_id", "provider").agg(exact_mean(F.when(grounded, F.col("score"))).alias("g"), exact_mean(F.when(parametric, F.col("score"))).alias("p"), F.count_if(grounded).alias("n_g"), F.count_if(parametric).alias("n_p"))
    cells = cells.join(F.broadcast(capability.select("provider", "parametric", "grounded")), "provider", "left")  # a handful of engines
    unknown = F.col("parametric").isNull()
    unsupported = ~unknown & ~(F.col("parametric") & F.col("grounded"))
    mode_only = (F.col("n_g") == 0) | (F.col("n_p") == 0)
    return cells.withColumns({"unknown": unknown, "unsupported": unsupported, "mode_only": mode_only, "paired": ~unsupported & ~mode_only})


def paired_delta_of(obs: DataFrame, capability: DataFrame, keys: list[str]) -> DataFrame:
    """Grounded minus parametric within cells, averaged over the providers of a query, then over queries."""
    cells = paired_cells(obs, capability, keys)
    per_query = cells.where("paired").groupBy(*keys, "query_id").agg(exact_mean(F.col("g") - F.col("p")).alias("delta"), F.count(F.lit(1)).alias("cells"))
    centre = per_query.groupBy(*keys).agg(exact_mean(F.col("delta")).alias("mean"), median("delta").alias("median"), F.count(F.lit(1)).alias("paired_queries"), F.sum("cells").alias("paired_cells"))
    support = cells.groupBy(*keys).agg(
        F.sum(F.col("n_g") + F.col("n_p")).alias("raw_n"), F.sum("n_g").alias("raw_grounded"), F.sum("n_p").alias("raw_parametric"),
        F.coalesce(F.sum(F.when(F.col("paired"), F.col("n_g"))), F.lit(0)).alias("paired_grounded"), F.coalesce(F.sum(F.when(F.col("paired"), F.col("n_p"))), F.lit(0)).alias("paired_parametric"),
        F.count_if("mode_only").alias("mode_only_cells"), F.count_if("unsupported").alias("unsupported_cells"), F.count_distinct(F.when(F.col("unsupported"), F.col("provider"))).alias("unsupported_providers"), F.count_distinct(F.when(F.col("unknown"), F.col("provider"))).alias("unknown_providers"),
    )
    return support.join(centre, keys, "left").select(*support.columns, F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.coalesce("paired_queries", F.lit(0)).alias("paired_queries"), F.coalesce("paired_cells", F.lit(0)).alias("paired_cells"))


#: Tasks that share the resamples of a group.
PARTS = 8


def intervals(per_query: DataFrame, keys: list[str], seed: Column, statistic: str = "median") -> DataFrame:
    """keys, seed, n, method, ci_low, ci_high from per_query (keys, query_id, value). A group's values - a number for each query - are
    one row; its resamples are dealt over PARTS tasks, each of which jumps to its part of the generator's sequence."""
    place = F.encode(F.col("query_id").cast("string"), "UTF-16BE")
    values = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "value"))), lambda x: x["value"])
    groups = per_query.groupBy(*keys).agg(values.alias("values")).withColumn("seed", seed)

    @F.pandas_udf("array<double>")
    def resampled(values: pd.Series, seed: pd.Series, part: pd.Series) -> pd.Series:
        share = DRAWS // PARTS
        return pd.Series([estimates(v, s, statistic, p * share, share) for v, s, p in zip(values, seed, part, strict=True)])

    parts = groups.where(F.size("values") > 1).select(*keys, "seed", "values", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    # numbered, as small rows with much work would otherwise be put together in one task
    width = int(per_query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = parts.repartition(width, *keys, "part").select(*keys, resampled("values", "seed", "part").alias("drawn"))
    ends = drawn.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("drawn"))).alias("drawn"))
    ends = ends.select(*keys, *[type_7(F.col("drawn"), q).alias(c) for c, q in (("ci_low", ALPHA / 2), ("ci_high", 1 - ALPHA / 2))])
    slim = groups.select(*keys, "seed", F.size("values").cast("long").alias("n"))
    return slim.join(ends, keys, "left").select(*keys, "seed", "n", F.lit(QUERY_CLUSTER).alias("method"), "ci_low", "ci_high")


def seeded_intervals(obs: DataFrame, keys: list[str], seed: Column, statistic: str = "median") -> DataFrame:
    """The same from observations: the query means of a group are resampled."""
    return intervals(query_means(obs, keys).select(*keys, "query_id", "value"), keys, seed, statistic)


def with_intervals(summary: DataFrame, found: DataFrame, keys: list[str], centre: str) -> DataFrame:
    """A summary with interval, seed and error bars: deviations from the centre to both ends, never negative, null without an interval."""
    out = summary.join(found.drop("n", "method"), keys, "left")
    bar = lambda x: F.when(F.col("ci_low").isNotNull(), F.greatest(F.lit(0.0), x))
    return out.withColumns({"err_low": bar(F.col(centre) - F.col("ci_low")), "err_high": bar(F.col("ci_high") - F.col(centre))})


@query("run_score_table")
def run_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run scores with their intervals; the summary's columns are run_mode_score's, the interval's are tested against plain loops."""
    keys = ["run_id", "mode"]
    found = seeded_intervals(completed(spark, sf_dir), keys, seed_of(F.col("run_id").cast("string"), F.col("mode"), F.lit("v3")))
    return with_intervals(run_mode_score(spark, sf_dir), found, keys, "median").withColumns({"method": F.lit(QUERY_CLUSTER), "n_unit": F.lit("queries")}).where("n > 0")


@query("provider_score_table")
def provider_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of engines and modes with their intervals, best first."""
    out = with_intervals(provider_mode_score(spark, sf_dir), provider_mode_ci(spark, sf_dir), ["provider", "mode"], "median")
    return out.orderBy(F.desc("median"), in_locale(F.col("provider")), "mode")


@query("paired_interval")
def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded minus parametric by run, with the interval of its mean over resampled queries."""
    obs, able = completed(spark, sf_dir), providers(spark)
    per_query = paired_cells(obs, able, ["run_id"]).where("paired").groupBy("run_id", "query_id").agg(exact_mean(F.col("g") - F.col("p")).alias("value"))
    found = intervals(per_query, ["run_id"], seed_of(F.col("run_id").cast("string"), F.lit("delta"), F.lit("v3")), "mean")
    return with_intervals(paired_delta_of(obs, able, ["run_id"]), found, ["run_id"], "mean").withColumn("method", F.lit(PAIRED))


INTERVAL = ["ci_low", "ci_high", "err_low", "err_high", "seed"]


def told(table: DataFrame) -> DataFrame:
    """A table of scores without its intervals, and whether there is one, in order, around the centre."""
    has = F.col("ci_low").isNotNull() & (F.col("ci_low") <= F.col("ci_high")) & (F.col("err_low") >= 0) & (F.col("err_high") >= 0)
    return table.withColumn("has_interval", has).drop(*INTERVAL)


@query("run_score_summary", f"SELECT *, n > 1 AS has_interval, '{QUERY_CLUSTER}' AS method, 'queries' AS n_unit FROM ({summary_sql('run_id, mode')})")
def run_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(run_score_table(spark, sf_dir))


@query("provider_score_summary", "SELECT *, n > 1 AS has_interval FROM (" + summary_sql("provider, mode").replace("query_id, provider AS cell_provider", "query_id, 0 AS cell_provider") + ")")
def provider_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(provider_score_table(spark, sf_dir))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of run scores; not in SQL, held against hand-computed vectors in the tests."""
    seed = seed_of(F.col("run_id").cast("string"), F.col("mode"), F.lit("v3"))
    return seeded_intervals(completed(spark, sf_dir), ["run_id", "mode"], seed)


@query("pooled_interval")
def pooled_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older intervals of runs, modes and engines over pooled samples: a single sample is its own interval."""
    keys = ["run_id", "mode", "engine"]
    samples = completed(spark, sf_dir).select("run_id", "mode", F.col("provider").alias("engine"), F.col("sample_id").alias("query_id"), F.col("score").alias("value"))
    found = intervals(samples, keys, seed_of(*keys, F.lit("v2")))
    alone = samples.groupBy(*keys).agg(F.min("value").alias("least"))
    own = lambda c: F.when(F.col("n") == 1, F.col("least")).otherwise(F.col(c)).alias(c)
    return found.join(alone, keys).select(*keys, "n", F.lit("pooled").alias("method"), own("ci_low"), own("ci_high"))


@query("provider_mode_ci")
def provider_mode_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = completed(spark, sf_dir).withColumn("engine", F.col("provider"))
    return seeded_intervals(obs, ["engine", "mode"], seed_of(F.lit("all"), F.col("engine"), F.col("mode"))).withColumnRenamed("engine", "provider")


@query("seed_hash", f"WITH {OBS_SQL} SELECT DISTINCT run_id, mode, sha256(concat_ws('|', CAST(run_id AS VARCHAR), mode, 'v3')) AS seed FROM obs")
def seed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("run_id", "mode").distinct().withColumn("seed", seed_of(F.col("run_id").cast("string"), F.col("mode"), F.lit("v3")))


@query("error_bars", f"""WITH s AS ({summary_sql("run_id, mode")}) SELECT run_id, mode, CASE WHEN n >= 2 THEN round(greatest(0.0, median - (median - iqr / 2)), 6) END AS err_low, CASE WHEN n >= 2 THEN round(greatest(0.0, (median + iqr / 2) - median), 6) END AS err_high FROM s""")
def error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations from the median to both ends of an interval (half the interquartile range here), never negative; null without an interval."""
    s = run_mode_score(spark, sf_dir)
    bar = lambda x: F.when(F.col("n") >= 2, F.round(F.greatest(F.lit(0.0), x), 6))
    low, high = F.col("median") - F.col("iqr") / 2, F.col("median") + F.col("iqr") / 2
    return s.select("run_id", "mode", bar(F.col("median") - low).alias("err_low"), bar(high - F.col("median")).alias("err_high"))


__all__ = ["clamp", "cluster_summary", "paired_delta_of", "seeded_intervals", "tally"]
