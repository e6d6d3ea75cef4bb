"""What a dashboard reads: paired differences, findings, buckets, matrices, pages and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.stats import exact_mean_sql
from lumenspan.operators.rollup import STATUS_SQL, TALLY_SQL, TASK, final_status, paired_delta_of, run_mode_score, summary_sql, tally
from lumenspan.queries import query
from lumenspan.sources.stage import new_path
from lumenspan.sources.tables import OBS_SQL, PROVIDER_SQL, completed, observations, providers, read

PAIR_SQL = f"""WITH {OBS_SQL}, {PROVIDER_SQL}, cell AS (
  SELECT run_id, query_id, done.provider, {exact_mean_sql("score", "FILTER (mode = 'GROUNDED')")} AS g, {exact_mean_sql("score", "FILTER (mode = 'PARAMETRIC')")} AS p,
         count_if(mode = 'GROUNDED') AS n_g, count_if(mode = 'PARAMETRIC') AS n_p, any_value(parametric) AS parametric, any_value(grounded) AS grounded
  FROM done LEFT JOIN prov ON prov.provider = done.provider AND done.provider <> 'view' GROUP BY ALL), c AS (
  SELECT *, parametric IS NULL AS unknown, parametric IS NOT NULL AND NOT (parametric AND grounded) AS unsupported, n_g = 0 OR n_p = 0 AS mode_only FROM cell), q AS (
  SELECT run_id, query_id, {exact_mean_sql('g - p')} AS delta, count(*) AS cells FROM c WHERE NOT unsupported AND NOT mode_only GROUP BY ALL), e AS (
  SELECT run_id, {exact_mean_sql('delta')} AS mean, quantile_cont(delta, 0.5) AS median, count(*) AS paired_queries, sum(cells) AS paired_cells FROM q GROUP BY ALL), s AS (
  SELECT run_id, sum(n_g + n_p)::BIGINT AS raw_n, sum(n_g)::BIGINT AS raw_grounded, sum(n_p)::BIGINT AS raw_parametric,
         coalesce(sum(n_g) FILTER (NOT unsupported AND NOT mode_only), 0)::BIGINT AS paired_grounded, coalesce(sum(n_p) FILTER (NOT unsupported AND NOT mode_only), 0)::BIGINT AS paired_parametric,
         count_if(mode_only)::BIGINT AS mode_only_cells, count_if(unsupported)::BIGINT AS unsupported_cells,
         count(DISTINCT provider) FILTER (unsupported) AS unsupported_providers, count(DISTINCT provider) FILTER (unknown) AS unknown_providers FROM c GROUP BY ALL)
SELECT s.*, round(mean, 6) AS mean, round(median, 6) AS median, coalesce(paired_queries, 0)::BIGINT AS paired_queries, coalesce(paired_cells, 0)::BIGINT AS paired_cells FROM s LEFT JOIN e USING (run_id)"""


@query("paired_delta", PAIR_SQL)
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capability of one engine is left unknown on purpose: its observed pairs count, and it is reported."""
    return paired_delta_of(completed(spark, sf_dir), providers(spark).where("provider <> 'view'"), ["run_id"])


GAP = 5.0
KINDS = ["broad-invisibility", "grounded-erosion", "grounded-recovery"]


def cell_scores(obs: DataFrame) -> DataFrame:
    """query_id, provider, mode, n, median, presence, low_n: the cells of the query matrix."""
    out = obs.groupBy("query_id", "provider", "mode").agg(F.count(F.lit(1)).alias("n"), F.percentile("score", 0.5).alias("median"), F.avg(F.col("brand_present").cast("int")).alias("presence"))
    return out.withColumn("low_n", F.col("n") < 5)


def findings(cells: DataFrame, limit: int | None = 4) -> DataFrame:
    """Cells of both modes paired by (query, provider) in one pass; kind, magnitude and order of what stands out."""
    first = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    measured = (F.col("n") > 0) & F.col("median").isNotNull() & ~F.isnan("median")
    pair = cells.where(measured).groupBy("query_id", "provider").agg(*[first(m, c).alias(f"{m[0].lower()}_{c}") for m in ("GROUNDED", "PARAMETRIC") for c in ("median", "presence", "low_n")])
    pair = pair.where("g_median IS NOT NULL AND p_median IS NOT NULL").withColumn("gap", F.col("g_median") - F.col("p_median"))
    unseen = (F.col("g_presence") == 0) & (F.col("p_presence") == 0)
    kind = F.when(unseen, KINDS[0]).when(F.col("gap") <= -GAP, KINDS[1]).when(F.col("gap") >= GAP, KINDS[2])
    size = F.when(unseen, F.greatest(F.lit(0.0), 100 - F.greatest("g_median", "p_median"))).otherwise(F.abs("gap"))
    out = pair.withColumns({"kind": kind, "magnitude": F.round(size, 6)}).where("kind IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    out = out.select("query_id", "provider", "kind", F.round("gap", 6).alias("gap"), "magnitude", (F.col("g_low_n") | F.col("p_low_n")).alias("low_n"), order.alias("rank"))
    if limit is not None:
        out = out.orderBy("rank", F.desc("magnitude"), F.col("query_id").cast("string"), "provider").limit(max(0, limit))
    return out


FIND_SQL = f"""WITH {OBS_SQL}, cell AS (SELECT query_id, provider, mode, count(*) AS n, quantile_cont(score, 0.5) AS median, avg(brand_present::INT) AS presence, count(*) < 5 AS low_n FROM done GROUP BY ALL), pair AS (
  SELECT g.query_id, g.provider, g.median AS gm, p.median AS pm, g.presence AS gp, p.presence AS pp, g.low_n OR p.low_n AS low_n, g.median - p.median AS gap
  FROM cell g JOIN cell p ON g.query_id = p.query_id AND g.provider = p.provider AND g.mode = 'GROUNDED' AND p.mode = 'PARAMETRIC'), f AS (
  SELECT *, CASE WHEN gp = 0 AND pp = 0 THEN 1 WHEN gap <= -5 THEN 2 WHEN gap >= 5 THEN 3 END AS rank, round(CASE WHEN gp = 0 AND pp = 0 THEN greatest(0.0, 100 - greatest(gm, pm)) ELSE abs(gap) END, 6) AS magnitude FROM pair)
SELECT query_id, provider, list_extract({KINDS!r}, rank) AS kind, round(gap, 6) AS gap, magnitude, low_n, rank::BIGINT AS rank FROM f WHERE rank IS NOT NULL"""


@query("signal_findings", FIND_SQL)
def signal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(cell_scores(completed(spark, sf_dir)), None)


@query("signal_top", FIND_SQL + " ORDER BY rank, magnitude DESC, CAST(query_id AS VARCHAR), provider LIMIT 4")
def signal_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four findings that the dashboard leads with."""
    return findings(cell_scores(completed(spark, sf_dir)))


def presence_bucket(rate: Column) -> Column:
    return F.when(rate >= 0.6, "strong").when(rate > 0, "partial").otherwise("absent")


@query("presence_buckets", f"""WITH {OBS_SQL}, q AS (SELECT run_id, query_id, avg(brand_present::INT) AS rate FROM done GROUP BY ALL)
SELECT run_id, count(*) AS n_all, count_if(rate >= 0.6)::BIGINT AS n_strong, count_if(rate > 0 AND rate < 0.6)::BIGINT AS n_partial, count_if(rate <= 0)::BIGINT AS n_absent FROM q GROUP BY run_id""")
def presence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = completed(spark, sf_dir).groupBy("run_id", "query_id").agg(F.avg(F.col("brand_present").cast("int")).alias("rate"))
    bucket = presence_bucket(F.col("rate"))
    return rate.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(bucket == b).alias(f"n_{b}") for b in ("strong", "partial", "absent")])


@query("stability_tone", f"""WITH s AS ({summary_sql("run_id, mode")}) SELECT run_id, mode, stability, CASE WHEN low_n OR stability IS NULL THEN 'indicative' WHEN stability >= 0.75 THEN 'stable' WHEN stability >= 0.5 THEN 'moderate' ELSE 'volatile' END AS tone,
CASE WHEN low_n THEN '≈' ELSE '' END || CAST(CAST(round(presence * 100) AS BIGINT) AS VARCHAR) || ' %' AS presence_label FROM s""")
def stability_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run_mode_score(spark, sf_dir)
    tone = F.when(F.col("low_n") | F.col("stability").isNull(), "indicative").when(F.col("stability") >= 0.75, "stable").when(F.col("stability") >= 0.5, "moderate").otherwise("volatile")
    label = F.concat(F.when(F.col("low_n"), "≈").otherwise(""), F.round(F.col("presence") * 100).cast("long").cast("string"), F.lit(" %"))
    return s.select("run_id", "mode", "stability", tone.alias("tone"), label.alias("presence_label"))


def mode_rank() -> Column:
    """The order of the plan, not of the alphabet."""
    return F.when(F.col("mode") == "PARAMETRIC", 0).otherwise(1)


@query("runs_recent_tasks", f"""WITH {OBS_SQL}, t AS (SELECT run_id, query_id, provider, mode, {TALLY_SQL} FROM obs GROUP BY ALL), r AS (SELECT DISTINCT run_id FROM t ORDER BY run_id DESC LIMIT 20)
SELECT run_id, query_id, provider, mode, {STATUS_SQL.format(m='0')}, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY query_id, provider, mode = 'GROUNDED') AS place FROM t JOIN r USING (run_id)) WHERE place <= 25""")
def runs_recent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest runs with the first 25 of their tasks in plan order."""
    tasks = tally(observations(spark, sf_dir), TASK)
    recent = tasks.select("run_id").distinct().orderBy(F.desc("run_id")).limit(20)
    plan = Window.partitionBy("run_id").orderBy("query_id", "provider", mode_rank())
    out = tasks.join(F.broadcast(recent), "run_id").withColumn("place", F.row_number().over(plan).cast("long")).where("place <= 25")  # 20 rows
    return out.select(*TASK, final_status().alias("status"), "place")


PAGE = 25


def in_pages(rows: DataFrame, by: str, order: list[Column], size: int = PAGE) -> DataFrame:
    """rows with place and page, by their rank among those of their `by`."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("place", rank).withColumn("page", F.floor(rank / size).cast("int"))


def written_pages(rows: DataFrame, by: str, order: list[Column], path: str, size: int = PAGE) -> None:
    """Rows in blocks of a page each: a page is read from its own folder alone. Folders are made and listed by the driver, one for each page, so
    this is for few pages."""
    in_pages(rows, by, order, size).write.partitionBy(by, "page").parquet(path)


#: Bytes of a block of pages: what is read for one of them, at most.
BLOCK_BYTES = 1 << 20


def written_blocks(rows: DataFrame, by: str, order: list[Column], path: str, size: int = PAGE) -> None:
    """Any number of pages, one after the other in files: as many files as tasks, whatever the number of pages. Blocks know the pages that they hold
    from the first to the last, so that a page is read from its own block."""
    paged = in_pages(rows, by, order, size).sortWithinPartitions(by, "place")
    paged.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)


def page_of(spark: SparkSession, path: str, schema, by: str, which: str, page: int) -> DataFrame:
    """The rows of a page, in order; filters on folders or blocks, so nothing else is sorted."""
    return spark.read.schema(schema).parquet(path).where((F.col(by) == which) & (F.col("page") == page)).orderBy("place")


@query("task_page", f"WITH {OBS_SQL}, t AS (SELECT run_id, query_id, provider, mode, count(*) AS calls FROM obs GROUP BY ALL), p AS (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY query_id, provider, mode = 'GROUNDED') - 1) // {PAGE} AS page FROM t) SELECT run_id, query_id, provider, mode, calls FROM p WHERE page = 1 AND run_id = '2024-01-05'")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a run's tasks, out of the written blocks of all runs' pages."""
    tasks = observations(spark, sf_dir).groupBy(*TASK).agg(F.count(F.lit(1)).alias("calls"))
    path = new_path(spark, "task-pages")
    written_blocks(tasks, "run_id", [F.col("query_id"), F.col("provider"), mode_rank()], path)
    schema = "query_id long, provider string, mode string, calls long, place int, run_id string, page int"
    return page_of(spark, path, schema, "run_id", "2024-01-05", 1).select(*TASK, "calls")


@query("provider_chart_pivot", f"WITH {OBS_SQL} SELECT provider, round(quantile_cont(score, 0.5) FILTER (mode = 'GROUNDED'), 6) AS grounded_median, round(quantile_cont(score, 0.5) FILTER (mode = 'PARAMETRIC'), 6) AS parametric_median, count_if(mode = 'GROUNDED')::BIGINT AS grounded_n, count_if(mode = 'PARAMETRIC')::BIGINT AS parametric_n FROM done GROUP BY provider")
def provider_chart_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = completed(spark, sf_dir).groupBy("provider").pivot("mode", ["GROUNDED", "PARAMETRIC"]).agg(F.round(F.percentile("score", 0.5), 6).alias("median"), F.count(F.lit(1)).alias("n"))
    return wide.select("provider", *[F.col(f"{m}_{c}").alias(f"{m.lower()}_{c}") for c in ("median", "n") for m in ("GROUNDED", "PARAMETRIC")])


@query("query_matrix", f"""WITH {OBS_SQL}, t AS (SELECT query_id, provider, mode, count(*) AS planned, count_if(status = 'COMPLETED') AS raw_n, count_if(status = 'COMPLETED' AND brand_present) AS present FROM obs GROUP BY ALL)
SELECT query_id, count(*) AS n_cells, count_if(raw_n > 0)::BIGINT AS scored_cells, round(CASE WHEN sum(raw_n) > 0 THEN sum(present) / sum(raw_n) ELSE 0 END, 6) AS presence,
string_agg(provider || '/' || mode || ':' || raw_n, ' ' ORDER BY provider || '/' || mode || ':' || raw_n) AS cells FROM t GROUP BY query_id""")
def query_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each query with its cells, scored or not; presence is weighted by raw calls."""
    done = F.col("status") == "COMPLETED"
    cells = observations(spark, sf_dir).groupBy("query_id", "provider", "mode").agg(F.count_if(done).alias("raw_n"), F.count_if(done & F.col("brand_present")).alias("present"))
    label = F.concat(F.col("provider"), F.lit("/"), F.col("mode"), F.lit(":"), F.col("raw_n").cast("string"))
    out = cells.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("raw_n") > 0).alias("scored_cells"), F.sum("present").alias("present"), F.sum("raw_n").alias("raw_n"), F.array_join(F.array_sort(F.collect_list(label)), " ").alias("cells"))
    return out.select("query_id", "n_cells", "scored_cells", F.round(F.when(F.col("raw_n") > 0, F.col("present") / F.col("raw_n")).otherwise(F.lit(0.0)), 6).alias("presence"), "cells")


@query("heatmap_columns", f"WITH {OBS_SQL} SELECT provider, mode, row_number() OVER (ORDER BY provider, mode <> 'GROUNDED') AS place FROM (SELECT DISTINCT provider, mode FROM obs)")
def heatmap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct columns, by label and grounded first; as many as there are engines and modes."""
    order = Window.orderBy("provider", 1 - mode_rank())
    return observations(spark, sf_dir).select("provider", "mode").distinct().withColumn("place", F.row_number().over(order).cast("long"))


@query("latest_run", f"WITH {OBS_SQL} SELECT query_id % 7 AS project_id, max(run_id) AS run_id, count(DISTINCT run_id) AS runs, arg_max(sample_id, ts) AS last_sample FROM obs GROUP BY project_id")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("project_id", F.col("query_id") % 7)
    return obs.groupBy("project_id").agg(F.max("run_id").alias("run_id"), F.count_distinct("run_id").alias("runs"), F.max_by("sample_id", "ts").alias("last_sample"))


@query("in_flight_runs", f"WITH {OBS_SQL} SELECT run_id, bool_or(status IN ('PENDING', 'RUNNING')) AS in_flight FROM obs GROUP BY run_id")
def in_flight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("run_id").agg(F.bool_or(F.col("status").isin("PENDING", "RUNNING")).alias("in_flight"))


@query("credential_membership", f"WITH {PROVIDER_SQL}, held AS (SELECT DISTINCT user_id, event_type AS provider FROM events WHERE event_id % 3 = 0 AND user_id % 4 <> 0), asked AS (SELECT DISTINCT user_id, event_type AS provider FROM events) SELECT user_id, provider, list_filter([CASE WHEN parametric THEN 'PARAMETRIC' END, CASE WHEN grounded THEN 'GROUNDED' END], lambda x: x IS NOT NULL)::VARCHAR AS modes, EXISTS (SELECT 1 FROM held h WHERE h.user_id = asked.user_id AND h.provider = asked.provider) AS has_credential FROM asked JOIN prov USING (provider)")
def credential_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engines that each user asks: their modes, and whether the user holds a credential for them."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("provider"))
    held = e.where("event_id % 3 = 0 AND user_id % 4 <> 0").select("user_id", "provider").distinct().withColumn("has", F.lit(True))
    modes = F.array_compact(F.array(F.when(F.col("parametric"), "PARAMETRIC"), F.when(F.col("grounded"), "GROUNDED")))
    asked = e.select("user_id", "provider").distinct().join(providers(spark), "provider").join(held, ["user_id", "provider"], "left")
    return asked.select("user_id", "provider", F.concat(F.lit("["), F.array_join(modes, ", "), F.lit("]")).alias("modes"), F.col("has").isNotNull().alias("has_credential"))


@query("compatibility", f"WITH {OBS_SQL} SELECT DISTINCT run_id, CASE WHEN dayofmonth(CAST(run_id AS DATE)) = 1 THEN 'no-run' WHEN dayofmonth(CAST(run_id AS DATE)) % 3 = 0 THEN 'run-mismatch' WHEN dayofmonth(CAST(run_id AS DATE)) % 3 = 1 THEN 'version-mismatch' ELSE 'match' END AS state FROM obs")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether findings belong to the data on display: run and version named by the findings against those read."""
    day = F.dayofmonth(F.to_date("run_id"))
    shown = observations(spark, sf_dir).select("run_id").distinct().withColumns({"shown_run": F.when(day != 1, day), "found_run": F.when(day % 3 == 0, day + 1).otherwise(day), "shown_version": F.lit("v3"), "found_version": F.when(day % 3 == 1, "v2").otherwise("v3")})
    return shown.select("run_id", match_state(F.col("shown_run"), F.col("found_run"), F.col("shown_version"), F.col("found_version")).alias("state"))


def match_state(run: Column, found_run: Column, version: Column, found_version: Column) -> Column:
    return F.when(run.isNull(), "no-run").when(run != found_run, "run-mismatch").when(version != found_version, "version-mismatch").otherwise("match")
