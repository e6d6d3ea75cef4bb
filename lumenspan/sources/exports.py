"""Whole exports of a run: a row for each task with scores, competitors and citations, as rows, CSV lines and JSON; nested run trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.stats import LOW_N_TASK, QUERY_CLUSTER, exact_mean, exact_mean_sql
from lumenspan.functions.urls import in_locale, normalized_url
from lumenspan.operators.evidence import share_sql, voice_share_task
from lumenspan.operators.rules import sample_score_v3, score_contributions, score_sql
from lumenspan.queries import query
from lumenspan.sources.sinks import csv_cell, fixed
from lumenspan.sources.tables import ENTITIES, citations, entities, mentions, responses


def export_rows(answers: DataFrame, scores: DataFrame, shares: DataFrame, cited: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each task.

    answers: sample_id and the task's columns; scores: sample_id, score, brand_present; shares: task_id, mode, entity_id, mention_share;
    cited: sample_id, page_id, url; names: entity_id, name of the competitors. Competitors come by share, then name; addresses in the order
    of the samples, of their places there and then of their normal forms, each once. A task is one cluster, so it has no interval; without scores it has n = 0.
    """
    task = ["task_id", "query_id", "engine", "mode"]
    scored = answers.join(scores.select("sample_id", "score", "brand_present"), "sample_id", "left")
    centre = scored.groupBy(*task).agg(
        exact_mean(F.col("score")).alias("median"), F.count("score").alias("raw_n"), F.avg(F.col("brand_present").cast("int")).alias("brand_presence_rate")
    )
    order = F.struct((-F.col("mention_share")).alias("by"), in_locale(F.col("name")).alias("place"), "name", "mention_share")
    rivals = shares.join(names, "entity_id").groupBy("task_id", "mode").agg(F.array_sort(F.collect_list(order)).alias("r"))
    rivals = rivals.select("task_id", "mode", F.transform("r", lambda x: F.struct(x["name"].alias("name"), x["mention_share"].alias("mention_share"))).alias("competitors"))
    place = F.struct("sample_id", "page_id", normalized_url(F.col("url")).alias("normal"), "url")
    links = cited.join(answers.select("sample_id", "task_id", "mode"), "sample_id").groupBy("task_id", "mode").agg(F.array_sort(F.collect_list(place)).alias("c"))
    links = links.select("task_id", "mode", F.array_distinct(F.transform("c", lambda x: x["url"])).alias("citations"))
    out = centre.join(rivals, ["task_id", "mode"], "left").join(links, ["task_id", "mode"], "left")
    there, none = F.col("raw_n") > 0, F.lit(None).cast("double")
    return out.select(
        "task_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), "engine", "mode", "median",
        none.alias("ci_low"), none.alias("ci_high"), F.when(there, F.lit(1.0)).alias("stability"), F.when(there, 1).otherwise(0).alias("n"), "raw_n",
        F.when(there, QUERY_CLUSTER).otherwise("unavailable").alias("ci_method"), F.when(there, "queries").otherwise("samples").alias("n_unit"),
        (F.when(there, 1).otherwise(0) < LOW_N_TASK).alias("low_n"), "brand_presence_rate",
        F.coalesce("competitors", F.array().cast("array<struct<name:string,mention_share:double>>")).alias("competitors"),
        F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
    )


def csv_export_lines(rows: DataFrame) -> DataFrame:
    """task_id and a line of the 15 columns of CSV_HEADERS for each row."""
    number = lambda c, digits: F.when(F.col(c).isNotNull(), fixed(F.col(c), digits))
    rival = lambda x: F.concat(x["name"], F.lit(" ("), fixed(x["mention_share"] * 100, 1), F.lit(" %)"))
    cells: list[Column] = [
        F.col("query"), F.initcap("engine"), F.when(F.col("mode") == "GROUNDED", "groundé").otherwise("paramétrique"), number("median", 2),
        number("ci_low", 2), number("ci_high", 2), number("stability", 3), F.col("n"), F.col("raw_n"), F.col("ci_method"), F.col("n_unit"),
        F.when(F.col("low_n"), "oui").otherwise("non"), number("brand_presence_rate", 3),
        F.array_join(F.transform("competitors", rival), " | "), F.array_join("citations", " | "),
    ]
    return rows.select("task_id", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("value"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = responses(spark, sf_dir).drop("text", "run_id")
    rivals = entities(spark).where("kind = 'COMPETITOR'").select("entity_id", "name")
    return export_rows(answers, sample_score_v3(spark, sf_dir), voice_share_task(spark, sf_dir), citations(spark, sf_dir), F.broadcast(rivals))


_NAMES = ", ".join(f"('{e[0]}', '{e[2]}')" for e in ENTITIES if e[1] == "COMPETITOR")
EXPORT_SQL = f"""{score_sql("v3").rstrip()}, ps AS (
  SELECT sample_id, round(least(100.0, greatest(0.0, presence + prominence + frequency + voice + citation + sentiment + lead)), 6) AS score, present FROM z), ct AS (
  SELECT task_id, query_id, engine, mode, {exact_mean_sql("score")} AS median, count(score) AS raw_n, avg(present::INT) AS rate FROM resp JOIN ps USING (sample_id) GROUP BY ALL), sh AS (
  {share_sql("task_id, mode")}), rv AS (
  SELECT task_id, mode, list({{'name': name, 'mention_share': mention_share}} ORDER BY mention_share DESC, name) AS competitors
  FROM sh JOIN (VALUES {_NAMES}) nm(entity_id, name) USING (entity_id) GROUP BY ALL), fs AS (
  SELECT task_id, mode, url, min(sample_id * 1000000 + page_id) AS seen FROM cit JOIN resp USING (sample_id) GROUP BY ALL), ln AS (
  SELECT task_id, mode, list(url ORDER BY seen) AS links FROM fs GROUP BY ALL), ex AS (
  SELECT *, raw_n > 0 AS there FROM ct LEFT JOIN rv USING (task_id, mode) LEFT JOIN ln USING (task_id, mode))"""


@query("full_csv_export", EXPORT_SQL + """
SELECT task_id, '"q' || query_id || '","' || upper(engine[1]) || engine[2:] || '","' || CASE WHEN mode = 'GROUNDED' THEN 'groundé' ELSE 'paramétrique' END || '","'
  || printf('%.2f', round(median, 2)) || '","","","1.000","1","' || raw_n || '","query-cluster-v1","queries","oui","' || printf('%.3f', round(rate, 3)) || '","'
  || array_to_string(list_transform(competitors, lambda c: c.name || ' (' || printf('%.1f', round(c.mention_share * 100, 1)) || ' %)'), ' | ') || '","'
  || coalesce(array_to_string(links, ' | '), '') || '"' AS value FROM ex""")
def full_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen columns for each task."""
    return csv_export_lines(_rows(spark, sf_dir))


@query("full_json_export", EXPORT_SQL + """
SELECT task_id, engine, mode, round(median, 6) AS median, raw_n, round(rate, 6) AS brand_presence_rate, len(competitors) AS n_competitors, competitors[1].name AS first_competitor,
  round(competitors[1].mention_share, 6) AS first_share, coalesce(len(links), 0) AS n_citations, links[1] AS first_citation FROM ex""")
def full_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of each task, read back."""
    shape = "task_id long, engine string, mode string, median double, raw_n long, brand_presence_rate double, competitors array<struct<name:string,mention_share:double>>, citations array<string>"
    rows = _rows(spark, sf_dir)
    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    r = text.select(F.from_json("value", shape).alias("r")).select("r.*")
    first = F.get("competitors", F.lit(0))
    return r.select(
        "task_id", "engine", "mode", F.round("median", 6).alias("median"), "raw_n", F.round("brand_presence_rate", 6).alias("brand_presence_rate"),
        F.size("competitors").cast("long").alias("n_competitors"), first["name"].alias("first_competitor"), F.round(first["mention_share"], 6).alias("first_share"),
        F.size("citations").cast("long").alias("n_citations"), F.get("citations", F.lit(0)).alias("first_citation"),
    )


def run_nodes(answers: DataFrame, found: DataFrame, cited: DataFrame, contributions: DataFrame) -> DataFrame:
    """run_id, task_id, samples: the samples of a task with their mentions, citations and contributions as arrays of structs."""
    leaf = lambda df, name, *fields: df.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = answers.select("sample_id", "run_id", "task_id")
    for part in (
        leaf(found, "mentions", "tok_at", "entity_id", "mention_type"), leaf(cited, "citations", "page_id", "url", "source_kind"),
        leaf(contributions, "contributions", "rule_id", "contribution"),
    ):
        name = part.columns[1]
        out = out.join(part, "sample_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    node = F.struct("sample_id", "mentions", "citations", "contributions")
    return out.groupBy("run_id", "task_id").agg(F.array_sort(F.collect_list(node)).alias("samples"))


@query("run_tree_nested", f"""{score_sql("v3").rstrip()}, mn AS (SELECT sample_id, count(*) AS n, arg_min(entity_id, tok_at * 10 + CAST(right(entity_id, 1) AS INT)) AS first FROM mention GROUP BY ALL), cn AS (
  SELECT sample_id, count(*) AS n, arg_min(url, page_id) AS first FROM cit GROUP BY ALL)
SELECT run_id, task_id, sample_id, coalesce(mn.n, 0) AS n_mentions, mn.first AS first_entity, coalesce(cn.n, 0) AS n_citations, cn.first AS first_url, 7 AS n_contributions,
  round(presence + prominence + frequency + voice + citation + sentiment + lead, 4) AS raw_score
FROM resp JOIN z USING (sample_id) LEFT JOIN mn USING (sample_id) LEFT JOIN cn USING (sample_id)""")
def run_tree_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each run, walked: what each sample's node holds."""
    tree = run_nodes(responses(spark, sf_dir), mentions(spark, sf_dir), citations(spark, sf_dir), score_contributions(spark, sf_dir))
    s = tree.select("run_id", "task_id", F.explode("samples").alias("s")).select("run_id", "task_id", "s.*")
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["contribution"])
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return s.select(
        "run_id", "task_id", "sample_id", size("mentions"), F.get("mentions", F.lit(0))["entity_id"].alias("first_entity"), size("citations"),
        F.get("citations", F.lit(0))["url"].alias("first_url"), size("contributions"), F.round(total, 4).alias("raw_score"),
    )
