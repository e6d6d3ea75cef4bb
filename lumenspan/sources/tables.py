"""Deterministic projections of the driver's tables onto the measurement domain, in Spark and - for the oracles - in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reference data of engines and entities.
PROVIDERS = [("click", True, True, True), ("error", True, True, False), ("purchase", True, True, True), ("signup", False, True, True), ("view", True, True, False)]
PROVIDER_COLUMNS = "provider string, parametric boolean, grounded boolean, has_credential boolean"
ENTITIES = [("b1", "BRAND", "inble", "thing", "example.com"), ("c1", "COMPETITOR", "antion", None, "example.net"), ("c2", "COMPETITOR", "thtion", None, "example.org"), ("c3", "COMPETITOR", "nicht", None, None)]
ENTITY_COLUMNS = "entity_id string, kind string, name string, alias string, domain string"
ENGINES = ["openai", "claude", "gemini", "perplexity", "mock"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, PROVIDER_COLUMNS)


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, ENTITY_COLUMNS)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each paid call: sample_id, run_id, query_id, provider, mode, score, brand_present, status, ts."""
    e = F.col("event_id")
    status = F.when(e % 17 == 0, "FAILED").when(e % 29 == 0, "CANCELLED").when(e % 31 == 0, "RUNNING").otherwise("COMPLETED")
    return read(spark, sf_dir, "events").select(
        e.alias("sample_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("user_id").alias("query_id"),
        F.col("event_type").alias("provider"),
        F.when(e % 2 == 0, "GROUNDED").otherwise("PARAMETRIC").alias("mode"),
        F.least(F.lit(100.0), F.col("value")).alias("score"),
        (e % 3 != 0).alias("brand_present"),
        status.alias("status"),
        "ts",
    )


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only completed calls enter distributions."""
    return observations(spark, sf_dir).where(F.col("status") == "COMPLETED")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers: sample_id, task_id, run_id, query_id, engine, mode, text."""
    c = F.col("conv_id")
    engine = F.element_at(F.array(*[F.lit(x) for x in ENGINES]), (c % 5 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select((c * 1000 + F.col("turn")).alias("sample_id"), c.alias("task_id"), (c % 5).alias("run_id"), (c % 40).alias("query_id"), engine.alias("engine"), F.when(c % 2 == 0, "GROUNDED").otherwise("PARAMETRIC").alias("mode"), "text")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-token mentions of single-word names: sample_id, entity_id, kind, mention_type, at (token position)."""
    e = entities(spark)
    needles = e.select("entity_id", "kind", F.col("name").alias("token"), F.lit("EXACT").alias("mention_type")).unionByName(e.where("alias IS NOT NULL").select("entity_id", "kind", F.col("alias").alias("token"), F.lit("ALIAS").alias("mention_type")))
    tokens = responses(spark, sf_dir).select("sample_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("tok_at", "token"))
    # the catalogue of entities is a constant of a few rows
    return tokens.join(F.broadcast(needles), "token").select("sample_id", "entity_id", "kind", "mention_type", "tok_at")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited pages of completed answers: sample_id, url, domain, source_kind."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)), r"^www\.", "")
    kind = F.element_at(F.array(F.lit("NATIVE"), F.lit("INLINE_MARKDOWN"), F.lit("BARE_URL")), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 40 * 1000 + 1).alias("sample_id"), "url", host.alias("domain"), kind.alias("source_kind"))


OBS_SQL = """obs AS (
  SELECT event_id AS sample_id, strftime(ts, '%Y-%m-%d') AS run_id, user_id AS query_id, event_type AS provider,
         CASE WHEN event_id % 2 = 0 THEN 'GROUNDED' ELSE 'PARAMETRIC' END AS mode,
         least(100.0, value) AS score, event_id % 3 <> 0 AS brand_present,
         CASE WHEN event_id % 17 = 0 THEN 'FAILED' WHEN event_id % 29 = 0 THEN 'CANCELLED'
              WHEN event_id % 31 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, ts
  FROM events), done AS (SELECT * FROM obs WHERE status = 'COMPLETED')"""


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


def values_sql(rows: list[tuple], columns: str, name: str) -> str:
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"{name}({names}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


PROVIDER_SQL = values_sql(PROVIDERS, PROVIDER_COLUMNS, "prov")
ENTITY_SQL = values_sql(ENTITIES, ENTITY_COLUMNS, "ent")
RESPONSE_SQL = f"""resp AS (
  SELECT conv_id * 1000 + turn AS sample_id, conv_id AS task_id, conv_id % 5 AS run_id, conv_id % 40 AS query_id,
         list_extract({ENGINES!r}, CAST(conv_id % 5 + 1 AS INT)) AS engine,
         CASE WHEN conv_id % 2 = 0 THEN 'GROUNDED' ELSE 'PARAMETRIC' END AS mode, text
  FROM conversations WHERE role = 'assistant')"""
MENTION_SQL = ENTITY_SQL + ", " + RESPONSE_SQL + r""", tok AS (
  SELECT sample_id, unnest(parts) AS token, generate_subscripts(parts, 1) - 1 AS tok_at
  FROM (SELECT sample_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS parts FROM resp)), needle AS (
  SELECT entity_id, kind, name AS token, 'EXACT' AS mention_type FROM ent
  UNION ALL SELECT entity_id, kind, alias, 'ALIAS' FROM ent WHERE alias IS NOT NULL), mention AS (
  SELECT sample_id, entity_id, kind, mention_type, tok_at FROM tok JOIN needle USING (token))"""
CITATION_SQL = r"""cit AS (
  SELECT page_id, page_id % 40 * 1000 + 1 AS sample_id, url,
         regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS domain,
         list_extract(['NATIVE', 'INLINE_MARKDOWN', 'BARE_URL'], CAST(page_id % 3 + 1 AS INT)) AS source_kind
  FROM pages)"""
