"""From stored answers to mentions: extraction by version, and what is still to be extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.answers import extracted
from lumenspan.operators.catalogue import catalogue_mentions_of
from lumenspan.queries import query
from lumenspan.sources.stage import written
from lumenspan.sources.tables import ENTITIES, ENTITY_SQL, RESPONSE_SQL, entities, read, responses


def project_catalogue(spark: SparkSession) -> DataFrame:
    """The reference entities as the catalogue of the one project that the answers are of."""
    own = F.array_compact(F.array("alias")).alias("aliases")
    return entities(spark).select(F.lit("demo").alias("project_id"), F.col("entity_id").alias("id"), "kind", "name", own, "domain")


def mention_rows(answers: DataFrame, version: str = "v3") -> DataFrame:
    """sample_id and a row for each mention."""
    of = answers.select(F.col("sample_id").alias("key"), F.lit("demo").alias("project_id"), "text")
    return catalogue_mentions_of(of, project_catalogue(answers.sparkSession), version).withColumnRenamed("key", "sample_id")


@query("mention_extract_v3")
def mention_extract_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans settled across all entities; vectors in the tests."""
    return mention_rows(responses(spark, sf_dir))


@query("mention_extract_v2")
def mention_extract_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans settled within each entity."""
    return mention_rows(responses(spark, sf_dir), "v2")


@query("mention_spelled_out", f"WITH {ENTITY_SQL}, {RESPONSE_SQL}" + r""", tok AS (SELECT sample_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM resp)
SELECT sample_id, entity_id, CASE WHEN token = name THEN 'EXACT' ELSE 'ALIAS' END AS mention_type, count(*) AS n FROM tok JOIN ent ON token = name OR token = alias GROUP BY ALL""")
def mention_spelled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and aliases that extraction finds, against whole tokens in SQL."""
    spelled = mention_rows(responses(spark, sf_dir)).where(F.col("mention_type").isin("EXACT", "ALIAS"))
    return spelled.groupBy("sample_id", "entity_id", "mention_type").agg(F.count(F.lit(1)).alias("n"))


@query("document_mentions", f"WITH {ENTITY_SQL}" + r""", tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents)
SELECT doc_id, entity_id, count(*) AS n FROM tok JOIN ent ON token = name OR token = alias GROUP BY ALL""")
def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents, for volume; a catalogue of a few constants goes along with the tasks, which is faster than joins."""
    few = [{"id": i, "kind": k, "name": n, "aliases": [a] if a else [], "domain": d} for i, k, n, a, d in ENTITIES]
    found = extracted(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text"), few)
    # an inner explode would have its filter of empty lists pushed below it, and extract twice
    rows = found.select("sample_id", F.explode_outer("mentions").alias("m")).where("m IS NOT NULL").select("sample_id", "m.*")
    spelled = rows.where(F.col("mention_type").isin("EXACT", "ALIAS"))
    return spelled.groupBy(F.col("sample_id").alias("doc_id"), "entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("unextracted", f"WITH {RESPONSE_SQL} SELECT sample_id FROM resp WHERE task_id % 3 <> 0")
def unextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without stored evidence under the version: those that extraction still has to read."""
    answers = responses(spark, sf_dir)
    return answers.join(answers.where("task_id % 3 = 0").select("sample_id"), "sample_id", "left_anti").select("sample_id")


def united_evidence(answers: DataFrame, stored: DataFrame, version: str = "v3") -> DataFrame:
    """stored mention rows (sample_id, ...) as they are, and new ones of the answers that none are stored of. What is stored isn't
    extracted again, whatever it holds; an answer without a mention is stored as a row without an entity."""
    fresh = answers.join(stored.select("sample_id").distinct(), "sample_id", "left_anti")
    rows = mention_rows(fresh, version).withColumn("origin", F.lit("fresh"))
    return stored.where("entity_id IS NOT NULL").withColumn("origin", F.lit("stored")).unionByName(rows)


@query("evidence_united", f"WITH {ENTITY_SQL}, {RESPONSE_SQL}" + r""", tok AS (SELECT sample_id, task_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM resp)
SELECT sample_id, entity_id, CASE WHEN task_id % 3 = 0 THEN 'stored' ELSE 'fresh' END AS origin, count(*) AS n FROM tok JOIN ent ON token = name OR token = alias GROUP BY ALL""")
def evidence_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the answers were read before; their mentions were written, also of answers without any."""
    answers = responses(spark, sf_dir)
    before = answers.where("task_id % 3 = 0").select("sample_id")
    stored = written(before.join(mention_rows(answers.where("task_id % 3 = 0")), "sample_id", "left"), "stored-mentions")
    found = united_evidence(answers, stored).where(F.col("mention_type").isin("EXACT", "ALIAS"))
    return found.groupBy("sample_id", "entity_id", "origin").agg(F.count(F.lit(1)).alias("n"))
