"""What leaves: CSV and JSON exports, the measurement passport, keyed writes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators.rollup import cluster_summary, summary_sql
from lumenspan.queries import query
from lumenspan.sources.tables import completed

#: The export's headers.
CSV_HEADERS = ["Requête", "Moteur", "Mode", "Médiane", "IC bas", "IC haut", "Stabilité", "N", "N brut", "Méthode intervalle", "Unité N", "N faible", "Taux de présence marque", "Concurrents", "Citations"]
BOM = "﻿"


def csv_cell(x: Column) -> Column:
    """Always quoted; an apostrophe disarms what a spreadsheet would take for a formula; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column `value`: a line for each row."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("value"))


def csv_header(names: list[str] = CSV_HEADERS) -> str:
    return BOM + ",".join(f'"{n}"' for n in names)


def write_csv(df: DataFrame, path: str, names: list[str] = CSV_HEADERS) -> None:
    """CRLF lines; the header with its mark stands first in the first part, so that the parts one after the other are one CSV."""
    csv_lines(df).mapInArrow(_with_header(csv_header(names)), "value string").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def _with_header(header: str):
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        first = next(batches, None)
        if TaskContext.get().partitionId() == 0:
            schema = first.schema if first is not None else pa.schema([("value", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([header], schema.field(0).type)], schema=schema)
        if first is not None:
            yield first
        yield from batches

    return run


def _plain_name(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not "\u0300" <= c <= "\u036f")


def safe_filename(name: str, fallback: str = "projet", limit: int = 60) -> str:
    """Letters and digits of a name without its accents, joined by hyphens."""
    return re.sub(r"[^A-Za-z0-9]+", "-", _plain_name(name)).strip("-")[:limit] or fallback


def passport_filename(query: str, provider: str, exported_at: str) -> str:
    """Of lower-case parts: 42 characters of the query, 20 of the engine, and the day."""
    part = lambda x, limit: safe_filename(x.lower(), "mesure", limit).rstrip("-") or "mesure"
    return f"measurement-{part(query, 42)}-{part(provider, 20)}-{exported_at[:10]}.json"


def json_export(df: DataFrame, **envelope: Column) -> DataFrame:
    """One column `value`: a JSON document for each row, with the envelope's fields in front."""
    return df.select(F.to_json(F.struct(*[c.alias(k) for k, c in envelope.items()], *df.columns), {"ignoreNullFields": "false"}).alias("value"))


def passport_markdown(df: DataFrame) -> DataFrame:
    """One column `value`: a Markdown line for each row; null reads "indisponible"."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("indisponible")), r"([\\|*_`\[\]<>])", r"\\$1")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows stay; of new ones the first of each key by the order's columns comes in, of equal ones the smallest."""
    rest = [c for c in new.columns if c not in keys]
    ranked = [*(order or []), *[c for c in rest if c not in (order or [])]]
    if rest:
        new = new.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("row")).select(*keys, *[f"row.{c}" for c in rest])
    return old.unionByName(new.select(*old.columns).distinct().join(old.select(*keys), keys, "left_anti"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Delete and insert: only partitions that df holds are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


EXPORT_SQL = f"WITH s AS ({summary_sql('run_id, mode')}) SELECT "


@query("csv_export", EXPORT_SQL + """'"' || run_id || '","' || CASE WHEN mode = 'GROUNDED' THEN 'groundé' ELSE 'paramétrique' END || '","' || n || '","' || raw_n || '","' || CASE WHEN low_n THEN 'oui' ELSE 'non' END || '","''=' || mode || '"' AS value FROM s""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cluster_summary(completed(spark, sf_dir), ["run_id", "mode"])
    return csv_lines(s.select("run_id", F.when(F.col("mode") == "GROUNDED", "groundé").otherwise("paramétrique").alias("m"), "n", "raw_n", F.when(F.col("low_n"), "oui").otherwise("non").alias("low"), F.concat(F.lit("="), "mode").alias("formula")))


@query("json_export", EXPORT_SQL + """'{"project":"demo","run_id":"' || run_id || '","mode":"' || mode || '","n":' || n || ',"ci_low":null}' AS value FROM s""")
def json_export_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cluster_summary(completed(spark, sf_dir), ["run_id", "mode"])
    return json_export(s.select("run_id", "mode", "n", F.lit(None).cast("double").alias("ci_low")), project=F.lit("demo"))


@query("passport", EXPORT_SQL + """'| ' || run_id || ' | ' || mode || ' | ' || n || ' | indisponible |' AS value FROM s""")
def passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cluster_summary(completed(spark, sf_dir), ["run_id", "mode"])
    return passport_markdown(s.select("run_id", "mode", "n", F.lit(None).cast("double").alias("ci_low")))


@query("upsert_scores", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN max(value) ELSE min(value) END AS value FROM events GROUP BY user_id")
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    old = events.groupBy("user_id").agg(F.min("value").alias("value"))
    return upsert(old, events.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("value")), ["user_id"])


@query("insert_ignore", "SELECT user_id, 'old' AS origin FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) UNION ALL SELECT user_id, 'new' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id")
    return insert_new(users.where("user_id % 3 = 0").distinct().withColumn("origin", F.lit("old")), users.withColumn("origin", F.lit("new")), ["user_id"])
