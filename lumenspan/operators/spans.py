"""Spans of texts as columns: which overlap, which of them stay, and texts cut into marked and plain pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.operators.extraction import mention_rows
from lumenspan.queries import query
from lumenspan.sources.tables import ENTITY_SQL, RESPONSE_SQL, responses

#: Spans that overlap share a bin of so many characters, whatever their lengths.
BIN = 64


def binned(spans: DataFrame) -> DataFrame:
    """spans (start, end, not empty) with a row for each bin that they touch."""
    return spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))


def clear_of(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The spans that overlap none of the others of their keys: an equi-join by bins."""
    theirs = binned(others.select(*keys, "start", "end")).select(*keys, "bin", F.col("start").alias("from"), F.col("end").alias("upto"))
    mine = spans.withColumn("start_", F.col("start")).withColumn("end_", F.col("end"))
    met = binned(mine).join(theirs, [*keys, "bin"]).where((F.col("start") < F.col("upto")) & (F.col("from") < F.col("end"))).select(*keys, "start", "end").distinct()
    return spans.join(met, [*keys, "start", "end"], "left_anti")


def settled(spans: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The spans that stay: in the given order, each that overlaps none that stays already. Only spans of a cluster, that overlaps of spans
    hold together, can exclude each other, so each cluster is settled for itself."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    cluster = F.sum(fresh.cast("int")).over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in spans.columns if c not in keys]
    ranked = spans.withColumn("cluster", cluster).withColumn("s", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest))
    lists = ranked.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list("s")).alias("s"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    none = F.filter("s", lambda x: F.lit(False))
    kept = F.aggregate("s", none, lambda held, x: F.when(F.exists(held, lambda h: meets(h, x)), held).otherwise(F.array_append(held, x)))
    return lists.select(*keys, F.explode(kept).alias("s")).select(*keys, *[F.col(f"s.{c}") for c in rest])


def segments(text: Column, spans: Column) -> Column:
    """Pieces of a text, marked or plain, whose concatenation is the text. spans: array<struct<start, end>> in UTF-16 units, as mentions have them;
    of those that overlap the first counts, and the longer at the same start."""
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg")))), lambda s: F.struct(s["start"].alias("start"), (-s["neg"]).alias("end")))
    units = F.encode(text, "UTF-16BE")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,marked:boolean>>").alias("out"))
    piece = lambda lo, hi, m: F.struct(F.decode(F.substring(units, 2 * lo + 1, 2 * (hi - lo)), "UTF-16BE").alias("text"), F.lit(m).alias("marked"))
    step = lambda a, s: F.when((s["start"] < a["at"]) | (s["end"] <= s["start"]), a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(piece(a["at"], s["start"], False), piece(s["start"], s["end"], True))).alias("out")))
    done = lambda a: F.filter(F.concat(a["out"], F.array(piece(a["at"], (F.octet_length(units) / 2).cast("int"), False))), lambda p: p["text"] != "")
    return F.aggregate(ordered, zero, step, done)


def highlighted(answers: DataFrame, found: DataFrame) -> DataFrame:
    """sample_id, segments of each answer (sample_id, text) by its mentions (sample_id, char_offset, char_end)."""
    span = F.struct(F.col("char_offset").alias("start"), F.col("char_end").alias("end"))
    spans = found.groupBy("sample_id").agg(F.collect_list(span).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return answers.join(spans, "sample_id", "left").select("sample_id", segments(F.col("text"), F.coalesce("spans", none)).alias("segments"))


@query("highlight", f"WITH {ENTITY_SQL}, {RESPONSE_SQL}" + r""", tok AS (SELECT sample_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS pos FROM (SELECT sample_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS parts FROM resp)),
hit AS (SELECT DISTINCT sample_id, token, pos FROM tok JOIN ent ON lower(strip_accents(token)) IN (name, alias) OR (length(name) >= 5 AND levenshtein(lower(strip_accents(token)), name) <= 1)),
m AS (SELECT sample_id, string_agg(token, '|' ORDER BY pos) AS marked, count(*) AS n FROM hit GROUP BY ALL)
SELECT sample_id, text AS joined, coalesce(marked, '') AS marked, coalesce(n, 0) AS n FROM resp LEFT JOIN m USING (sample_id)""")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut at the mentions found in them."""
    answers = responses(spark, sf_dir).select("sample_id", "text")
    out = highlighted(answers, mention_rows(answers))
    marked = F.transform(F.filter("segments", lambda p: p["marked"]), lambda p: p["text"])
    joined = F.array_join(F.transform("segments", lambda p: p["text"]), "")
    return out.select("sample_id", joined.alias("joined"), F.array_join(marked, "|").alias("marked"), F.size(marked).cast("long").alias("n"))
