"""Mentions of entities that a table lists: any number of them, in any number of projects.

Answers meet the catalogue by tokens, as joins. Every needle (a name, an alias, a domain) is anchored at the rarest of its tokens
in the project's answers, and not looked for at all if one of its tokens is in none of them. Names one edit away meet the
project's vocabulary by deletion neighbours: two words within one edit are the same after at most one letter of each is left out. So each answer
gets a short list of candidates, with the tokens that come near their names, and only answers with candidates go to the Arrow function
that finds spans and settles overlaps. Nothing is broadcast but what Spark finds small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.answers import MIN_FUZZY, WORD, folded_column, found_among, host_needle_column, known, needle_column
from lumenspan.queries import query
from lumenspan.sources.stage import written
from lumenspan.sources.tables import read

ENTITY = ["id", "kind", "name", "aliases", "domain"]
#: Answers that a task reads. Texts are dealt by number: a table of few files, or of large row groups, would be few tasks.
PER_TASK = 2000


def words(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)))


def deletions(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    n = F.char_length(word)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), without))


def needles(catalogue: DataFrame) -> DataFrame:
    """project_id, id, needle, exact (a name) for all that is looked for."""
    alias = F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = catalogue.select("project_id", "id", "name", "domain", alias.alias("alias"))
    spelled = each.select("project_id", "id", F.coalesce("alias", "name").alias("text"), F.col("alias").isNull().alias("exact"))
    spelled = spelled.select("project_id", "id", needle_column("text").alias("needle"), "exact")
    hosts = catalogue.where("domain IS NOT NULL").select("project_id", "id", host_needle_column("domain").alias("needle"), F.lit(False).alias("exact"))
    return spelled.unionByName(hosts).where("needle <> ''")


def anchors(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """project_id, token, id: the rarest token of each needle all of whose tokens there are."""
    each = asked.withColumn("tokens", words(F.col("needle"))).withColumn("needed", F.size("tokens"))
    each = each.select("project_id", "id", "needle", "needed", F.explode("tokens").alias("token")).distinct().join(vocabulary, ["project_id", "token"])
    rarest = each.groupBy("project_id", "id", "needle", "needed").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "token")).alias("least"))
    return rarest.where("met = needed").select("project_id", F.col("least.token").alias("token"), "id").distinct()


def neighbours(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """project_id, token, id: tokens of the vocabulary at most one edit away from a name."""
    names = asked.where("exact").where(F.char_length("needle") >= MIN_FUZZY).select("project_id", "id", F.col("needle").alias("name")).distinct()
    longest = names.agg(F.max(F.char_length("name"))).first()[0] or 0
    tokens = vocabulary.where(F.char_length("token").between(MIN_FUZZY - 1, longest + 1)).select("project_id", "token", F.explode(deletions(F.col("token"))).alias("key"))
    met = names.select("*", F.explode(deletions(F.col("name"))).alias("key")).join(tokens, ["project_id", "key"])
    return met.where(F.levenshtein("token", "name") <= 1).select("project_id", "token", "id").distinct()


def candidates(answers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, candidates from answers (key, project_id, text) and catalogue (project_id, id, kind, name, aliases, domain)."""
    read_as = answers.repartition(width_for(answers), "key").select("key", "project_id", folded_column(F.col("text")).alias("folded"))
    asked = written(needles(catalogue), "needles")
    tokens = written(read_as.select("key", "project_id", words(F.col("folded")).alias("tokens")), "tokens")
    each = tokens.select("key", "project_id", F.explode("tokens").alias("token"))
    vocabulary = written(each.groupBy("project_id", "token").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    near = neighbours(asked, vocabulary).withColumn("near", F.col("token"))
    wanted = written(anchors(asked, vocabulary).withColumn("near", F.lit(None).cast("string")).unionByName(near), "anchors")
    met = each.join(wanted, ["project_id", "token"]).select("key", "project_id", "id", "near")
    # what has no token, such as "++", is looked for in all answers of its project
    wordless = asked.where(F.size(words(F.col("needle"))) == 0).select("project_id", "id", "needle")
    if not wordless.isEmpty():
        held = read_as.join(wordless, "project_id").where(F.contains("folded", "needle"))
        met = met.unionByName(held.select("key", "project_id", "id", F.lit(None).cast("string").alias("near")))
    entity = met.groupBy("key", "project_id", "id").agg(F.collect_set("near").alias("near")).join(catalogue, ["project_id", "id"])
    return entity.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*ENTITY, "near"))).alias("candidates"))


def width_for(answers: DataFrame) -> int:
    return max(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-answers.count() // PER_TASK))


def catalogue_mentions_of(answers: DataFrame, catalogue: DataFrame, version: str = "v3") -> DataFrame:
    """key and a row for each mention (MENTION's columns). answers: key (one for each answer), project_id, text; catalogue: project_id, id (one
    for each entity of a project), kind, name, aliases, domain. Entities of an answer that begin at one place are ranked by their ids."""
    known(version)
    answers, catalogue = answers.select("key", "project_id", "text"), catalogue.select("project_id", *ENTITY)
    # a struct, so that a null key is equal to itself and texts are dealt by what they are joined by
    asked, width = candidates(answers, catalogue).select(F.struct("key").alias("of"), "candidates"), width_for(answers)
    # only answers with candidates are read again; both sides are dealt alike, so that they meet where they are
    joined = answers.withColumn("of", F.struct("key")).repartition(width, "of").join(asked.repartition(width, "of"), "of")
    found = joined.select("key", found_among(F.col("text"), F.col("candidates"), version).alias("mentions"))
    return found.select("key", F.explode_outer("mentions").alias("m")).where("m IS NOT NULL").select("key", "m.*")


#: A catalogue out of the tables: for each language the words of the benchmark, those of odd length as names, the next one of even length
#: and the same first letter as alias.
CATALOGUE_SQL = r"""word AS (
  SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 5), named AS (
  SELECT n.w AS name, (SELECT min(e.w) FROM word e WHERE length(e.w) % 2 = 0 AND e.w[1] = n.w[1] AND e.w > n.w) AS alias FROM word n WHERE length(n.w) % 2 = 1), cat AS (
  SELECT lang AS project_id, lang || ':' || name AS id, name, alias FROM named, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"""


def benchmark_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    word = read(spark, sf_dir, "benchmark").select(token.alias("w")).where(F.char_length("w") >= 5).distinct()
    odd = F.char_length("w") % 2 == 1
    block = F.substring("w", 1, 1).alias("block")
    even = word.where(~odd).groupBy(block).agg(F.array_sort(F.collect_list("w")).alias("evens"))
    named = word.where(odd).select(F.col("w").alias("name"), block).join(even, "block", "left")
    alias = F.get(F.filter("evens", lambda e: e > F.col("name")), F.lit(0))
    langs = read(spark, sf_dir, "documents").agg(F.collect_set("lang").alias("langs"))  # one row
    listed = named.select("name", alias.alias("alias")).crossJoin(F.broadcast(langs)).withColumn("project_id", F.explode("langs"))
    return listed.select(
        "project_id", F.concat("project_id", F.lit(":"), "name").alias("id"), F.lit("COMPETITOR").alias("kind"), "name",
        F.array_compact(F.array("alias")).alias("aliases"), F.lit(None).cast("string").alias("domain"),
    )


@query("catalogue_mentions", "WITH " + CATALOGUE_SQL + r""", tok AS (
  SELECT doc_id, lang AS project_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, lang, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS parts FROM documents)), voc AS (
  SELECT DISTINCT project_id, token FROM tok), spelled AS (
  SELECT project_id, name AS token, id, 0 AS place FROM cat UNION ALL SELECT project_id, alias, id, 1 FROM cat WHERE alias IS NOT NULL), best AS (
  SELECT project_id, token, min(place || '|' || id) AS b FROM spelled GROUP BY ALL), near AS (
  SELECT v.project_id, v.token, min('3|' || c.id) AS b FROM voc v JOIN cat c ON v.project_id = c.project_id AND abs(length(v.token) - length(c.name)) <= 1
  WHERE levenshtein(regexp_replace(v.token, '[^\x00-\x7F]', '~', 'g'), c.name) <= 1 AND NOT EXISTS (SELECT 1 FROM best WHERE best.project_id = v.project_id AND best.token = v.token) GROUP BY ALL), hit AS (
  SELECT * FROM best UNION ALL SELECT * FROM near)
SELECT doc_id, b[3:] AS entity_id, CASE b[1] WHEN '0' THEN 'EXACT' WHEN '1' THEN 'ALIAS' ELSE 'APPROXIMATE' END AS mention_type, count(*) AS n
FROM tok JOIN hit USING (project_id, token) GROUP BY ALL""")
def catalogue_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, aliases and near names of the catalogue of each document's language."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("project_id"), "text")
    found = catalogue_mentions_of(docs, benchmark_catalogue(spark, sf_dir))
    return found.groupBy(F.col("key").alias("doc_id"), "entity_id", "mention_type").agg(F.count(F.lit(1)).alias("n"))
