"""Citations: addresses, domains, merges and shares of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.urls import TWO_LABEL_SUFFIXES, ascii_url, domain_matches, host_and_parents, in_locale, normalized_url, registrable_domain, same_domain, text_urls
from lumenspan.queries import query
from lumenspan.sources.tables import CITATION_SQL, ENTITY_SQL, RESPONSE_SQL, citations, entities, read, responses

#: The normal form in DuckDB, for addresses of the shipped pages.
NORM_SQL = r"""lower(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '')
 || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
 || coalesce(nullif('?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: list_contains(['id','page','slug','category','q','query','tab','section'], lower(string_split(p, '=')[1])))), '&'), '?'), ''))"""
LAST_TWO = "array_to_string(string_split({h}, '.')[-2:], '.')"
REG_SQL = f"CASE WHEN {LAST_TWO.format(h='domain')} IN ({', '.join(map(repr, TWO_LABEL_SUFFIXES))}) THEN array_to_string(string_split(domain, '.')[-3:], '.') ELSE {LAST_TWO.format(h='domain')} END"


@query("url_normalize", f"SELECT page_id, {NORM_SQL} AS normalized FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", normalized_url(ascii_url(F.col("url"))).alias("normalized"))


@query("registrable_domains", f"WITH {CITATION_SQL} SELECT page_id, {REG_SQL} AS registrable FROM cit")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", registrable_domain(F.col("url")).alias("registrable"))


@query("text_urls", "SELECT page_id, 1 AS n_urls, url AS first_url, 't' || page_id AS title, 'INLINE_MARKDOWN' AS kind FROM pages")
def text_urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address, once as a Markdown link and once bare with a full stop: one source."""
    text = F.concat(F.lit("[t"), F.col("page_id").cast("string"), F.lit("]("), F.col("url"), F.lit(") "), F.col("url"), F.lit("."))
    found = read(spark, sf_dir, "pages").select("page_id", text_urls(text).alias("s"))
    return found.select("page_id", F.size("s").alias("n_urls"), F.col("s")[0]["url"].alias("first_url"), F.col("s")[0]["title"].alias("title"), F.col("s")[0]["kind"].alias("kind"))


KIND_RANK = {"NATIVE": 0, "INLINE_MARKDOWN": 1, "BARE_URL": 2}


def merged_citations(sources: DataFrame, keys: list[str]) -> DataFrame:
    """sources: keys, at (order), url, title, source_kind. One row for each normal address: the strongest kind gives url and kind; its title
    is that of the last stronger source that has one, else the first title; position counts first appearances."""
    rank = F.when(F.col("source_kind") == "NATIVE", 0).when(F.col("source_kind") == "INLINE_MARKDOWN", 1).otherwise(2)
    s = sources.withColumns({"normalized": normalized_url(ascii_url(F.col("url"))), "rank": rank}).where("normalized IS NOT NULL")
    seen = Window.partitionBy(*keys, "normalized").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("stronger", F.coalesce(F.col("rank") < F.min("rank").over(seen), F.lit(True)))
    titled = F.nullif(F.col("title"), F.lit(""))
    out = s.groupBy(*keys, "normalized").agg(
        F.min("at").alias("first_at"), F.min_by("url", F.struct("rank", "at")).alias("url"), F.min_by("source_kind", F.struct("rank", "at")).alias("source_kind"),
        F.max_by(titled, F.when(F.col("stronger") & titled.isNotNull(), F.col("at"))).alias("strong_title"), F.max(F.when(F.col("stronger") & titled.isNotNull(), F.col("at"))).alias("strong_at"),
        F.min_by(titled, F.when(titled.isNotNull(), F.col("at"))).alias("first_title"),
    )
    place = Window.partitionBy(*keys).orderBy("first_at")
    return out.select(*keys, "url", "normalized", F.coalesce("strong_title", "first_title").alias("title"), "source_kind", F.row_number().over(place).cast("long").alias("position"))


@query("citation_merge", f"""WITH {CITATION_SQL}, s AS (
  SELECT page_id % 40 AS task_id, page_id * 2 AS seq, url, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id END AS title, source_kind FROM cit
  UNION ALL SELECT page_id % 40, page_id * 2 + 1, url, 'again', 'NATIVE' FROM cit), n AS (SELECT *, {NORM_SQL} AS normalized, list_position(['NATIVE', 'INLINE_MARKDOWN', 'BARE_URL'], source_kind) AS rank FROM s), g AS (
  SELECT task_id, normalized, min(seq) AS first_at, arg_min(url, rank * 100000000 + seq) AS url, 'NATIVE' AS source_kind, list(title ORDER BY seq) AS titles, list(rank ORDER BY seq) AS ranks FROM n GROUP BY ALL)
SELECT task_id, url, normalized, CASE WHEN ranks[1] = 1 THEN coalesce(titles[1], 'again') ELSE 'again' END AS title, source_kind, row_number() OVER (PARTITION BY task_id ORDER BY first_at) AS position FROM g""")
def citation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited page comes twice, the second time from the engine itself."""
    c = citations(spark, sf_dir).withColumn("task_id", F.col("page_id") % 40)
    once = c.select("task_id", (F.col("page_id") * 2).alias("at"), "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("title"), "source_kind")
    again = c.select("task_id", (F.col("page_id") * 2 + 1).alias("at"), "url", F.lit("again").alias("title"), F.lit("NATIVE").alias("source_kind"))
    return merged_citations(once.unionByName(again), ["task_id"])


@query("brand_domain_match", f"WITH {CITATION_SQL} SELECT page_id, domain, {REG_SQL} = 'example.com' AS is_brand FROM cit")
def brand_domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(spark, sf_dir).select("page_id", "domain", same_domain(F.col("domain"), F.lit("www.example.com")).alias("is_brand"))


def owners_of(hosts: DataFrame, owners: DataFrame) -> DataFrame:
    """domain, entity_id: each distinct host (column domain) with the entities (entity_id, owned) whose domain it is or is below. Hosts meet
    owners by the keys of their parents, so there may be any number of either."""
    keys = hosts.where("domain IS NOT NULL").select("domain").distinct().select("domain", F.explode(F.array_distinct(host_and_parents(F.col("domain")))).alias("owned"))
    return keys.join(owners.where("owned IS NOT NULL").select("entity_id", "owned").distinct(), "owned").select("domain", "entity_id").distinct()


@query("citation_credit", f"WITH {CITATION_SQL}, {ENTITY_SQL} SELECT entity_id, count(*) AS credited, count(DISTINCT cit.domain) AS domains FROM cit JOIN ent ON cit.domain = ent.domain OR ends_with(cit.domain, '.' || ent.domain) GROUP BY entity_id")
def citation_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation may credit several entities."""
    cited = citations(spark, sf_dir)
    hit = cited.join(owners_of(cited, entities(spark).select("entity_id", F.col("domain").alias("owned"))), "domain")
    return hit.groupBy("entity_id").agg(F.count(F.lit(1)).alias("credited"), F.count_distinct("domain").alias("domains"))


@query("owned_citations", f"WITH {CITATION_SQL}, o AS (SELECT DISTINCT {REG_SQL} AS owned FROM cit UNION SELECT DISTINCT domain FROM cit) SELECT owned, count(*) AS credited, count(DISTINCT cit.domain) AS domains FROM cit JOIN o ON cit.domain = owned OR ends_with(cit.domain, '.' || owned) GROUP BY owned")
def owned_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many entities as there are hosts and registrable domains, each credited with what is cited below its own."""
    cited = citations(spark, sf_dir)
    by_host = cited.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    owned = by_host.select(F.explode(F.array("domain", registrable_domain(F.col("domain")))).alias("owned")).distinct()
    pairs = owners_of(by_host, owned.select(F.col("owned").alias("entity_id"), "owned"))
    return pairs.join(by_host, "domain").groupBy(F.col("entity_id").alias("owned")).agg(F.sum("n").alias("credited"), F.count(F.lit(1)).alias("domains"))


SOURCE_SQL = f"""WITH {CITATION_SQL}, {RESPONSE_SQL}, j AS (SELECT cit.domain, cit.sample_id, mode, engine, query_id FROM cit JOIN resp USING (sample_id)), g AS (
  SELECT domain, count(*) AS n_citations, count(DISTINCT sample_id) AS n_samples, bool_or(domain = 'example.com' OR ends_with(domain, '.example.com')) AS is_brand,
         string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, count(DISTINCT query_id) AS n_queries FROM j GROUP BY domain)
SELECT *, round(n_citations / sum(n_citations) OVER (), 6) AS share FROM g"""


def source_table(cited: DataFrame) -> DataFrame:
    """domain, counts, sorted distinct sets and the share of all citations."""
    out = cited.groupBy("domain").agg(F.count(F.lit(1)).alias("n_citations"), F.count_distinct("sample_id").alias("n_samples"), F.bool_or(domain_matches(F.col("domain"), F.lit("example.com"))).alias("is_brand"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.count_distinct("query_id").alias("n_queries"))
    total = out.agg(F.sum("n_citations").alias("total"))  # one row, rather than a window over all domains in one task
    return out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n_citations") / F.col("total"), 6)).drop("total")


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations(spark, sf_dir).join(responses(spark, sf_dir).drop("text"), "sample_id")


@query("source_domains", SOURCE_SQL)
def source_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_table(cited_answers(spark, sf_dir))


@query("top_sources", SOURCE_SQL + " ORDER BY n_citations DESC, domain LIMIT 10")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten domains most cited."""
    return source_domains(spark, sf_dir).orderBy(F.desc("n_citations"), in_locale(F.col("domain")), "domain").limit(10)


@query("source_queries", f"WITH {CITATION_SQL}, {RESPONSE_SQL}, q AS (SELECT DISTINCT domain, query_id FROM cit JOIN resp USING (sample_id)), g AS (SELECT domain, list(query_id ORDER BY query_id) AS qs FROM q GROUP BY domain) SELECT domain, array_to_string(qs[1:3], ',') AS shown, greatest(0, len(qs) - 3)::INT AS more FROM g")
def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three queries of a domain, and how many more there are."""
    qs = cited_answers(spark, sf_dir).groupBy("domain").agg(F.array_sort(F.collect_set("query_id")).alias("qs"))
    return qs.select("domain", F.array_join(F.slice("qs", 1, 3).cast("array<string>"), ",").alias("shown"), F.greatest(F.lit(0), F.size("qs") - 3).alias("more"))
