"""Smaller queries of the read side: excerpts, snapshots, trees, backfills, checks of input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions.selection import robust
from lumenspan.functions.stats import LOW_N_TASK, exact_mean, exact_mean_sql, ratio, stability_v2
from lumenspan.functions.urls import normalized_url
from lumenspan.operators.sources_report import NORM_SQL, SOURCE_SQL, cited_answers, source_domains
from lumenspan.queries import query
from lumenspan.sources.tables import CITATION_SQL, ENTITY_SQL, MENTION_SQL, OBS_SQL, RESPONSE_SQL, citations, completed, entities, mentions, observations, read, responses

EXCERPT = 4000


def excerpt(text: Column, limit: int = EXCERPT) -> tuple[Column, Column]:
    """The first UTF-16 units of a text, and whether there are more; a character that would be cut in half is left out."""
    units = F.encode(text, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * limit - 1, 1)).rlike("^D[89AB]")
    head = F.decode(F.substring(units, F.lit(1), F.lit(2 * limit) - F.when(half, 2).otherwise(0)), "UTF-16BE")
    more = F.octet_length(units) > 2 * limit
    return F.when(more, head).otherwise(text), more


@query("answer_excerpt", f"WITH {RESPONSE_SQL} SELECT sample_id, substring(text, 1, {EXCERPT}) AS excerpt, length(text) > {EXCERPT} AS cut FROM resp")
def answer_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of an answer for display, and whether there is more."""
    head, more = excerpt(F.col("text"))
    return responses(spark, sf_dir).select("sample_id", head.alias("excerpt"), more.alias("cut"))


@query("mention_names", f"WITH {MENTION_SQL} SELECT sample_id, entity_id, coalesce(CASE WHEN entity_id <> 'c3' THEN name END, 'unknown ' || entity_id) AS name, count(*) AS n FROM (SELECT * FROM mention WHERE kind = 'BRAND' UNION ALL SELECT * FROM mention WHERE kind <> 'BRAND') LEFT JOIN ent USING (entity_id) GROUP BY ALL")
def mention_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of mention with the names of the run's snapshot; an entity that it lacks keeps a placeholder."""
    found = mentions(spark, sf_dir)
    both = found.where("kind = 'BRAND'").unionByName(found.where("kind <> 'BRAND'"))
    snapshot = entities(spark).where("entity_id <> 'c3'").select("entity_id", "name")
    named = both.join(F.broadcast(snapshot), "entity_id", "left")  # a constant of a few rows
    return named.groupBy("sample_id", "entity_id", F.coalesce("name", F.concat(F.lit("unknown "), "entity_id")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("run_tree", f"WITH {MENTION_SQL}, s AS (SELECT sample_id, string_agg(entity_id || '@' || tok_at, ' ' ORDER BY tok_at, entity_id) AS m FROM mention GROUP BY ALL) SELECT run_id, task_id, count(*) AS samples, string_agg(sample_id || '[' || coalesce(m, '') || ']', ' ' ORDER BY sample_id) AS tree FROM resp LEFT JOIN s USING (sample_id) GROUP BY ALL")
def run_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run, task, samples, mentions, nested."""
    leaf = F.transform(F.array_sort(F.collect_list(F.struct("tok_at", "entity_id"))), lambda m: F.concat(m["entity_id"], F.lit("@"), m["tok_at"].cast("string")))
    per = mentions(spark, sf_dir).groupBy("sample_id").agg(F.array_join(leaf, " ").alias("m"))
    rows = responses(spark, sf_dir).drop("text").join(per, "sample_id", "left")
    node = F.transform(F.array_sort(F.collect_list(F.struct("sample_id", F.coalesce("m", F.lit("")).alias("m")))), lambda s: F.concat(s["sample_id"].cast("string"), F.lit("["), s["m"], F.lit("]")))
    return rows.groupBy("run_id", "task_id").agg(F.count(F.lit(1)).alias("samples"), F.array_join(node, " ").alias("tree"))


@query("snapshot_backfill", "SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), 'none') AS first_text, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def snapshot_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first text by order, else a default, and an ordered collection."""
    c = read(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"]))
    return c.groupBy("conv_id").agg(F.coalesce(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.lit("none")).alias("first_text"), F.array_join(turns, ",").alias("turns"))


@query("correlated_backfill", """SELECT c_custkey, coalesce((SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1), -c_custkey) AS first_order,
  coalesce((SELECT string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM orders o WHERE o_custkey = c_custkey AND o_orderkey <> (SELECT p.o_orderkey FROM orders p WHERE p.o_custkey = c_custkey ORDER BY p.o_orderdate, p.o_orderkey LIMIT 1)), '') AS others FROM customer""")
def correlated_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value by order out of a second table, with a fallback, and the ids that are left once it is taken out."""
    of = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by(of, F.struct("o_orderdate", "o_orderkey")).alias("first"), F.array_sort(F.collect_list(of)).alias("ids"))
    out = read(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    others = F.array_join(F.array_remove("ids", F.col("first")).cast("array<string>"), ",")
    return out.select("c_custkey", F.coalesce("first", -F.col("c_custkey")).alias("first_order"), F.coalesce(others, F.lit("")).alias("others"))


@query("distinct_citations", f"WITH {CITATION_SQL}, n AS (SELECT sample_id, page_id, {NORM_SQL} AS nurl, url FROM cit), f AS (SELECT sample_id, url, min(page_id) AS page_id FROM n GROUP BY ALL) SELECT sample_id, string_agg(url, ' | ' ORDER BY page_id) AS urls FROM f GROUP BY sample_id")
def distinct_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited addresses in order of first appearance, each once."""
    rows = F.array_sort(F.collect_list(F.struct("page_id", normalized_url(F.col("url")).alias("nurl"), "url")))
    out = citations(spark, sf_dir).groupBy("sample_id").agg(F.array_distinct(F.transform(rows, lambda r: r["url"])).alias("u"))
    return out.select("sample_id", F.array_join("u", " | ").alias("urls"))


@query("distinct_errors", "WITH e AS (SELECT user_id % 10 AS run_id, event_type || ' : k=' || json_extract_string(props, '$.k') AS message, min(event_id) AS first_id FROM events WHERE event_type = 'error' GROUP BY ALL) SELECT run_id, count(*) AS messages, arg_min(message, first_id) AS first_message FROM e GROUP BY run_id")
def distinct_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages of a run, and the one seen first."""
    message = F.concat(F.col("event_type"), F.lit(" : k="), F.get_json_object("props", "$.k"))
    seen = read(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 10).alias("run_id"), message.alias("message")).agg(F.min("event_id").alias("first_id"))
    return seen.groupBy("run_id").agg(F.count(F.lit(1)).alias("messages"), F.min_by("message", "first_id").alias("first_message"))


@query("query_rows", f"WITH {CITATION_SQL}, {RESPONSE_SQL}, s AS (SELECT sample_id, count(*) AS n FROM cit GROUP BY ALL) SELECT query_id, count(*) AS raw_n, round(coalesce(sum(s.n), 0) / count(*), 6) AS avg_citations, round(count_if(coalesce(s.n, 0) > 0) / count(*), 6) AS cited_rate FROM resp LEFT JOIN s USING (sample_id) GROUP BY query_id")
def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by answer, averaged over a query's answers with those that cite nothing."""
    per = citations(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    out = responses(spark, sf_dir).drop("text").join(per, "sample_id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("raw_n"), F.coalesce(F.sum("n"), F.lit(0)).alias("cited"), F.count_if(F.col("n") > 0).alias("with"))
    return out.select("query_id", "raw_n", F.round(ratio(F.col("cited"), F.col("raw_n")), 6).alias("avg_citations"), F.round(ratio(F.col("with"), F.col("raw_n")), 6).alias("cited_rate"))


@query("share_scale", f"WITH s AS ({SOURCE_SQL}) SELECT domain, round(n_citations / max(n_citations) OVER (), 6) AS bar FROM s")
def share_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars against the longest."""
    s = source_domains(spark, sf_dir)
    most = s.agg(F.max("n_citations").alias("most"))  # one row
    return s.crossJoin(F.broadcast(most)).select("domain", F.round(F.col("n_citations") / F.col("most"), 6).alias("bar"))


@query("pooled_summary", f"WITH {OBS_SQL}, g AS (SELECT provider, count(*) AS n, {exact_mean_sql("score")} AS mean, quantile_cont(score, 0.5) AS median, mad(score) AS mad, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM done GROUP BY provider) SELECT provider, n, round(mean, 6) AS mean, round(median, 6) AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr, round(least(1.0, greatest(0.0, 1 - 1.4826 * mad / 25.0)), 6) AS stability, n < {LOW_N_TASK} AS low_n FROM g")
def pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older summary over pooled samples, with the older stability."""
    done = completed(spark, sf_dir)
    g = done.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("score")).alias("mean"))
    spread = robust(done, ["provider"], "score").select("provider", "median", "mad", (F.col("q3") - F.col("q1")).alias("iqr"))  # an engine has any number of samples
    r = lambda c: F.round(c, 6).alias(c)
    return g.join(spread, "provider").select("provider", "n", r("mean"), r("median"), r("mad"), r("iqr"), F.round(stability_v2(F.col("mad")), 6).alias("stability"), (F.col("n") < LOW_N_TASK).alias("low_n"))


def judge_input(text: Column) -> Column:
    """White space made one, cut to 400 characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 400)


@query("judge_inputs", f"WITH {RESPONSE_SQL} SELECT sample_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400) AS context FROM resp")
def judge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("sample_id", judge_input(F.col("text")).alias("context"))


VERDICTS = "array<struct<id:int,sentiment:string,score:double>>"


def recovered_array(reply: Column) -> Column:
    """The JSON array of a reply, whatever stands around it; null if there is none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), VERDICTS)


@query("reply_recovery", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 100 END AS id, CASE WHEN event_id % 4 <> 3 THEN 'NEUTRAL' END AS sentiment FROM events")
def reply_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in fences, with talk around them, plain, and without an array."""
    e = F.col("event_id")
    body = F.concat(F.lit('[{"id":'), (e % 100).cast("string"), F.lit(',"sentiment":"NEUTRAL","score":0.5}]'))
    reply = F.when(e % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(e % 4 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(e % 4 == 2, body).otherwise("none")
    got = recovered_array(reply)[0]
    return read(spark, sf_dir, "events").select("event_id", got["id"].cast("long").alias("id"), got["sentiment"].alias("sentiment"))


@query("input_checks", r"SELECT page_id, regexp_matches(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$') AS domain_ok, regexp_matches(regexp_extract(url, '/([a-z]{2})/', 1), '^[a-z]{2}$') AS language_ok FROM pages")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain's shape and an ISO language code."""
    host, lang = F.regexp_extract("url", "^https?://([^/:?#]+)", 1), F.regexp_extract("url", "/([a-z]{2})/", 1)
    return read(spark, sf_dir, "pages").select("page_id", host.rlike(r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$").alias("domain_ok"), lang.rlike("^[a-z]{2}$").alias("language_ok"))


def client_address(forwarded: Column, hops: int) -> Column:
    """The address that stands `hops` from the right; null if there are fewer."""
    parts = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) >= hops, F.element_at(parts, -hops))


@query("throttle_keys", "SELECT CASE WHEN event_type = 'signup' THEN 'register:10.0.' || user_id % 8 || '.1' ELSE 'launch:' || user_id END AS throttle_key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS calls, count(*) <= 20 AS admitted FROM events GROUP BY ALL")
def throttle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations by client address, launches by user, against twenty an hour."""
    address = client_address(F.concat(F.lit("8.8.8.8, 10.0."), (F.col("user_id") % 8).cast("string"), F.lit(".1, 192.168.0.1")), 2)
    key = F.when(F.col("event_type") == "signup", F.concat(F.lit("register:"), address)).otherwise(F.concat(F.lit("launch:"), F.col("user_id").cast("string")))
    out = read(spark, sf_dir, "events").groupBy(key.alias("throttle_key"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("calls"))
    return out.withColumn("admitted", F.col("calls") <= 20)


@query("provider_score_cells", f"WITH {OBS_SQL} SELECT run_id, query_id, provider, mode, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, provider, mode ORDER BY sample_id) AS rank FROM done) WHERE rank = 1")
def provider_score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first score of each cell: malformed repeats don't blend."""
    first = Window.partitionBy("run_id", "query_id", "provider", "mode").orderBy("sample_id")
    return completed(spark, sf_dir).withColumn("rank", F.row_number().over(first).cast("long")).where("rank = 1").select("run_id", "query_id", "provider", "mode", "score", "rank")


@query("citation_audit", f"WITH {CITATION_SQL}, {RESPONSE_SQL} SELECT mode, domain, count(*) AS n FROM cit JOIN resp USING (sample_id) WHERE mode IS NOT NULL GROUP BY ALL")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited_answers(spark, sf_dir).groupBy("mode", "domain").agg(F.count(F.lit(1)).alias("n"))


@query("user_activity", f"WITH {OBS_SQL} SELECT query_id, count(*) AS calls, count(*) FILTER (status = 'COMPLETED') AS done FROM obs GROUP BY query_id HAVING count(*) > 10")
def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "COMPLETED").alias("done")).where("calls > 10")
