"""Stored vendor payloads to sources and usage, by declared engine or by the shape that they have."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.urls import first_by_url, last_by_url, text_urls
from lumenspan.queries import query
from lumenspan.sources.tables import ENGINES, read

PAGE = "array<struct<url:string,title:string>>"
SCHEMAS = {
    "openai": f"output array<struct<content:array<struct<annotations:array<struct<type:string,url:string,title:string>>>>>>",
    "claude": f"content array<struct<type:string,citations:{PAGE},content:{PAGE}>>",
    "gemini": "candidates array<struct<groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>>>",
    "perplexity": f"search_results {PAGE}, citations array<string>, choices array<string>",
    "mock": "sources array<string>",
}
ROOT = {"openai": "output", "claude": "content", "gemini": "candidates", "perplexity": "search_results", "mock": "sources"}


def _flat(x: Column, part) -> Column:
    return F.flatten(F.transform(x, lambda v: F.coalesce(part(v), F.array().cast(PAGE))))


def _page(x: Column) -> Column:
    return F.struct(x["url"].alias("url"), x["title"].alias("title"))


def native_sources(engine: str, payload: Column) -> Column:
    """array<struct<url, title, kind>>, each address once: at its first place, with its last title. A payload without the vendor's shape is
    an error, never an answer without sources."""
    p = F.from_json(payload, SCHEMAS[engine])
    known = p[ROOT[engine]].isNotNull() if engine != "perplexity" else F.coalesce(p["search_results"].isNotNull() | p["citations"].isNotNull() | p["choices"].isNotNull(), F.lit(False))
    return F.when(known, sources_in(engine, p)).otherwise(F.raise_error(F.lit(f"no {engine} payload")))


def sources_in(engine: str, p: Column) -> Column:
    """The same of a payload read as a struct of the vendor's schema."""
    if engine == "openai":
        marks = lambda c: F.transform(F.filter(c["annotations"], lambda a: a["type"] == "url_citation"), _page)
        pages = _flat(p["output"], lambda o: _flat(o["content"], marks))
    elif engine == "claude":
        pages = _flat(p["content"], lambda b: F.concat(F.coalesce(F.transform(b["citations"], _page), F.array().cast(PAGE)), F.coalesce(F.when(b["type"] == "web_search_tool_result", F.transform(b["content"], _page)), F.array().cast(PAGE))))
    elif engine == "gemini":
        pages = _flat(p["candidates"], lambda c: F.transform(c["groundingMetadata"]["groundingChunks"], lambda g: F.struct(g["web"]["uri"].alias("url"), g["web"]["title"].alias("title"))))
    else:
        bare = lambda x: F.transform(x, lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title")))
        pages = F.when(F.size(p["search_results"]) > 0, F.transform(p["search_results"], _page)).otherwise(bare(p["citations"])) if engine == "perplexity" else bare(p["sources"])
    pages = F.filter(F.coalesce(pages, F.array().cast(PAGE)), lambda x: F.coalesce(x["url"] != "", F.lit(False)))
    sources = F.transform(pages, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), F.lit("NATIVE").alias("kind")))
    return last_by_url(sources)


#: By which field, and of which type, a payload shows its vendor; the first that is there counts.
SHAPES = [("openai", "output", "array<variant>"), ("gemini", "candidates", "array<variant>"), ("claude", "content", "array<variant>"), ("perplexity", "search_results", "array<variant>"), ("perplexity", "citations", "array<variant>"), ("perplexity", "choices", "array<variant>"), ("mock", "sources", "array<variant>")]


def sniffed(payloads: DataFrame) -> DataFrame:
    """payloads (payload, ...) of mixed vendors with vendor, sources and - where there is no vendor - fault: `malformed` for what is no JSON, else
    `unknown shape` with the shape. One parse, one pass, no error: what has a fault is for a quarantine."""
    v = F.col("v")
    vendor = F.coalesce(*[F.when(F.try_variant_get(v, f"$.{field}", kind).isNotNull(), name) for name, field, kind in SHAPES])
    fault = F.when(v.isNull(), "malformed").when(F.col("vendor").isNull(), F.concat(F.lit("unknown shape "), F.schema_of_variant(v)))
    found = F.coalesce(*[F.when(F.col("vendor") == e, sources_in(e, F.try_variant_get(v, "$", "struct<" + _as_fields(SCHEMAS[e]) + ">"))) for e in SCHEMAS])
    return payloads.withColumn("v", F.try_parse_json("payload")).withColumn("vendor", vendor).withColumns({"sources": found, "fault": fault}).drop("v")


def _as_fields(schema: str) -> str:
    """`a t, b u` as the fields of a struct type."""
    depth, out = 0, []
    for part in schema.split(", "):
        if depth == 0:
            name, kind = part.split(" ", 1)
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


def merged_sources(native: Column, text: Column) -> Column:
    """The engine's own sources, then those of the text, each address once."""
    return first_by_url(F.concat(native, text_urls(text)))


def truncated(engine: str, reason: Column) -> Column:
    """Whether the vendor stopped for length."""
    marks = {"openai": reason.contains("max_output_tokens"), "claude": reason == "max_tokens", "gemini": reason == "MAX_TOKENS", "perplexity": reason == "length"}
    return F.coalesce(marks.get(engine, F.lit(False)), F.lit(False))


def usage(payload: Column, path: str) -> Column:
    """A finite count or null."""
    n = F.get_json_object(payload, path).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")), n)


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of each vendor's shape for each page: the page, then the page again under another title."""
    url, title = F.col("url"), F.concat(F.lit("p"), F.col("page_id").cast("string"))
    page = lambda t: F.struct(F.lit("url_citation").alias("type"), url.alias("url"), t.alias("title"))
    twice = F.array(page(F.lit("first")), page(title))
    web = F.transform(twice, lambda x: F.struct(F.struct(x["url"].alias("uri"), x["title"].alias("title")).alias("web")))
    made = {
        "openai": F.struct(F.array(F.struct(F.array(F.struct(twice.alias("annotations"))).alias("content"))).alias("output")),
        "claude": F.struct(F.array(F.struct(F.lit("web_search_tool_result").alias("type"), twice.alias("content"))).alias("content")),
        "gemini": F.struct(F.array(F.struct(F.struct(web.alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")),
        "perplexity": F.struct(twice.alias("search_results")),
        "mock": F.struct(F.array(url, url).alias("sources")),
    }
    engine = F.element_at(F.array(*[F.lit(e) for e in ENGINES]), (F.col("page_id") % 5 + 1).cast("int"))
    payload = F.coalesce(*[F.when(engine == e, F.to_json(v)) for e, v in made.items()])
    return read(spark, sf_dir, "pages").select("page_id", "url", engine.alias("engine"), payload.alias("payload"))


@query("payload_sources", f"SELECT page_id, list_extract({ENGINES!r}, CAST(page_id % 5 + 1 AS INT)) AS engine, 1 AS n_sources, url, CASE WHEN page_id % 5 = 4 THEN NULL ELSE 'p' || page_id END AS title FROM pages")
def payload_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_payloads(spark, sf_dir)
    found = F.coalesce(*[F.when(F.col("engine") == e, native_sources(e, F.col("payload"))) for e in ENGINES])
    out = stored.select("page_id", "engine", found.alias("s"))
    return out.select("page_id", "engine", F.size("s").alias("n_sources"), F.col("s")[0]["url"].alias("url"), F.col("s")[0]["title"].alias("title"))


def damaged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads, some cut off, some of older shapes."""
    page, body = F.col("page_id"), F.col("payload")
    broken = F.when(page % 11 == 0, F.substring(body, F.lit(1), F.char_length(body) - 3)).when(page % 13 == 0, '{"legacy": 1}').when(page % 17 == 0, '["x"]').when(page % 19 == 0, '{"output": "text"}')
    return stored_payloads(spark, sf_dir).withColumn("payload", F.coalesce(broken, body))


FAULT_SQL = """CASE WHEN page_id % 11 = 0 THEN 'malformed' WHEN page_id % 13 = 0 THEN 'unknown shape OBJECT<legacy: BIGINT>' WHEN page_id % 17 = 0 THEN 'unknown shape ARRAY<STRING>' WHEN page_id % 19 = 0 THEN 'unknown shape OBJECT<output: STRING>' END"""


@query("payload_quarantine", f"SELECT page_id, {FAULT_SQL} AS fault FROM pages WHERE {FAULT_SQL} IS NOT NULL")
def payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniffed(damaged_payloads(spark, sf_dir)).where("fault IS NOT NULL").select("page_id", "fault")


@query("payload_vendors", f"SELECT page_id, list_extract({ENGINES!r}, CAST(page_id % 5 + 1 AS INT)) AS vendor, url, CASE WHEN page_id % 5 = 4 THEN NULL ELSE 'p' || page_id END AS title FROM pages WHERE {FAULT_SQL} IS NULL")
def payload_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of payloads whose vendors are told by their shapes."""
    told = sniffed(damaged_payloads(spark, sf_dir).drop("engine", "url")).where("fault IS NULL")
    return told.select("page_id", "vendor", F.explode("sources").alias("s")).select("page_id", "vendor", "s.url", "s.title")


@query("source_merge", "SELECT page_id, 2 AS n_sources, 'NATIVE,INLINE_MARKDOWN' AS kinds FROM pages")
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native source, the same as a link in the text, and another link."""
    native = F.array(F.struct(F.col("url"), F.lit(None).cast("string").alias("title"), F.lit("NATIVE").alias("kind")))
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and [x]("), F.col("url"), F.lit("&more=1)"))
    out = read(spark, sf_dir, "pages").select("page_id", merged_sources(native, text).alias("s"))
    return out.select("page_id", F.size("s").alias("n_sources"), F.array_join(F.transform("s", lambda x: x["kind"]), ",").alias("kinds"))


@query("truncation", "SELECT event_type, count_if(event_id % 7 = 0)::BIGINT AS cut, count_if(event_id % 7 <> 0)::BIGINT AS whole, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS tokens FROM events GROUP BY event_type")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("event_id") % 7 == 0, "max_tokens").otherwise("end_turn")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(truncated("claude", reason)).alias("cut"), F.count_if(~truncated("claude", reason)).alias("whole"), F.sum(usage(F.col("props"), "$.k")).alias("tokens"))


#: HTTP status to error, and the errors worth another try.
HTTP_ERRORS = {401: "AUTH", 403: "AUTH", 404: "MODEL_NOT_FOUND", 408: "TIMEOUT", 429: "RATE_LIMIT"}
RETRYABLE = ["RATE_LIMIT", "SERVER", "TIMEOUT", "NETWORK"]


#: Codes of the database client to error; clients that are of no use any more are SERVER.
DATABASE_ERRORS = {"P1001": "NETWORK", "P1002": "NETWORK", "P1008": "NETWORK", "P1017": "NETWORK", "P2024": "TIMEOUT", "P2028": "SERVER", "P2034": "SERVER"}


def error_of(status: Column, of_model: bool = True) -> Column:
    """The error of an HTTP status; a 404 is a model's only where one was asked for."""
    c = F.when(F.lit(False), "")
    for code, name in HTTP_ERRORS.items():
        c = c.when(status == code, name if of_model or code != 404 else "BAD_REQUEST")
    return c.when(status >= 500, "SERVER").when(status >= 400, "BAD_REQUEST").otherwise("UNKNOWN")


def error_of_database(code: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in DATABASE_ERRORS.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, code), F.lit("UNKNOWN"))


@query("database_errors", "WITH c AS (SELECT list_extract(['P1001', 'P2024', 'P2034', 'P2002', NULL], CAST(event_id % 5 + 1 AS INT)) AS code FROM events) SELECT CASE code WHEN 'P1001' THEN 'NETWORK' WHEN 'P2024' THEN 'TIMEOUT' WHEN 'P2034' THEN 'SERVER' ELSE 'UNKNOWN' END AS error, coalesce(code IN ('P1001', 'P2024', 'P2034'), false) AS retryable, count(*) AS n FROM c GROUP BY ALL")
def database_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later attempt can clear, and what it can't."""
    code = F.element_at(F.array(*[F.lit(x) for x in ("P1001", "P2024", "P2034", "P2002", None)]), (F.col("event_id") % 5 + 1).cast("int"))
    failed = read(spark, sf_dir, "events").select(error_of_database(code).alias("error"))
    return failed.groupBy("error", F.col("error").isin(RETRYABLE).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query("error_taxonomy", "WITH s AS (SELECT list_extract([401, 403, 404, 408, 429, 500, 503, 400], CAST(event_id % 8 + 1 AS INT)) AS status FROM events WHERE event_type = 'error'), e AS (SELECT status, CASE WHEN status IN (401, 403) THEN 'AUTH' WHEN status = 404 THEN 'MODEL_NOT_FOUND' WHEN status = 408 THEN 'TIMEOUT' WHEN status = 429 THEN 'RATE_LIMIT' WHEN status >= 500 THEN 'SERVER' ELSE 'BAD_REQUEST' END AS error FROM s) SELECT error, error IN ('RATE_LIMIT', 'SERVER', 'TIMEOUT', 'NETWORK') AS retryable, count(*) AS n FROM e GROUP BY ALL")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (401, 403, 404, 408, 429, 500, 503, 400)]), (F.col("event_id") % 8 + 1).cast("int"))
    failed = read(spark, sf_dir, "events").where("event_type = 'error'").select(error_of(status).alias("error"))
    return failed.groupBy("error", F.col("error").isin(RETRYABLE).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))
