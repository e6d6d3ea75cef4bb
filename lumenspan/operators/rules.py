"""Versioned additive scoring of an answer, as columns over its mentions and citations.

A feature row has mode, mentions array<struct<entity_id, kind, mention_type, char_offset, normalized_position, in_first_sentence, order_rank,
sentiment>> and citations array<struct<source_kind, is_brand_domain>>; kind is BRAND or COMPETITOR.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.stats import clamp
from lumenspan.operators.evidence import SEVERITY, ranked
from lumenspan.queries import query
from lumenspan.sources.tables import CITATION_SQL, MENTION_SQL, citations, mentions, responses

#: The rules' weights, the presence of each kind of match, points of verdicts, and other constants of versions 2 and 3.
WEIGHTS = {"presence": 35.0, "prominence": 15.0, "frequency": 10.0, "shareOfVoice": 20.0, "citation": 15.0, "sentiment": -10.0, "competitorLead": -8.0}
PRESENCE = {"EXACT": 1.0, "ALIAS": 0.85, "DOMAIN": 0.7, "APPROXIMATE": 0.35}
POINTS = {"POSITIVE": 5.0, "NEUTRAL": 0.0, "MIXED": -2.0, "NEGATIVE": -10.0}
POSITION_WEIGHT, RANK_WEIGHT, SATURATION, CITATION_TARGET = 0.6, 0.4, 6.0, 2.0
SHARED_OUT = ["presence", "prominence", "frequency", "shareOfVoice"]
FACTOR = 95.0 / 80.0
VERSIONS = ("v2", "v3")


def _pick(x: Column, table: dict[str, float]) -> Column:
    return reduce(lambda c, kv: c.when(x == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(x == next(iter(table)), F.lit(next(iter(table.values())))))


def _said(mentions: str, sentiment: str) -> Column:
    return F.size(F.filter(mentions, lambda m: m["sentiment"] == sentiment))


def scored(features: DataFrame, version: str = "v3") -> DataFrame:
    """features with score, brand_present, brand_order_rank, brand_occurrences, competitor_count, citation_count, brand_domain_cited,
    share_of_voice and contributions array<struct<rule_id, weight, raw_value, contribution, applicable, redistributed>>."""
    if version not in VERSIONS:
        raise ValueError(f"unknown scoring version {version}")
    strict = version == "v3"
    brand = F.filter("mentions", lambda m: m["kind"] == "BRAND")
    rival = F.filter("mentions", lambda m: m["kind"] != "BRAND")
    counted = F.filter("citations", lambda c: c["source_kind"] == "NATIVE") if strict else F.col("citations")
    out = features.withColumns({"__brand": brand, "__rival": rival, "__cited": counted})
    spelled = F.exists("__brand", lambda m: m["mention_type"] != "APPROXIMATE") if strict else F.size("__brand") > 0
    tiers = F.transform("__brand", lambda m: _pick(m["mention_type"], PRESENCE))
    first = F.array_min(F.transform("__brand", lambda m: F.struct(m["char_offset"].alias("o"), m["normalized_position"].alias("p"), m["in_first_sentence"].alias("s"))))
    # the first mention of each rival is the one of the least rank
    rivals = F.array_distinct(F.transform("__rival", lambda m: m["entity_id"]))
    led = lambda rank: F.array_distinct(F.transform(F.filter("__rival", lambda m: m["order_rank"] < rank), lambda m: m["entity_id"]))
    counts = F.array(*[F.struct(_said("__brand", s).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEVERITY)])
    out = out.withColumns({
        "brand_present": spelled, "brand_occurrences": F.size("__brand"), "competitor_count": F.size(rivals), "citation_count": F.size("citations"),
        "brand_domain_cited": F.exists("__cited", lambda c: c["is_brand_domain"]), "__tier": F.coalesce(F.array_max(tiers), F.lit(0.0)), "__first": first,
        "__rank": F.array_min(F.transform("__brand", lambda m: m["order_rank"])), "__verdict": F.array_max(counts),
        "__owned": F.size(F.filter("__cited", lambda c: c["is_brand_domain"])),
    })
    present = F.col("brand_present")
    out = out.withColumns({"brand_order_rank": F.when(present, F.col("__rank")), "share_of_voice": (F.col("brand_occurrences") + 1) / (F.col("brand_occurrences") + F.size("__rival") + 2)})
    cites = present & (F.col("mode") == "GROUNDED") & (F.size("__cited") > 0)
    judged = present & (F.col("__verdict")["n"] > 0)
    leaders = F.size(led(F.coalesce(F.col("brand_order_rank"), F.lit(2**31 - 1))))
    near = 1 - clamp(F.col("__first")["p"])
    rank = F.when(F.col("__first")["s"], F.lit(1.0)).otherwise(1 / (1 + F.greatest(F.lit(0), F.col("brand_order_rank"))))
    raw = {
        "presence": (F.col("__tier"), present),
        "prominence": (clamp(POSITION_WEIGHT * near + RANK_WEIGHT * rank), present),
        "frequency": (F.least(F.lit(1.0), F.log1p("brand_occurrences") / F.log(F.lit(SATURATION))), present),
        "shareOfVoice": (F.col("share_of_voice"), F.lit(True)),
        "citation": (F.least(F.lit(1.0), F.col("__owned") / CITATION_TARGET), cites),
        "sentiment": (_pick(F.col("__verdict")["s"], POINTS) / abs(WEIGHTS["sentiment"]), judged),
        "competitorLead": (F.when(F.col("competitor_count") > 0, -leaders / F.col("competitor_count")).otherwise(F.lit(0.0)), F.lit(True)),
    }
    parts = []
    for rule, (value, applies) in raw.items():
        value = F.when(applies, value).otherwise(F.lit(0.0)) + 0.0
        again = present & ~cites if rule in SHARED_OUT else F.lit(False)
        parts.append(F.struct(F.lit(rule).alias("rule_id"), F.lit(WEIGHTS[rule]).alias("weight"), value.alias("raw_value"), (abs(WEIGHTS[rule]) * value * F.when(again, FACTOR).otherwise(1.0)).alias("contribution"), applies.alias("applicable"), again.alias("redistributed")))
    out = out.withColumn("contributions", F.array(*parts))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    return out.withColumn("score", clamp(total, 0.0, 100.0)).drop(*[c for c in out.columns if c.startswith("__")])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of the stored answers. Offsets are token positions here; every fourth mention is taken for a near spelling."""
    answers = responses(spark, sf_dir).withColumn("n_tokens", F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).drop("text")
    found = mentions(spark, sf_dir)
    ranks = ranked(found).select("sample_id", "entity_id", "order_rank")
    rows = found.join(ranks, ["sample_id", "entity_id"]).join(answers.select("sample_id", "n_tokens"), "sample_id")
    kind = F.when(F.col("tok_at") % 4 == 3, "APPROXIMATE").otherwise(F.col("mention_type"))
    verdict = F.when(F.col("tok_at") % 5 < 4, F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), (F.col("tok_at") % 5 % 4 + 1).cast("int")))
    mention = F.struct(F.col("tok_at").alias("char_offset"), "entity_id", "kind", kind.alias("mention_type"), (F.col("tok_at") / F.col("n_tokens")).alias("normalized_position"), (F.col("tok_at") < 5).alias("in_first_sentence"), "order_rank", verdict.alias("sentiment"))
    per = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(mention)).alias("mentions"))
    cited = citations(spark, sf_dir).groupBy("sample_id").agg(F.collect_list(F.struct("source_kind", (F.col("domain").endswith(".example.com") | (F.col("domain") == "example.com")).alias("is_brand_domain"))).alias("citations"))
    out = answers.join(per, "sample_id", "left").join(cited, "sample_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("mentions", "citations")})


def score_sql(version: str) -> str:
    strict = version == "v3"
    cited = "n_native" if strict else "n_cited"
    owned = "own_native" if strict else "own_cited"
    return f"""WITH {MENTION_SQL}, {CITATION_SQL}, len AS (SELECT sample_id, count(*) AS n_tokens FROM tok GROUP BY ALL), fr AS (
  SELECT sample_id, entity_id, row_number() OVER (PARTITION BY sample_id ORDER BY min(tok_at), entity_id) - 1 AS order_rank FROM mention GROUP BY sample_id, entity_id), m AS (
  SELECT mention.*, order_rank, CASE WHEN tok_at % 4 = 3 THEN 'APPROXIMATE' ELSE mention_type END AS mt, tok_at / n_tokens AS pos, tok_at < 5 AS fs,
         CASE WHEN tok_at % 5 < 4 THEN tok_at % 5 % 4 END AS sev FROM mention JOIN fr USING (sample_id, entity_id) JOIN len USING (sample_id)), b AS (
  SELECT sample_id, count(*) AS occ, bool_or(mt <> 'APPROXIMATE') AS spelled, max(CASE mt WHEN 'EXACT' THEN 1.0 WHEN 'ALIAS' THEN 0.85 WHEN 'DOMAIN' THEN 0.7 ELSE 0.35 END) AS tier,
         arg_min(pos, tok_at) AS pos, arg_min(fs, tok_at) AS fs, min(order_rank) AS rank FROM m WHERE kind = 'BRAND' GROUP BY ALL), sc AS (
  SELECT sample_id, sev, count(*) AS n FROM m WHERE kind = 'BRAND' AND sev IS NOT NULL GROUP BY ALL), sv AS (SELECT sample_id, arg_max(sev, n * 10 + sev) AS sev FROM sc GROUP BY ALL), cp AS (
  SELECT sample_id, count(*) AS n_rival, count(DISTINCT entity_id) AS rivals FROM m WHERE kind <> 'BRAND' GROUP BY ALL), ld AS (
  SELECT m.sample_id, count(DISTINCT m.entity_id) AS leaders FROM m LEFT JOIN b ON b.sample_id = m.sample_id AND {"b.spelled" if strict else "b.occ > 0"} WHERE m.kind <> 'BRAND' AND m.order_rank < coalesce(b.rank, 2147483647) GROUP BY ALL), c AS (
  SELECT sample_id, count(*) AS n_cited, count_if(source_kind = 'NATIVE') AS n_native, count_if(brand) AS own_cited, count_if(brand AND source_kind = 'NATIVE') AS own_native
  FROM (SELECT *, domain = 'example.com' OR ends_with(domain, '.example.com') AS brand FROM cit) GROUP BY ALL), x AS (
  SELECT resp.sample_id, mode, coalesce({"spelled" if strict else "occ > 0"}, false) AS present, coalesce(occ, 0) AS occ, coalesce(tier, 0) AS tier, pos, fs, rank, sev, coalesce(n_rival, 0) AS n_rival, coalesce(rivals, 0) AS rivals,
         coalesce(leaders, 0) AS leaders, coalesce(n_cited, 0) AS n_cited, coalesce({cited}, 0) AS counted, coalesce({owned}, 0) AS owned
  FROM resp LEFT JOIN b USING (sample_id) LEFT JOIN sv USING (sample_id) LEFT JOIN cp USING (sample_id) LEFT JOIN ld USING (sample_id) LEFT JOIN c USING (sample_id)), y AS (
  SELECT *, present AND mode = 'GROUNDED' AND counted > 0 AS cites, CASE WHEN present AND NOT (mode = 'GROUNDED' AND counted > 0) THEN 1.1875 ELSE 1.0 END AS factor, (occ + 1) / (occ + n_rival + 2) AS sov FROM x), z AS (
  SELECT *, CASE WHEN present THEN 35.0 * tier * factor ELSE 0 END AS presence,
         CASE WHEN present THEN 15.0 * factor * least(1.0, greatest(0.0, 0.6 * (1 - pos) + 0.4 * CASE WHEN fs THEN 1.0 ELSE 1.0 / (1 + rank) END)) ELSE 0 END AS prominence,
         CASE WHEN present THEN 10.0 * factor * least(1.0, ln(1 + occ) / ln(6)) ELSE 0 END AS frequency, 20.0 * sov * factor AS voice, CASE WHEN cites THEN 15.0 * least(1.0, owned / 2.0) ELSE 0 END AS citation,
         CASE WHEN present AND sev IS NOT NULL THEN list_extract([5.0, 0.0, -2.0, -10.0], CAST(sev + 1 AS INT)) ELSE 0 END AS sentiment, CASE WHEN rivals > 0 THEN -8.0 * leaders / rivals ELSE 0 END AS lead FROM y)
"""


SCORE_COLUMNS = "SELECT sample_id, round(least(100.0, greatest(0.0, presence + prominence + frequency + voice + citation + sentiment + lead)), 6) AS score, present AS brand_present, CASE WHEN present THEN rank END AS brand_order_rank, occ AS brand_occurrences, rivals AS competitor_count, n_cited AS citation_count, owned > 0 AS brand_domain_cited, round(sov, 6) AS share_of_voice FROM z"


def _scores(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    s = scored(features(spark, sf_dir), version)
    longs = [F.col(c).cast("long").alias(c) for c in ("brand_order_rank", "brand_occurrences", "competitor_count", "citation_count")]
    return s.select("sample_id", F.round("score", 6).alias("score"), "brand_present", *longs, "brand_domain_cited", F.round("share_of_voice", 6).alias("share_of_voice"))


@query("sample_score_v2", score_sql("v2") + SCORE_COLUMNS)
def sample_score_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "v2")


@query("sample_score_v3", score_sql("v3") + SCORE_COLUMNS)
def sample_score_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, "v3")


RULE_NAMES = ["presence", "prominence", "frequency", "voice", "citation", "sentiment", "lead"]


@query("score_contributions", score_sql("v3") + " UNION ALL ".join(f"SELECT sample_id, '{r}' AS rule_id, round({c}, 6) AS contribution FROM z" for r, c in zip(WEIGHTS, RULE_NAMES, strict=True)))
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule of each answer."""
    s = scored(features(spark, sf_dir)).select("sample_id", F.explode("contributions").alias("c"))
    return s.select("sample_id", "c.rule_id", F.round("c.contribution", 6).alias("contribution"))


@query("contribution_scale", score_sql("v3") + "SELECT sample_id, round(greatest(1.0, 35.0, abs(presence), abs(prominence), abs(frequency), abs(voice), abs(citation), abs(sentiment), abs(lead)), 6) AS scale FROM z")
def contribution_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of all weights and contributions, by which bars are drawn."""
    s = scored(features(spark, sf_dir))
    most = F.array_max(F.transform("contributions", lambda c: F.greatest(F.abs(c["weight"]), F.abs(c["contribution"]))))
    return s.select("sample_id", F.round(F.greatest(F.lit(1.0), most), 6).alias("scale"))
