"""Measurement passports: what stands behind a finding, as a struct, as JSON, and as a Markdown document.

The document is one template; a generic renderer fills its holes from the fields of the struct.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.stats import QUERY_CLUSTER, seed_of
from lumenspan.operators.readmodel import FIND_SQL, cell_scores, findings
from lumenspan.operators.rollup import RUN_SQL, cluster_summary, coverage, run_status, seeded_intervals, summary_sql
from lumenspan.queries import query
from lumenspan.sources.tables import OBS_SQL, completed

NOTICE = "Observed difference between two modes of one engine; not a causal effect."
SCHEMA, VERSION, EXPORTED = "measurement-passport/v1", "0.3", "2024-01-30T12:00:00.000Z"
PROGRESS = ("totalTasks", "totalSamples", "doneSamples", "failedSamples", "nPlanned", "nSuccessful", "nScored", "missingAnalysis")
#: The document's wording, what an unknown value reads, the names of the modes, and Markdown's signs that free text is kept from.
DOCUMENT = """# Passeport de mesure — {measurement.query:free}

- Schéma : {schemaVersion:code}
- Application : {app.name:word} {app.version:word}
- Projet : {project.name:free}
- Marques : {brands.names:list}
- Fournisseur : {measurement.provider.label:free} ({measurement.provider.code:code})
- Requête : {measurement.query:free}
- Écart observé groundé − paramétrique : {measurement.gapPoints:number} points
- Version du score : {method.scoringVersion:code}
- Export : {exportedAt:word}

| Mode | Médiane | Intervalle | Stabilité | n | Réponses brutes | Cellules | Faible n | Méthode | Présence marque |
|---|---:|---:|---:|---:|---:|---:|:---:|---|---:|
{measurement.axes:axes}

Run : {run.status:word} · terminé {run.completedAt:word} · {run.progress.doneSamples:number}/{run.progress.totalSamples:number} appels traités · {run.progress.failedSamples:number} en échec.
Couverture d’analyse : planifié {run.progress.nPlanned:number}, réussi {run.progress.nSuccessful:number}, scoré {run.progress.nScored:number}, analyse manquante {run.progress.missingAnalysis:number}.

> {measurement.notice:plain}
"""
AXIS = "| {mode:mode} | {median:number} | {interval:range} | {stability:share} | {n:number} {nUnit:word} | {rawN:number} | {cellN:number} | {lowN:flag} | {method:word} | {brandPresenceRate:share} |"
UNKNOWN = "indisponible"
MODES = {"GROUNDED": "GROUNDÉ", "PARAMETRIC": "PARAMÉTRIQUE"}
SIGNS = r"([\\`*_\[\]{}()<>#+.!|~-])"

HOLE = re.compile(r"\{([\w.]+):(\w+)\}")


def _or_unknown(known: Column, text: Column) -> Column:
    return F.when(known, text).otherwise(UNKNOWN)


def number(x: Column, digits: int = 2) -> Column:
    """With a comma, without trailing zeros, thousands apart by narrow spaces."""
    short = F.regexp_replace(x.cast(f"decimal(28,{digits})").cast("string"), r"\.0+$|(?<=\.\d)0+$", "")
    return _or_unknown(x.isNotNull(), F.replace(F.regexp_replace(short, r"(?<=\d)(?=(?:\d{3})+(?:\.|$))", "\u202f"), F.lit("."), F.lit(",")))


def word(x: Column) -> Column:
    return _or_unknown(F.coalesce(F.btrim(x), F.lit("")) != "", F.regexp_replace(x, r"\r?\n", " "))


FORMATS: dict[str, Callable[[Column], Column]] = {
    "plain": lambda x: x,
    "word": word,
    "code": lambda x: F.concat(F.lit("`"), word(x), F.lit("`")),
    "free": lambda x: F.when(word(x) == UNKNOWN, UNKNOWN).otherwise(F.regexp_replace(word(x), SIGNS, r"\\$1")),
    "list": lambda x: _or_unknown(F.size(x) > 0, F.array_join(F.transform(x, FORMATS["free"]), ", ")),
    "number": number,
    "share": lambda x: _or_unknown(x.isNotNull(), F.concat(number(x * 100, 0), F.lit("\u00a0%"))),
    "range": lambda x: _or_unknown(x["low"].isNotNull() & x["high"].isNotNull(), F.concat(number(x["low"]), F.lit("–"), number(x["high"]))),
    "flag": lambda x: F.when(x, "oui").otherwise("non"),
    "mode": lambda x: F.coalesce(*[F.when(x == k, v) for k, v in MODES.items()]),
    "axes": lambda x: F.array_join(F.transform(x, lambda a: filled(AXIS, a)), "\n"),
}


def filled(template: str, of: Column) -> Column:
    """The template with its holes, {path:format}, filled from a struct's fields."""
    parts, at = [], 0
    for hole in HOLE.finditer(template):
        value = of
        for name in hole[1].split("."):
            value = value[name]
        parts += [F.lit(template[at : hole.start()]), FORMATS[hole[2]](value)]
        at = hole.end()
    return F.concat(*parts, F.lit(template[at:]))


def passport_document(payload: Column) -> Column:
    return filled(DOCUMENT, payload)


def axes_of(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axes: an array of both modes' summaries, GROUNDED first; a mode without a query has none. cells: keys, mode, median, ci_low, ci_high,
    stability, n, raw_n, cell_n, low_n, ci_method, presence, any of which but mode and n may be null."""
    unit = F.when(F.col("ci_method") == QUERY_CLUSTER, "queries").otherwise("samples")
    axis = F.struct(
        "mode", "median", F.struct(F.col("ci_low").alias("low"), F.col("ci_high").alias("high")).alias("interval"), "stability", "n", F.col("raw_n").alias("rawN"),
        F.col("cell_n").alias("cellN"), unit.alias("nUnit"), F.col("low_n").alias("lowN"), F.col("ci_method").alias("method"), F.col("presence").alias("brandPresenceRate"),
    )
    return cells.where("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(axis)).alias("axes"))


def passports(found: DataFrame, cells: DataFrame, keys: list[str], project: str, brands: list[str], exported_at: str, scoring: str = "v3") -> DataFrame:
    """keys, payload for each finding. found: keys, title, provider, kind, gap and context, a struct of the run's status, completedAt and progress;
    cells: as axes_of takes them."""
    payload = F.struct(
        F.lit(SCHEMA).alias("schemaVersion"), F.struct(F.lit("lumenspan").alias("name"), F.lit(VERSION).alias("version")).alias("app"),
        F.lit(exported_at).alias("exportedAt"), F.struct(F.lit(project).alias("name")).alias("project"),
        F.struct(F.array(*[F.lit(b) for b in sorted(brands)]).alias("names")).alias("brands"),
        F.struct(
            F.col("kind").alias("classification"), F.col("title").alias("query"), F.struct(F.col("provider").alias("code"), F.initcap("provider").alias("label")).alias("provider"),
            F.col("gap").alias("gapPoints"), "axes", F.lit(NOTICE).alias("notice"),
        ).alias("measurement"),
        F.struct(F.lit(scoring).alias("scoringVersion")).alias("method"), F.col("context").alias("run"),
    )
    return found.join(axes_of(cells, keys), keys).select(*keys, payload.alias("payload"))


def run_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, context: how the run stands, and how much of it has been analysed."""
    obs_end = completed(spark, sf_dir).groupBy("run_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("completedAt"))
    s = run_status(spark, sf_dir).join(coverage(spark, sf_dir).select("run_id", "planned", "successful", "scored", F.col("missing").alias("unscored")), "run_id").join(obs_end, "run_id", "left")
    values = ("planned", "planned", F.col("succeeded") + F.col("failed") + F.col("cancelled"), "failed", "planned", "successful", "scored", "unscored")
    progress = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in zip(PROGRESS, values, strict=True)])
    ended = F.when(~F.coalesce(F.col("status"), F.lit("RUNNING")).isin("RUNNING", "CANCELLING"), F.col("completedAt"))
    return s.select("run_id", F.struct(F.coalesce("status", F.lit("RUNNING")).alias("status"), ended.alias("completedAt"), progress.alias("progress")).alias("context"))


RUN_KEYS = ["run_id", "provider"]


def run_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, provider, payload: the modes of an engine in a run, each over the run's queries, with seeded intervals."""
    done, grain = completed(spark, sf_dir).withColumn("engine", F.col("provider")), ["run_id", "engine", "mode"]
    cells = cluster_summary(done, grain).join(seeded_intervals(done, grain, seed_of(*grain, F.lit("v3"))).select(*grain, "ci_low", "ci_high"), grain, "left")
    cells = cells.withColumnRenamed("engine", "provider").withColumn("ci_method", F.lit(QUERY_CLUSTER))
    of = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("median")))
    gap = cells.groupBy(*RUN_KEYS).agg(F.round(of("GROUNDED") - of("PARAMETRIC"), 6).alias("gap")).where("gap IS NOT NULL")
    kind = F.when(F.col("gap") < 0, "grounded-erosion").otherwise("grounded-recovery")
    found = gap.join(run_context(spark, sf_dir), "run_id").withColumns({"kind": kind, "title": F.concat(F.lit("run "), "run_id")})
    return passports(found, cells, RUN_KEYS, "demo", ["inble"], EXPORTED)


RUN_CELLS = f"""rc AS ({summary_sql("run_id, provider, mode").replace("query_id, provider AS cell_provider", "query_id, 0 AS cell_provider")}), rs AS ({RUN_SQL}), pl AS (
  WITH {OBS_SQL} SELECT run_id, count(*) AS planned, count_if(status = 'COMPLETED') AS successful, count_if(status = 'COMPLETED' AND sample_id % 97 <> 0) AS scored FROM obs GROUP BY run_id), ax AS (
  SELECT run_id, provider, max(median) FILTER (mode = 'GROUNDED') - max(median) FILTER (mode = 'PARAMETRIC') AS gap, string_agg(mode, ',' ORDER BY mode) AS modes,
         max(n) FILTER (mode = 'GROUNDED') AS n_grounded, max(raw_n) FILTER (mode = 'PARAMETRIC') AS raw_parametric, max(cell_n) FILTER (mode = 'GROUNDED') AS cells_grounded,
         max(stability) FILTER (mode = 'PARAMETRIC') AS stability_parametric, count_if(n > 1) AS intervals FROM rc GROUP BY ALL HAVING count(*) = 2)"""


@query("run_passport", f"WITH {RUN_CELLS} " + """SELECT run_id, provider, CASE WHEN gap < 0 THEN 'grounded-erosion' ELSE 'grounded-recovery' END AS classification, round(gap, 6) AS gap_points, modes, n_grounded, raw_parametric,
  cells_grounded, stability_parametric, intervals, 'query-cluster-v1' AS method, 'queries' AS n_unit, coalesce(status, 'RUNNING') AS status, failed, planned, scored FROM ax JOIN rs USING (run_id) JOIN pl USING (run_id)""")
def run_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON documents of runs and engines, read back; the intervals' ends are held against the bootstrap in the tests."""
    made = run_passports(spark, sf_dir)
    back = made.select(*RUN_KEYS, F.from_json(F.to_json("payload"), made.schema["payload"].dataType).alias("p"))
    m, axes, run = F.col("p.measurement"), F.col("p.measurement.axes"), F.col("p.run")
    ends = F.filter(axes, lambda a: a["interval"]["low"].isNotNull() & (a["interval"]["low"] <= a["interval"]["high"]))
    return back.select(
        *RUN_KEYS, m["classification"].alias("classification"), m["gapPoints"].alias("gap_points"), F.array_join(F.transform(axes, lambda a: a["mode"]), ",").alias("modes"),
        axes[0]["n"].alias("n_grounded"), axes[1]["rawN"].alias("raw_parametric"), axes[0]["cellN"].alias("cells_grounded"), axes[1]["stability"].alias("stability_parametric"),
        F.size(ends).cast("long").alias("intervals"), axes[0]["method"].alias("method"), axes[1]["nUnit"].alias("n_unit"), run["status"].alias("status"),
        run["progress"]["failedSamples"].alias("failed"), run["progress"]["nPlanned"].alias("planned"), run["progress"]["nScored"].alias("scored"),
    )


@query("passport_documents", f"WITH {RUN_CELLS} " + r"""SELECT run_id, provider, '# Passeport de mesure — run ' || replace(run_id, '-', '\-') AS title, 21::BIGINT AS n_lines,
  'Couverture d’analyse : planifié ' || planned || ', réussi ' || successful || ', scoré ' || scored || ', analyse manquante ' || (successful - scored) || '.' AS covered,
  intervals AS ranges, 'Fournisseur : ' || upper(provider[1]) || provider[2:] || ' (`' || provider || '`)' AS engine FROM ax JOIN pl USING (run_id)""")
def passport_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown documents of runs and engines, taken apart into lines."""
    text = run_passports(spark, sf_dir).select(*RUN_KEYS, F.split(F.replace(passport_document(F.col("payload")), F.lit("\u202f"), F.lit("")), "\n").alias("l"))
    one = lambda start: F.get(F.filter("l", lambda x: x.startswith(start)), F.lit(0))
    ranges = F.filter("l", lambda x: x.rlike(r"^\| [GP].*\d–-?\d"))
    return text.select(*RUN_KEYS, F.get("l", F.lit(0)).alias("title"), (F.size("l") - 1).cast("long").alias("n_lines"), one("Couverture").alias("covered"), F.size(ranges).cast("long").alias("ranges"), F.substring(one("- Fournisseur"), 3, 1000).alias("engine"))


@query("passport_payload", "WITH pf AS (" + FIND_SQL + """), px AS (SELECT event_type AS provider, user_id AS query_id, count_if(event_id % 2 = 0) AS n_g, count_if(event_id % 2 <> 0) AS n_p
FROM events WHERE NOT (event_id % 17 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0) GROUP BY ALL)
SELECT query_id, provider, kind AS classification, gap AS gap_points, 'GROUNDED,PARAMETRIC' AS modes, n_g AS raw_grounded, n_p AS raw_parametric, 1::BIGINT AS n_grounded, false AS has_interval, 1.0::DOUBLE AS stability,
  'queries' AS n_unit, gap AS gap_of_axes FROM pf JOIN px USING (query_id, provider)""")
def passport_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document behind every finding, read back. A question is one cluster, so its modes have no interval."""
    scores = cell_scores(completed(spark, sf_dir))
    none, one = F.lit(None).cast("double"), F.lit(1).cast("long")
    cells = scores.withColumns({"raw_n": F.col("n"), "n": one, "cell_n": one, "ci_low": none, "ci_high": none, "stability": F.lit(1.0), "ci_method": F.lit(QUERY_CLUSTER)})
    context = F.struct(F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("completedAt"), F.struct(*[F.lit(None).cast("long").alias(c) for c in PROGRESS]).alias("progress"))
    found = findings(scores, None).withColumns({"title": F.concat(F.lit("q"), F.col("query_id").cast("string")), "context": context})
    made = passports(found, cells, ["query_id", "provider"], "demo", ["inble"], EXPORTED)
    back = made.select("query_id", "provider", F.from_json(F.to_json("payload"), made.schema["payload"].dataType).alias("p"))
    m, axes = F.col("p.measurement"), F.col("p.measurement.axes")
    return back.select(
        "query_id", "provider", m["classification"].alias("classification"), m["gapPoints"].alias("gap_points"), F.array_join(F.transform(axes, lambda a: a["mode"]), ",").alias("modes"),
        axes[0]["rawN"].alias("raw_grounded"), axes[1]["rawN"].alias("raw_parametric"), axes[0]["n"].alias("n_grounded"), axes[0]["interval"]["low"].isNotNull().alias("has_interval"),
        axes[1]["stability"].alias("stability"), axes[0]["nUnit"].alias("n_unit"), F.round(axes[0]["median"] - axes[1]["median"], 6).alias("gap_of_axes"),
    )
