"""Mentions of a joined catalogue against a search of every entity in every answer."""

import random

import pytest
from pyspark.sql import functions as F

from lumenspan.functions.answers import Matcher
from lumenspan.operators import catalogue

COLUMNS = "project_id string, id string, kind string, name string, aliases array<string>, domain string"


def by_hand(answers, entities, version):
    """Each answer against all entities of its project."""
    found = []
    for key, project, text in answers:
        own = sorted((e for e in entities if e[0] == project), key=lambda e: e[1])
        matcher = Matcher([dict(zip(("id", "kind", "name", "aliases", "domain"), e[1:], strict=True)) for e in own])
        found += [(key, *m) for m in matcher.mentions(text, version)]
    return sorted(found, key=repr)


def word(rng):
    return "".join(rng.choice("aeéß") + rng.choice("bdl") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "x", "É", "o"])


def some_catalogue(rng, projects, each):
    rows = []
    for p in range(projects):
        for i in range(each):
            name = rng.choice([word(rng), f"{word(rng)} {word(rng)}", word(rng).upper(), f"{word(rng)}-{word(rng)}"])
            aliases = rng.choice([None, [], [word(rng)], [word(rng), f"{word(rng)} & {word(rng)}", ""]])
            rows.append((f"p{p}", f"e{i}", "BRAND", name, aliases, rng.choice([None, "", f"https://www.{word(rng)}.com/x"])))
    rows.append(("p0", "plus", "BRAND", "++", ["§ §"], None))  # nothing that is a token
    rows.append(("p1", "e0x", "COMPETITOR", "only p1", None, None))
    return rows


@pytest.mark.parametrize("version", ["v2", "v3"])
def test_equals_a_search_for_every_entity(spark, version):
    rng = random.Random(11)
    entities = some_catalogue(rng, 3, 25)
    names = [e[3] for e in entities] + [e[5][12:-2] for e in entities if e[5]]
    answers = []
    for k in range(120):
        parts = [rng.choice([rng.choice(names), word(rng), rng.choice(names)[:-1], rng.choice(names) + "z", "++", "§ §", "only p1", "😀", "A long sentence ends here."]) for _ in range(rng.randrange(25))]
        answers.append((k, f"p{k % 4}", rng.choice([" ", ", ", ". "]).join(parts)))
    answers += [(900, "p0", None), (901, "p0", ""), (902, None, "++ only p1"), (None, "p1", "only p1 and only p2")]
    docs = spark.createDataFrame(answers, "key long, project_id string, text string").repartition(3)
    got = catalogue.catalogue_mentions_of(docs, spark.createDataFrame(entities, COLUMNS), version).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(answers, entities, version)
    assert {r.mention_type for r in got} == {"EXACT", "ALIAS", "DOMAIN", "APPROXIMATE"}
    assert catalogue.catalogue_mentions_of(docs.where("false"), spark.createDataFrame(entities, COLUMNS), version).count() == 0
    assert catalogue.catalogue_mentions_of(docs, spark.createDataFrame([], COLUMNS), version).count() == 0


def test_many_entities_meet_answers_by_keys(spark):
    """10^5 entities in 100 projects, one of which has a third of the answers: no join without keys, no entity tried on every answer."""
    n = F.col("id")
    digits = F.translate(F.lpad((n * 7919 % 99991).cast("string"), 5, "0"), "0123456789", "abcdefghij")
    listed = spark.range(100_000).select(
        F.concat(F.lit("p"), (n % 100).cast("string")).alias("project_id"), F.concat(F.lit("e"), n.cast("string")).alias("id"), F.lit("BRAND").alias("kind"),
        F.concat(F.lit("qu"), digits).alias("name"), F.array(F.concat(digits, F.lit(" gmbh"))).alias("aliases"), F.lit(None).cast("string").alias("domain"),
    )
    some = listed.where("crc32(id) % 500 = 0").collect()
    texts = [(i, "p0" if i % 3 == 0 else e.project_id, f"First words. Then {e.name.upper()} or the {e.aliases[0]} of {e.name[:-1]}zz, {e.name}y.") for i, e in enumerate(some)]
    answers = spark.createDataFrame(texts, "key long, project_id string, text string")
    found = catalogue.catalogue_mentions_of(answers, listed)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    by_project = {}
    for r in listed.collect():
        by_project.setdefault(r.project_id, []).append(r)
    want = []
    for key, project, text in texts:
        # only names that share all but a letter with a token can be found: try these alone, one by one
        tokens = {t.strip(".,").lower() for t in text.split()}
        near = [e for e in by_project[project] if e.name in tokens or e.aliases[0].split()[0] in tokens or any(abs(len(t) - len(e.name)) < 2 and t[:2] == "qu" and sum(a != b for a, b in zip(t, e.name)) < 3 for t in tokens)]
        want += by_hand([(key, project, text)], [tuple(e) for e in near], "v3")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(want, key=repr) and len({g[1] for g in got}) > 100


def test_answers_of_one_partition_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "PER_TASK", 10)
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("key"), F.lit("p").alias("project_id"), F.lit("one inble here").alias("text"))
    entities = spark.createDataFrame([("p", "b1", "BRAND", "inble", None, None)], COLUMNS)
    found = catalogue.catalogue_mentions_of(docs, entities)
    assert found.groupBy(F.spark_partition_id()).count().count() >= 15 and found.count() == 200


def test_needles_of_one_word_are_looked_up():
    entities = [{"id": f"e{i}", "kind": "BRAND", "name": n, "aliases": [f"the {n}"], "domain": None} for i, n in enumerate(["Inblé", "inble", "a-b", "x"])]
    matcher = Matcher(entities)
    assert {n for n in matcher.spelled} == {"inble", "x"} and len(matcher.needles) == 5
    assert [(m[0], m[2], m[4]) for m in matcher.mentions("INBLE, the x; a-b a-bc xx", "v2")] == [
        ("e0", "EXACT", 0), ("e1", "EXACT", 0), ("e3", "EXACT", 11), ("e2", "EXACT", 14),
    ]
