"""The pipeline on planted cases, stage by stage, against what each stage is for."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenspan.llm import language_id, packing

WORDS = {"en": "the of and to in is that for it as was with be by on".split(), "fr": "le la les des est que dans pour une sur avec pas qui du au".split()}


def prose(rng, lang, n):
    stem = "ing tion er an th ed re" if lang == "en" else "eau ment oir é euse è que"
    made = ["".join(rng.choices(stem.split(), k=3)) for _ in range(n)]
    return " ".join(w if i % 3 else rng.choice(WORDS[lang]) for i, w in enumerate(made))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    item = prose(rng, "en", 40)
    rows = [(i, prose(rng, "en" if i % 2 else "fr", 120), "en" if i % 2 else "fr") for i in range(60)]
    base = rows[10][1].split()
    rows += [(100, rows[10][1], "fr"), (101, " ".join(w if i != 60 else "autrement" for i, w in enumerate(base)), "fr")]
    rows += [(102, "12 34 56", "en"), (103, None, "en"), (104, f"{prose(rng, 'en', 50)} {item.upper()} {prose(rng, 'en', 30)}", "en")]
    rows += [(200 + i, f"{prose(rng, 'en', 60)}\nCommon Footer line.", "en") for i in range(12)]
    rows += [(None, prose(rng, "en", 50), None)]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(1) for c in ("bits", "hash__x", "__row", "lang_pred", "lang_score", "n_lines__ld", "row", "a.b", "key")}).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def test_stages(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(language_id, "STEPS", 60)
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {name: {r.doc_id for r in got} for name, got in after.items()}
    everything = {i for i, _, _ in rows}
    assert ids["language_id"] == everything - {102, 103} == ids["line_dedup"]
    assert next(r for r in after["language_id"] if r.doc_id is None).lang in ("en", "fr")
    for r in after["line_dedup"]:
        assert "Footer" not in r.text and r.n_chars == len(r.text)
    assert ids["near_dedup"] == ids["line_dedup"] - {100, 101} and len(after["near_dedup"]) == len(ids["near_dedup"])
    assert ids["decontamination"] == ids["near_dedup"] - {104}
    encode = packing.encoder(packing.TOKENIZER)
    assert sum(r.length for r in after["packing"]) == sum(len(encode([r.text])[0]) // 4 + 1 for r in after["decontamination"])


def test_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
