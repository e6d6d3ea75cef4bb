"""The corpus pipeline: language ID, line deduplication, near-deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last return
the columns of the documents they get. Null or empty texts have no letter, so the first stage rejects them; an empty table
passes through all stages; further columns, whatever their names, pass through all but the last, as one struct while a stage works. Rows are judged one by one, by their texts: what has no doc_id, or
one that other rows have too, is a document of its own. doc_id only decides which copy of a group of near copies stays.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import decontamination, language_id, line_dedup, packing, resemblance
from lumenspan.llm.common import discard, materialise, table

#: A document is rejected if no language has this share of its labels.
LEAST_SHARE = 0.3


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _of(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _apart(stage):
    """A stage that can't meet further columns of the documents by their names."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own, more = [c for c in docs.columns if c in OWN], [c for c in docs.columns if c not in OWN]
        held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(more)] or [F.lit(0).alias("none")]).alias("further__columns")
        out = stage(spark, docs.select(*own, held), sf_dir)
        return out.select(*[F.col(c) if c in own else F.col("further__columns").getField(f"c{more.index(c)}").alias(c) for c in docs.columns])

    return run


@_apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing label gets the predicted one."""
    out = language_id.predict(docs)
    out = out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*_of(docs))


@_apart
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have."""
    out = line_dedup.drop_frequent_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*_of(docs))


@_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, nulls last."""
    return resemblance.without_copies(docs).select(*_of(docs))


@_apart
def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_test_items),
    ("packing", pack_sequences),
]

#: The learned and the index stages can't be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
