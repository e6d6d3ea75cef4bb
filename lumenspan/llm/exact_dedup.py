"""Exact deduplication that splits off heavy hitters.

Texts are equal when they are identical after white space is deleted. A narrow table of digests is written once. Misra-Gries
summaries, one for each partition, are merged into at most `counters` candidates; the winner and the exact size of each
candidate's group are then computed (partial aggregation keeps hot digests small) and broadcast - at most `counters` rows, whatever the
input. Rows of those digests are resolved map-side; the others are shuffled by digest, where no group is over 2 / counters of all
rows, and even these are aggregated and joined again, never gathered.

Null text counts as empty; all empty texts form one group. A null doc_id sorts after all others. Rows that repeat a doc_id or
a whole row are rows of their own: exactly one row of a group is kept, the smallest `row_tag` among full ties. An empty table
gives an empty result. Further columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tagged

COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row_tag: str | None = None) -> DataFrame:
    """doc_id, digest, n_chars (code points of the original text) and row_tag (a column that tells rows apart, or a number given here), as
    a written table: the tags don't change."""
    t = F.col(f"`{text}`")
    slim = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.unhex(F.sha2(normalised(t), 256)).alias("digest"),
        F.char_length(F.coalesce(t, F.lit(""))).alias("n_chars"),
        (F.col(f"`{row_tag}`") if row_tag else F.monotonically_increasing_id()).alias("row_tag"),
    )
    return materialise(slim, "digests")


def misra_gries(counts: pd.Series, counters: int) -> pd.Series:
    """Keep at most `counters` counters: subtract the largest count that has no place from all, drop what reaches zero. No
    count falls by more than (sum of counts) / (counters + 1)."""
    if len(counts) <= counters:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts.iloc[:counters] - counts.iloc[counters]
    return counts[counts > 0]


def heavy_candidates(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each with more than 2/counters of the rows."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            kept = misra_gries(kept.add(batch["digest"].value_counts(), fill_value=0).astype("int64"), counters)
        if len(kept):
            yield pd.DataFrame({"digest": kept.index, "least": kept.to_numpy()})

    merged = slim.select("digest").mapInPandas(summary, "digest binary, least long").groupBy("digest").agg(F.sum("least").alias("least"))
    return merged.orderBy(F.desc("least"), "digest").limit(counters).select("digest")


def _best(cols: list[str]) -> Column:
    """The winner sorts first: most code points, then smallest doc_id, then the smallest tag."""
    return F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), *cols)


def _winners(slim: DataFrame) -> DataFrame:
    """digest, keep_id, keep_tag, group_size of each digest; partial aggregation keeps hot digests small."""
    best = slim.groupBy("digest").agg(F.min(_best(["doc_id", "row_tag"])).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_tag").alias("keep_tag"), "group_size")


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS, row_tag: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, row_tag, digest, keep_id, group_size, kept."""
    slim = digests(docs, text, doc_id, row_tag)
    candidates = F.broadcast(heavy_candidates(slim, counters))
    heavy = materialise(_winners(slim.join(candidates, "digest")), "heavy-winners")
    light = slim.join(F.broadcast(heavy), "digest", "left_anti")
    # aggregated, then met by digest again: no task holds a whole group
    told = slim.join(F.broadcast(heavy), "digest").unionByName(light.join(_winners(light), "digest"))
    return told.select("doc_id", "row_tag", "digest", "keep_id", "group_size", (F.col("row_tag") == F.col("keep_tag")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns but `__row`, which is reserved: one row of each group, whatever their doc_ids."""
    rows = tagged(docs)
    stay = duplicates(rows, text, doc_id, counters, "__row").where("kept").select(F.col("row_tag").alias("__row"))
    return rows.join(materialise(stay, "kept-rows"), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""
