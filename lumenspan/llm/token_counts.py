"""Token counts by an exact length histogram.

Each task encodes its documents and emits one count for each length it met; the counts are added up, and suffix sums over the
histogram - as many rows as there are different lengths - answer totals, quantiles and truncated totals for every context limit.
The suffix sums run over blocks of lengths, then within a block, so no task takes the whole histogram.

Null or empty text has no tokens. Rows that repeat a document count again. An empty table gives an empty histogram. Only the text
column is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .tokens import TOKENIZER, encoder, groups

BLOCK = 128


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """n_tokens, n_docs; written, as answers read it more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for _, texts in groups(batch.column(0)):
                seen.update(len(ids) // 4 for ids in encoder(tokenizer)(texts))
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    part = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "n_tokens long, n_docs long")
    return materialise(part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "length-histogram")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: docs and tokens of that length or more, and limits_from: the row answers every limit from there to
    n_tokens, as no length lies between."""
    h = histogram.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"), F.max("n_tokens").alias("longest"))
    # one row for each BLOCK lengths: the longest document bounds it, not their number
    down = Window.orderBy(F.desc("block"))
    later = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = blocks.select("block", *[F.coalesce(F.sum(f"block_{c}").over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")], F.lead("longest").over(down).alias("shorter"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    run = here.rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(rest, "block").withColumns({"docs_at_least": F.sum("n_docs").over(run) + F.col("later_docs"), "tokens_at_least": F.sum("tokens").over(run) + F.col("later_tokens")})
    out = out.withColumn("limits_from", F.coalesce(F.lead("n_tokens").over(here), F.col("shorter"), F.lit(-1)) + 1)
    out = out.withColumn("longer_docs", F.col("docs_at_least") - F.col("n_docs"))
    return out.select("n_tokens", "limits_from", "n_docs", "docs_at_least", "tokens_at_least", "longer_docs", "tokens")


def _with_totals(histogram: DataFrame) -> DataFrame:
    totals = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total_tokens"))
    return suffix_sums(histogram).crossJoin(F.broadcast(totals))  # one row


def _cut_at(limit: Column) -> Column:
    """The total if every document were cut at a limit that the row answers."""
    return F.col("total_tokens") - F.col("tokens_at_least") + limit * F.col("docs_at_least")


def token_counts(histogram: DataFrame) -> DataFrame:
    """The suffix sums with the totals: total_docs, total_tokens, truncated_tokens (every document cut at n_tokens) and
    quantile (the share of documents of n_tokens or fewer)."""
    quantile = (1 - F.col("longer_docs") / F.col("total_docs")).alias("quantile")
    return _with_totals(histogram).select("n_tokens", "limits_from", "n_docs", "docs_at_least", "tokens_at_least", _cut_at(F.col("n_tokens")).alias("truncated_tokens"), quantile, "total_docs", "total_tokens")


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, total_tokens, truncated_tokens, cut_docs, for any limits of zero or more, from the suffix sums: each limit is answered by
    the row in whose range it lies, and one beyond the longest document cuts nothing."""
    spark = histogram.sparkSession
    if not limits:
        return spark.createDataFrame([], "context_limit long, total_tokens long, truncated_tokens long, cut_docs long")
    asked = F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))])
    mine = F.filter(asked, lambda x: (x >= F.col("limits_from")) & (x <= F.col("n_tokens")))
    told = _with_totals(histogram).select("*", F.explode(mine).alias("context_limit"))
    cut = F.when(F.col("context_limit") < F.col("n_tokens"), F.col("docs_at_least")).otherwise(F.col("longer_docs"))
    told = told.select("context_limit", "total_tokens", _cut_at(F.col("context_limit")).alias("truncated_tokens"), cut.alias("cut_docs"))
    ends = histogram.agg(F.coalesce(F.max("n_tokens"), F.lit(-1)).alias("longest"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total_tokens"))
    beyond = ends.select(F.explode(F.filter(asked, lambda x: x > F.col("longest"))).alias("context_limit"), "total_tokens", F.col("total_tokens").alias("truncated_tokens"), F.lit(0).cast("long").alias("cut_docs"))
    return told.unionByName(beyond)


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents doesn't exceed."""
    asked = F.array(*[F.lit(float(x)) for x in sorted(set(shares))])
    total, upto = F.col("total_docs"), F.col("total_docs") - F.col("longer_docs")
    first = F.col("total_docs") == F.col("docs_at_least")
    mine = F.filter(asked, lambda q: (q * total <= upto) & ((q * total > upto - F.col("n_docs")) | first))
    return _with_totals(histogram).select(F.explode(mine).alias("share"), "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(length_histogram(table(spark, sf_dir, "documents")))
