"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of type long, in any direction. Returns u, v with v the smallest node that u reaches, for every u but the
    smallest of each component. Alternates large-star and small-star steps; the neighbours of a node are only ever aggregated,
    never gathered, and each round's edges are written to the shared folder, where they take the place of the last."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = materialise(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.distinct(), "edges")
        discard(before)
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges
