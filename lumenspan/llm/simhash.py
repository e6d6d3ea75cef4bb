"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints of whole texts are computed inside tasks; equal ones are one node from then on, so copies cost nothing further. Two
fingerprints that differ in at most three bits agree in one of four 16-bit blocks, so the distinct fingerprints are dealt out by
block, four times; each task builds the Gray-order index over what it gets, and searches it. It returns a spanning forest of
the links it found - never more rows than fingerprints - and the components of all forests are joined by star contraction. Blocks that
more than `GROUP_LIMIT` fingerprints share are dealt out again by a quarter of their other 48 bits, then of the remaining 36:
no pair within three bits is lost, and a group can't exceed the 2^27 codes that the last 27 bits allow.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z lower-cased, shingles three words in a row, repeats included; fewer words are one
shingle; no words (null, empty or blank text) give the fingerprint zero, which links like any other. A null doc_id is only
the smallest of a group without any other. Rows that repeat a doc_id or a text keep rows of their own. An empty table gives an
empty result. Further columns of the input aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shuffle_width, table
from .graph import components
from .gray_index import GrayIndex
from .resemblance import similar_groups as similar_groups

SHINGLE = 3
BITS = 3
SEED = 42
GROUP_LIMIT = 200_000
PER_TASK = 500_000


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    from xxhash import xxh64_digest

    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return 0
    hashes = [xxh64_digest(b" ".join(t), SEED) for t in zip(*(w[i:] for i in range(words)), strict=False)] or [xxh64_digest(b" ".join(w), SEED)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(np.frombuffer(b"".join(hashes[at : at + (1 << 16)]), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp long."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(t.as_py() or b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _bits(x: Column, shift: Column | int, n: int) -> Column:
    shift = shift if isinstance(shift, Column) else F.lit(shift)
    return F.call_function("shiftrightunsigned", x, shift.cast("int")).bitwiseAND(F.lit((1 << n) - 1))


def _turn(x: Column, by: Column, n: int) -> Column:
    """The low n bits of x, rotated left by so many."""
    low = x.bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else x
    right = F.call_function("shiftrightunsigned", low, (F.lit(n) - by).cast("int"))
    turned = F.call_function("shiftleft", low, by.cast("int")).bitwiseOR(F.when(by == 0, F.lit(0).cast("long")).otherwise(right))
    return turned.bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else turned


def dealt(nodes: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """key, fp: any two fingerprints within three bits share a key."""
    quarters = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    out = nodes.select("fp", quarters.alias("q")).withColumn("rest", _turn(F.col("fp"), F.col("q") * 16, 64))
    out = out.select("fp", F.concat_ws(".", "q", _bits(F.col("rest"), 48, 16)).alias("key"), "rest")
    left = 48
    for part in (12, 9):
        hot = materialise(out.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("key", F.lit(True).alias("hot")), "hot-blocks")
        if hot.isEmpty():
            break
        marked = out.join(hot, "key", "left")
        again = marked.where("hot").select("fp", "key", "rest", quarters.alias("q")).withColumn("rest", _turn(F.col("rest"), F.col("q") * part, left))
        again = again.select("fp", F.concat_ws(".", "key", "q", _bits(F.col("rest"), left - part, part)).alias("key"), "rest")
        out = marked.where("hot IS NULL").select("fp", "key", "rest").unionByName(again)
        left -= part
    return out.select(F.xxhash64("key").alias("key"), "fp")


def links(nodes: DataFrame, group_limit: int = GROUP_LIMIT, bits: int = BITS) -> DataFrame:
    """u, v: a spanning forest of the links within each task. nodes: a written table of distinct fp."""
    width = shuffle_width(nodes.sparkSession, 4 * nodes.count(), PER_TASK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            keys, fp = (np.concatenate(x) for x in zip(*got, strict=True))
            to = fp[GrayIndex(keys, fp.view(np.uint64)).linked(bits)]
            apart = to != fp
            yield pa.RecordBatch.from_arrays([pa.array(fp[apart]), pa.array(to[apart])], names=["u", "v"])

    return dealt(nodes, group_limit).repartition(width, "key").mapInArrow(search, "u long, v long")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = SHINGLE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach)."""
    prints = materialise(fingerprints(docs, text, doc_id, words), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    joined = components(links(nodes.select("fp"), group_limit))
    members = joined.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(joined.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    smallest = nodes.join(members, "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    least = members.join(smallest, "root").select("fp", "least_id")
    named = nodes.join(least, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return prints.join(materialise(named, "components"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
