"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records by seeded hashes: over the shards by doc_id (law `key`: rendezvous hashing, so the shard depends on doc_id
and the number of shards alone, and one more shard takes rows only into itself), and within a shard over memory-sized buckets by doc_id
and content, so that a doc_id which very many rows share fills many buckets. Buckets that still hold more than twice their size,
as equal records would make them, are dealt out once more by written row tags. Pass two gathers each bucket in one task, brings it
into a fixed order, Fisher-Yates shuffles it (`shuffle` with a seed) and numbers its records after those of the shard's earlier
buckets. A bucket holds about `bucket_bytes`, so the memory of a task doesn't grow with the input; the number of buckets does, and with
it the number of tasks, which the session's settings don't alter.

Null text counts as empty (size 16). A null doc_id is hashed as such. Rows that repeat a doc_id share a shard and get slots of their own.
An empty table gives an empty result. Other columns pass through, whatever their names; shard, slot and grown_shard are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table, work_dir

SHARDS = 40
SEED = 20260
BUCKET_BYTES = 64 << 20
LAW = "key"
#: Tasks of the second pass at most; each takes several buckets, one after the other, where there are more.
MOST_TASKS = 20_000
ADDED = ("shard", "slot", "grown_shard")


def _weight(doc_id: Column, shard: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), shard, doc_id)


def rendezvous(doc_id: Column, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """The shard with the greatest weight, and the same after one more shard has come."""
    ranked = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(_weight(doc_id, i, seed).alias("w"), i.alias("shard"))))
    return ranked["shard"], F.when(_weight(doc_id, F.lit(shards), seed) > ranked["w"], F.lit(shards)).otherwise(ranked["shard"])


def _dealt(docs: DataFrame, size: Column, doc_id: str, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """shard, bucket, part, grown, size, key, tie, row for each record; written, so that counts and shuffle see the same."""
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key, columns = F.col(f"`{doc_id}`"), [F.col(f"`{c}`") for c in docs.columns]
    shard, grown = rendezvous(key, shards, seed)
    tie = F.xxhash64(F.lit(seed + 2), *columns)
    rows = docs.select(
        shard.alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 1), key, tie), F.lit(buckets)).cast("int").alias("bucket"), grown.alias("grown"),
        size.cast("long").alias("size"), F.monotonically_increasing_id().alias("tag"), key.alias("key"), tie.alias("tie"), F.struct(*columns).alias("row"),
    )
    rows = materialise(rows, "shard-records")
    full = rows.groupBy("shard", "bucket").agg(F.sum("size").alias("n")).where(F.col("n") > 2 * bucket_bytes)
    full = materialise(full.select("shard", "bucket", F.ceil(F.col("n") / bucket_bytes).alias("parts")), "full-buckets")
    if full.isEmpty():
        # no literal, which a plan drops from the groups but not from the keys of the shuffle, and shuffles again
        return rows.withColumn("part", F.pmod("bucket", F.lit(1)))
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(seed + 3), "tag"), F.col("parts")), F.lit(0)).cast("int")
    return rows.join(full, ["shard", "bucket"], "left").withColumn("part", part).drop("parts")


def shuffled_shards(docs: DataFrame, size: Column, doc_id: str = "doc_id", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard, slot (0, 1, ... in each shard) and grown_shard; size: a record's bytes, by which buckets are sized."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    rows, place = _dealt(docs, size, doc_id, shards, seed, bucket_bytes), ["shard", "bucket", "part"]
    # the records of a bucket start where the shard's earlier buckets end; a row for each bucket
    counts = materialise(rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "bucket-counts")
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # a number of partitions that the records alone decide, and a fixed order within them: the same permutations every time
    width = max(shards, min(counts.count(), MOST_TASKS))
    record = F.struct("key", "tie", "row", "grown").alias("record")
    gathered = rows.select(*place, record).repartition(width, *place)
    gathered = gathered.groupBy(*place).agg(F.array_sort(F.collect_list("record"), _order).alias("records")).sortWithinPartitions(*place)
    # starts are dealt as the records are, so that these needn't move again to meet them
    mixed = gathered.withColumn("records", F.shuffle("records", F.lit(seed))).join(starts.repartition(width, *place), place)
    placed = mixed.select("shard", "start", F.posexplode("records").alias("at", "record"))
    row = [F.col("record.row").getField(c).alias(c) for c in docs.columns]
    return placed.select(*row, "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("record.grown").alias("grown_shard"))


def _order(a: Column, b: Column) -> Column:
    """By doc_id, nulls first, then by a hash of the whole record."""
    id_a, id_b = a["key"], b["key"]
    tie = F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0)
    return F.when(id_a.eqNullSafe(id_b), tie).when(id_a.isNull(), -1).when(id_b.isNull(), 1).when(id_a < id_b, -1).otherwise(1)


def write_shards(docs: DataFrame, path: str, text: str = "text", **how) -> None:
    """Write the shuffled records straight from their buckets, one folder for each shard; slot tells their order."""
    text_bytes = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + 16
    shuffled_shards(docs, text_bytes, **how).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def written_shards(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The records as they were written to the shards in the shared folder, with their places."""
    spark = docs.sparkSession
    path = f"{work_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, text, **how)
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    places = [T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("shard", T.IntegerType())]
    return spark.read.schema(T.StructType([*kept, *places])).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records go through both passes and into the shards' files; size and checksum are those of the texts that were written."""
    out, text = written_shards(table(spark, sf_dir, "documents")), F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
