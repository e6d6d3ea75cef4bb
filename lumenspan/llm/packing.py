"""Best-fit packing by exact-complement hashing.

Texts are encoded whole, an end id is added, and only longer documents are cut into pieces of `capacity` tokens. What packing has
to decide depends on the histogram of lengths alone - at most `capacity` counts - so that histogram, not the pieces, is planned:
lengths are taken from the longest, and the gap each leaves is looked up in an index of single, pair and triple length sums;
a combination that fills it exactly is used as many times over as the counts allow. Where none exists, the longest piece that fits
goes in and the rest of the gap is looked up again. Each step uses up a length, so the plan has a number of rows that is bounded by
`capacity`, whatever the input; it is broadcast. Pieces get their place from their rank among the pieces of their length. The
ranks are counted within salted groups, so that a length which a third of all pieces have is spread over many tasks.

Null text counts as empty and is the end id alone. A null doc_id is a value like any other; rows that repeat a doc_id or a whole
row are documents of their own. An empty table gives an empty result. Further columns of the input aren't looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .tokens import TOKENIZER, encoder, groups

CAPACITY = 2048
END_ID = 0
SALTS = 256


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    end = np.array([END_ID], "<u4").tobytes()
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in fields], *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            for first, texts in groups(batch.column(1)):
                row, piece, part = [], [], []
                for k, ids in enumerate(encoder(tokenizer)(texts)):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), step)):
                        row.append(first + k)
                        piece.append(p)
                        part.append(ids[at : at + step])
                length = np.array([len(x) // 4 for x in part], np.int64)
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * capacity), pa.array(length), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(part), "<u4").astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(cut, schema)


class Complements:
    """Which single, pair and triple sums the lengths at hand can make. Counts only fall, so the index of pair sums may promise too
    much; what it promises is verified, and the index is rebuilt when it was wrong."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.rebuild()

    def rebuild(self) -> None:
        there = (self.counts > 0).astype(np.float64)
        n = 2 * len(there)
        sums = np.fft.irfft(np.fft.rfft(there, n) ** 2, n) > 0.5
        self.pair_sums = sums[: len(there)]

    def pair(self, gap: int, at_most: int) -> tuple[int, int] | None:
        """The pair of the longest a <= at_most and b <= a."""
        a = np.arange(min(gap - 1, at_most), (gap + 1) // 2 - 1, -1)
        good = (self.counts[a] > 0) & (self.counts[gap - a] > np.where(2 * a == gap, 1, 0))
        return (int(a[k]), gap - int(a[k])) if len(a) and good[k := int(good.argmax())] else None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths that fill gap exactly, the longest first."""
        if self.counts[gap] > 0:
            return [gap]
        if found := self.pair(gap, gap):
            return list(found)
        for again in (True, False):
            a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
            for x in a[(self.counts[a] > 0) & self.pair_sums[gap - a]]:
                self.counts[x] -= 1
                found = self.pair(gap - int(x), int(x))
                self.counts[x] += 1
                if found:
                    return [int(x), *found]
            if again:
                self.rebuild()
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, hi, first, offset): the pieces of that length with ranks lo <= r < hi go to sequences first + r - lo."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    index = Complements(counts)
    for longest in range(capacity, 0, -1):
        while counts[longest] > 0:
            pattern, gap = [longest], capacity - longest
            counts[longest] -= 1
            while gap:
                more = index.fill(gap)
                if more is None:
                    fits = np.flatnonzero(counts[: gap + 1])
                    if not len(fits):
                        break
                    more = [int(fits[-1])]
                for x in more:
                    counts[x] -= 1
                pattern += more
                gap -= sum(more)
            for x in pattern:
                counts[x] += 1
            times = min(int(counts[x]) // n for x, n in Counter(pattern).items())
            offset = 0
            for x in pattern:
                lo = int(used[x])
                rows.append((x, lo, lo + times, sequence, offset))
                used[x] += times
                counts[x] -= times
                offset += x
            sequence += times
    return rows


def packed(cut: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """The pieces with sequence_id and offset. cut: a written table, as it is read more than once."""
    spark = cut.sparkSession
    # the histogram has `capacity` rows at most
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity)
    places = spark.createDataFrame(rows, "length long, lo long, hi long, first long, offset long")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("rank0"))
    where = ["length"]
    placed = ranked.join(F.broadcast(places), where).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(*cut.columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    return packed(materialise(pieces(docs, text, doc_id, capacity, tokenizer, with_ids), "pieces"), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids, for pieces that carry their ids; a sequence has at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
